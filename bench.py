"""Wall time of the headline queries. ``python bench.py [query ...]`` prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadloom import plans  # noqa: E402
from leadloom.session import build_session  # noqa: E402

HEADLINE = [
    "ranked_leads", "normalize_urls", "directory_flags", "email_scores", "phone_formats", "location_parse", "lead_distance",
    "quality_scores", "verification_scores", "dup_by_domain", "mark_duplicates", "similar_companies", "merged_results",
    "dedup_results", "page_links", "page_contacts", "crawled_page_contacts", "site_classification", "directory_expansion",
    "page_team_people", "merged_people", "email_pattern_by_domain", "generated_emails", "enrich_leads", "lead_funnel",
    "company_dashboard", "daily_trend", "running_balance", "fair_queue", "lead_neighbours", "export_flat", "stream_progress",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    plans.load()
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    plans.QUERIES["social_platform_counts"](spark, sf_dir).collect()  # start-up is not measured
    times: dict[str, float | str] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        try:
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # a failing query must not hide the others
            times[name] = f"failed: {str(error)[:200]}"
    total = round(sum(t for t in times.values() if isinstance(t, float)), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
