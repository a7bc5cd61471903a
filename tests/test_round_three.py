"""Steps that were mended for size: the same rows as before, worked out once or for many keys at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom import plans
from leadloom.functions.score import quality_score
from leadloom.operators import dedup, listing, pages, queue
from leadloom.functions import phone
from leadloom.llm.shared import BATCH_ROWS, small_batches
from leadloom.sources import lead_fixture as L
from leadloom.streaming import live

plans.load()


def fold(times, gap):
    out, last = [], None
    for t in times:
        out.append(last is None or t - last >= gap)
        last = t if out[-1] else last
    return out


def test_steps_of_many_keys_at_once():
    rng = np.random.RandomState(3)
    for _ in range(100):
        groups = [np.sort(rng.randint(100, 200, rng.randint(1, 20))) for _ in range(rng.randint(1, 9))]
        gap = int(rng.randint(1, 150))
        code = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        whole = queue.bucket_steps(np.concatenate(groups), gap, 100, code)
        apart = [queue.bucket_steps(g, gap, 100) for g in groups]
        assert all((np.concatenate([a[i] for a in apart]) == whole[i]).all() for i in (0, 1))


def test_submissions_share_state(spark, tmp_path):
    """Null and large keys, a row without a time, and a state key per part and bucket instead of per key and bucket."""
    rng, big = random.Random(4), 2 ** 60
    rows = [(i, rng.choice([None, 1, big, big + 1, *range(2, 400)]), rng.choice(["a", None]), rng.randrange(9000)) for i in range(1500)]
    src, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    d = spark.createDataFrame([*rows, (9998, 1, "a", None), (9999, 0, "z", 10 ** 6)], "event_id long, k long, kind string, ms long")
    d.withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.parquet(src)
    out = live.accepted_submissions(live.file_stream(spark, src, "*.parquet"), ["k", "kind"], 1.0, delay="1 second", bucket_seconds=3.0, folder=kept)
    got = {r["event_id"]: (r["k"], r["kind"], r["accepted"]) for r in out.collect()}
    want = {}
    for key in {r[1:3] for r in rows}:
        own = sorted((r[3], r[0]) for r in rows if r[1:3] == key)
        want |= {i: (*key, ok) for (_, i), ok in zip(own, fold([t for t, _ in own], 1000))}
    assert got == want
    states = spark.read.format("statestore").option("path", f"{kept}/state").option("stateVarName", "waiting").option("batchId", 0).load()
    assert 0 < states.count() <= 4 * queue.PARTS < len({(*r[1:3], r[3] // 3000) for r in rows})


def test_stalls_share_state(spark, tmp_path):
    rng = random.Random(5)
    searches = [None, *range(300)]
    rows = [(s, rng.randrange(1, 400), rng.choice(["extracting", "completed", "enriching"]), rng.randrange(2)) for s in searches for _ in range(6)]
    rows = list({r[:2]: r for r in rows}.values())
    src, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    d = spark.createDataFrame([*rows, (-1, 1000, "completed", 0)], "search_id long, s long, status string, extracted_count long")
    d.select("search_id", F.timestamp_seconds("s").alias("ts"), "status", "extracted_count", F.lit(None).cast("long").alias("enriched_count")).coalesce(1).write.parquet(src)
    told = live.drain(live.stalled_spans(live.file_stream(spark, src, "*.parquet"), 50.0, "100 seconds"), "stalls", folder=kept)
    got = sorted(map(str, [(r["search_id"], r["extracted_count"], r["enriched_count"], r["s"]) for r in told.withColumn("s", F.unix_seconds("since")).collect()]))
    want = []
    for s in searches:
        span = None
        for _, at, status, n in [*sorted(r for r in rows if r[0] == s), (s, 900, "completed", 0)]:
            new = (at, n) if status != "completed" else None
            if span and (new is None or new[1] != span[1]):
                want += [(s, span[1], 0, span[0])] * (at - span[0] > 50)
                span = None
            span = span or new
    assert got == sorted(map(str, want)) and len(got) > 100
    states = spark.read.format("statestore").option("path", f"{kept}/state").option("stateVarName", "waiting").option("batchId", 0).load()
    assert 0 < states.count() <= queue.PARTS < 300


@pytest.mark.parametrize("name", ["deep_pages", "lead_sorts", "ranked_leads"])
def test_lists_read_stored_columns(spark, sf, name):
    """No sort, count or join works the leads out again."""
    assert not any("orders" in f for f in plans.QUERIES[name](spark, sf).inputFiles())


def test_score_before_entries_are_verified(spark, sf):
    both = L.leads(spark, sf, scored=True).withColumn("again", quality_score())
    assert both.filter("NOT (quality_score <=> again)").isEmpty() and both.select("quality_score").distinct().count() > 1


def test_small_searches_equal_rounds(spark):
    rng = random.Random(6)
    stems = ["acme trading", "acme trading c", "acme trading co", "bolt", "bol", "abc", "abcd", None, "", "long name of a company " * 4, "long name of a company " * 4 + "x"]
    rows = [(i % 390 if i < 395 else None, rng.choice([None, *range(12), 7, 7, 7, 7]), rng.choice(stems), rng.choice([None, "", "https://a.com", "http://www.a.com/x", "b.com", "https://google.com/search?q=a"]),
             rng.choice([None, 1, 2, 3])) for i in range(400)]
    d = spark.createDataFrame(rows, "lead_id long, search_id long, company_name string, website string, day int").withColumn("created_at", F.timestamp_seconds("day"))
    few, rounds, mixed = (sorted(map(str, dedup.mark_duplicates(d, few=n).select("lead_id", "search_id", "is_duplicate", "duplicate_of").collect())) for n in (10_000, 0, 40))
    assert few == rounds == mixed and any("is_duplicate=True" in r for r in few)


def test_page_rules_read_a_text_once(spark):
    """Rules that read a derived text many times hold it once in their plan."""
    d = spark.createDataFrame([("https://a.com", "<p>a@b.com x [at] c [dot] org, y@d [DOT] net</p><script>tel</script> Phone: +234 803 123 4567")], "url string, html string")
    one = d.select(pages.page_emails("html").alias("m"), phone.extract_phones("html", "url").alias("p"), pages.category_signals("html").alias("c"))
    assert [e["email"] for e in one.first()["m"]] == ["a@b.com", "y@d.net", "x@c.org"]
    assert one.first()["p"][0]["phone"] == "+2348031234567"
    plan = one._jdf.queryExecution().analyzed().toString()
    assert plan.count("</script>") == 1 and plan.count("&commat;") == 1


def test_texts_go_to_python_a_few_at_a_time(spark):
    import pyarrow as pa

    @F.arrow_udf("long")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x))
    most = lambda: spark.range(0, 3000, 1, 1).select(rows(F.col("id").cast("string")).alias("n")).agg(F.max("n")).first()[0]
    with small_batches(spark):
        assert most() <= BATCH_ROWS
    assert most() == 3000
