"""Table operators against brute force, and plans that must hold at scale."""

import random
import time

from pyspark.sql import Window as W, functions as F

from leadloom.operators import dedup, ledger, listing, pages, people, skew
from leadloom.sources import fixtures, html_nodes, lead_fixture as L
from leadloom.streaming import live


def edited(rng, base, alphabet="abcxyz ", most=6):
    w = list(rng.choice(base))
    for _ in range(rng.randint(0, most)):
        i, op = rng.randrange(len(w) or 1), rng.random()
        if not w or op < 0.34:
            w.insert(i, rng.choice(alphabet))
        elif op < 0.67:
            w[i] = rng.choice(alphabet)
        elif len(w) > 1:
            del w[i]
    return "".join(w)


def test_similar_pairs_equal_cross_join(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 45))) for _ in range(40)]
    left, right = ({edited(rng, base) for _ in range(300)} for _ in range(2))
    ld = spark.createDataFrame([(x,) for x in left], "name string")
    rd = spark.createDataFrame([(x,) for x in right], "other string")
    got = {tuple(r) for r in dedup.similar_pairs(ld, rd).select("name", "other").collect()}

    def similarity(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return (max(len(a), len(b)) - row[-1]) / max(len(a), len(b))

    want = {(a, b) for a in left for b in right if abs(len(a) - len(b)) <= 8 and similarity(a, b) >= 0.85}
    assert got == want and len(want) > 100


def test_mark_duplicates_equals_one_by_one(spark):
    rng = random.Random(5)
    names = ["acme trading company", "acme trading companys", "acme trading companyss", "blue river foods ltd", "blue river foods", "xyz", "north star"]
    rows = []
    for i in range(400):
        site = rng.choice([None, f"https://www.s{rng.randint(0, 30)}.com/x", "https://www.google.com/search?q=a"])
        rows.append((i, rng.randint(0, 4), rng.choice(names) + rng.choice(["", "", "x", " b"]), site, 1_700_000_000 + rng.randint(0, 50)))
    df = spark.createDataFrame(rows, "lead_id long, search_id long, company_name string, website string, t long").withColumn(
        "created_at", F.timestamp_seconds("t"))
    got = {r.lead_id: r.duplicate_of for r in dedup.mark_duplicates(df).collect()}
    kept, want = {}, {}
    for i, s, n, site, t in sorted(rows, key=lambda r: (r[4], r[0])):
        d = site.split("/")[2].removeprefix("www.") if site and "google.com/search" not in site else None
        mine = kept.setdefault(s, [])
        hit = next((k for k, m, e in mine if d and e == d), None)
        if hit is None and len(n) > 3:
            hit = next((k for k, m, e in mine if n in m and len(n) / len(m) > 0.85), None)
        want[i] = hit
        if hit is None:
            mine.append((i, n, d))
    assert got == want and sum(v is not None for v in want.values()) > 100


def test_running_balance_equals_fold(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, 0, 1]), i, rng.choice([-1, -1, -1, 1, 2])) for i in range(600)]
    df = spark.createDataFrame(rows, "company_id long, seq long, delta int")
    got = {r.seq: (r.balance, r.refused) for r in ledger.running_balance(df, width=37).collect()}
    state, want = {0: 0, 1: 0}, {}
    for c, i, d in rows:
        refused = d < 0 and state[c] <= 0
        state[c] += 0 if refused else d
        want[i] = (state[c], refused)
    assert got == want and any(r for _, r in want.values())
    assert {r.company_id: r.balance for r in ledger.balances(df, 37).collect()} == state


def test_balance_example(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([2, -1, -1, -1, 1, -1])], "company_id long, seq long, delta int")
    rows = ledger.running_balance(df).orderBy("seq").collect()
    assert [r.balance for r in rows] == [2, 1, 0, 0, 1, 0] and [r.refused for r in rows] == [False, False, False, True, False, False]


def test_attach_with_one_hot_key(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 1500).alias("k"))
    keyed = df.filter("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    got = skew.attach_per_key(df, keyed, ["k"], "n")
    want = df.join(keyed.drop("n"), "k", "left").select("id", "k", "first")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    looked = skew.lookup_per_key(df, keyed.drop("n").filter("k % 2 = 0"), ["k"])
    expect = df.join(keyed.drop("n").filter("k % 2 = 0"), "k", "left").select("id", "k", "first")
    assert looked.exceptAll(expect).isEmpty() and expect.exceptAll(looked).isEmpty()


def test_hot_rows_are_scattered_by_the_join_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
        keyed = df.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        plan = skew.attach_per_key(df, keyed, ["k"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("hashpartitioning" in line and "__slot" in line for line in plan.splitlines())


def test_top_per_key_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    plan = skew.top_per_key(df, ["k"], [F.asc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_bucketed_rank_and_lag_equal_windows(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 4 < 3, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    ranked = skew.bucketed_rank(df, ["k"], order, [("b", F.floor(F.col("v") / 10), False)], "r")
    assert ranked.exceptAll(df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(*order)).cast("long"))).isEmpty()
    lagged = skew.bucketed_lag(df, ["k"], ["v", "id"], ["id"], F.floor(F.col("v") / 10))
    assert lagged.exceptAll(df.withColumn("prev_id", F.lag("id").over(W.partitionBy("k").orderBy("v", "id")))).isEmpty()


def test_first_per_key_leaves_one_row(spark, sf):
    r = L.results(spark, sf)
    one = skew.first_per_key(r, ["search_id", "link"], ["pos"])
    assert one.groupBy("search_id", "link").count().filter("count > 1").isEmpty()
    assert one.count() == r.select("search_id", "link").distinct().count()


def test_no_global_window_or_cross_join(spark, sf):
    """Plans of the set operators name a partition for every window and join on keys."""
    from leadloom.operators import listing

    leads = L.leads(spark, sf).withColumn("quality_score", F.lit(1))
    for df in (dedup.first_by_domain(leads), listing.ranked_within_search(leads), listing.neighbours(leads)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan


def test_filter_and_columns_reach_the_scan(spark, sf, tmp_path):
    from leadloom.sources import tables

    fixtures.view(spark, sf, "v_ledger").withColumns({"search_id": F.lit(1), "lead_id": F.lit(1), "currency": F.lit("usd")}).write.parquet(f"{tmp_path}/ledger")
    scan = tables.scan(spark, str(tmp_path), "ledger").filter("company_id = 3").select("seq")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(company_id,3)" in plan and "ReadSchema: struct<company_id:bigint,seq:bigint>" in plan


def test_write_leads_replaces_only_its_searches(spark, sf, tmp_path):
    from leadloom.sources import tables

    leads = spark.range(20).select((F.col("id") % 2).alias("search_id"), F.col("id").alias("lead_id"), F.lit("a").alias("company_name"))
    tables.write_leads(leads, str(tmp_path))
    tables.write_leads(leads.filter("search_id = 1 AND lead_id < 4").withColumn("company_name", F.lit("b")), str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/leads")
    assert back.filter("search_id = 0").count() == 10 and back.filter("search_id = 1 AND company_name = 'b'").count() == 2


def test_html_reader():
    nodes, text, ld = html_nodes.parse(
        '<ul><li>a<li>b<ul><li>c</ul></ul><p>one<p>two<br>three<script type="application/ld+json">{"x": 1}</script><style>.a{}</style>é&amp;')
    by = {}
    for n in nodes:
        by.setdefault(n["tag"], []).append(text[n["a"]:n["b"]])
    assert by["li"] == ["a", "bc", "c"] and by["p"] == ["one", "twothreeé&"] and ld == ['{"x": 1}']
    assert all(n["seq"] < n["stop"] <= len(nodes) for n in nodes)


def test_html_reader_keeps_whole_long_texts(spark):
    body = "x" * 300_000
    df = spark.createDataFrame([(1, "u", f"<p>{body}</p>")], "page_id long, url string, html string")
    assert html_nodes.read_nodes(df).select(F.length("page_text")).first()[0] == 300_000


def test_repeat_state_accepts_by_last_accepted():
    assert live.accepted_positions([0.0, 1.5, 3.0, 3.5, 5.0], None, 2.0) == ([True, False, True, False, True], 5.0)
    assert live.accepted_positions([1.0], 0.0, 2.0) == ([False], 0.0)


def test_stall_alert_fires_once(spark, tmp_path):
    import time

    src = tmp_path / "in"
    spark.createDataFrame([(1, "extracting", 3, 1), (2, "completed", 9, 9)], "search_id long, status string, extracted_count long, enriched_count long").write.parquet(str(src))
    stream = spark.readStream.schema("search_id long, status string, extracted_count long, enriched_count long").parquet(str(src))
    q = (live.stall_alerts(stream, 1.0).writeStream.outputMode("update").format("memory").queryName("alerts")
         .trigger(processingTime="500 milliseconds").start())
    try:
        end = time.time() + 40
        while time.time() < end and not spark.sql("SELECT * FROM alerts").collect():
            time.sleep(0.5)
        time.sleep(2)
        assert [tuple(r) for r in spark.sql("SELECT * FROM alerts").collect()] == [(1, 3, 1)]
    finally:
        q.stop()


def test_people_of_hashed_page_ids(spark):
    from leadloom.operators import people

    html = '<div class="team-member"><h3>Jane Miller</h3><p class="title">Chief Executive Officer</p></div>'
    pages = spark.createDataFrame([(2**63 - 5, "https://www.acme.com/team", html)], "page_id long, url string, html string")
    assert [(r["site"], r["name"]) for r in people.site_people(pages).collect()] == [("acme.com", "Jane Miller")]


def test_stream_goes_on_in_its_folder_and_takes_empty_sources(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "company_id long, seq long, delta int"
    (tmp_path / "in").mkdir()
    stream = lambda: live.running_balances(spark.readStream.schema(schema).parquet(src), 10, str(tmp_path / "kept"))
    assert stream().collect() == []
    for rows in ([(1, 1, 2), (1, 2, -1)], [(1, 3, -1), (1, 4, -1), (1, 5, 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        got = {r["seq"]: (r["balance"], r["refused"]) for r in stream().collect()}
    assert got == {1: (2, False), 2: (1, False), 3: (0, False), 4: (0, True), 5: (1, False)}


def contained(rows):
    return {(s, a, b) for s, a in rows for t, b in rows if s == t and a != b and len(a) > 3 and a in b and len(a) > 0.85 * len(b)}


def test_contained_names_of_any_length_equal_brute_force(spark):
    """Short names list their matches, long ones are found by their rarest gram; lengths around the border meet."""
    rng = random.Random(1)
    rows = set()
    for s in range(3):
        for _ in range(25):
            w = "".join(rng.choice("ab c") for _ in range(rng.choice([8, 30, 63, 64, 65, 66, 70, 90, 130, 300])))
            rows |= {(s, w), *[(s, w[rng.randrange(max(1, len(w) // 10)):len(w) - rng.randrange(max(1, len(w) // 10))]) for _ in range(3)]}
    got = [tuple(r) for r in dedup.name_matches(spark.createDataFrame(sorted(rows), "search_id int, name string"), ["search_id"]).collect()]
    want = contained(rows)
    assert len(got) == len(want) and set(got) == want and any(len(b) > dedup.LONG for _, _, b in want) and any(len(b) <= dedup.LONG for _, _, b in want)


def test_contained_names_of_thousands_of_characters(spark):
    base = "".join(random.Random(2).choice("abcdefghij klmnop") for _ in range(3000))
    rows = [(1, base[i:3000 - j]) for i in range(0, 100, 20) for j in range(0, 200, 40)]
    names = spark.createDataFrame(rows, "search_id int, name string")
    matches = dedup.name_matches(names, ["search_id"])
    assert {tuple(r) for r in matches.collect()} == contained(rows)
    start = time.perf_counter()
    matches.count()
    assert time.perf_counter() - start < 20  # a list of all substrings took 22 s for one such name


def list_page(n):
    cards = "".join(f"<li class='card item'><h3>Comp {i} Ltd</h3><a href='https://h{i}.com/x'>Visit é website {i}</a><p>Some text of number {i}</p></li>" for i in range(n))
    return f"<html><head><title>Top companies list</title></head><body><ul>{cards}</ul></body></html>"


def test_page_rules_grow_with_the_page(spark):
    """Nine times the cards take about nine times as long, not eighty-one times."""
    took = {}
    for n in (2000, 2000, 18000):
        d = spark.createDataFrame([(1, "https://list.org/directory", list_page(n))], "page_id long, url string, html string")
        start = time.perf_counter()
        row, hits = pages.page_structure(d).first(), pages.expand_directories(d).orderBy("pos").collect()
        took[n] = time.perf_counter() - start
        assert row["list_items"] == row["cards"] == n and row["profile_buttons"] == 0 and len(hits) == 30
        assert hits[7]["title"] == "Visit é website 7" and hits[7]["snippet"] == "Comp 7 LtdVisit é website 7Some text of number 7"
    assert took[18000] < 20 * took[2000]


def test_email_scan_of_long_runs(spark):
    """Five megabytes of inline data, and addresses that touch each other."""
    html = "<p>jane@acme.com</p><img src='data:image/png;base64," + "QUJDRA+" * 750_000 + "'> a@b.com-x@c.org p@q.comr@s.com bob [at] acme [dot] com"
    start = time.perf_counter()
    found = spark.createDataFrame([(html,)], "html string").select(pages.page_emails("html").alias("e")).first()["e"]
    assert [e["email"] for e in found] == ["jane@acme.com", "a@b.com", "-x@c.org", "p@q.comr", "bob@acme.com"]
    assert time.perf_counter() - start < 60


def test_similar_pairs_of_crowded_segments(spark, monkeypatch):
    """Segments that many names share make no pairs by themselves, and lose none."""
    rng = random.Random(6)
    ends = [" trading company", " trading co", "x trading company"]
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) + rng.choice(ends) for _ in range(150)})
    d = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = lambda: {tuple(r) for r in dedup.similar_pairs(d, d.withColumnRenamed("name", "other")).select("name", "other").collect()}
    whole = pairs()
    monkeypatch.setattr(dedup, "CROWD", 3)
    want = {(a, b) for a in names for b in names if 1 - edit_distance(a, b) / max(len(a), len(b)) >= 0.85}
    assert pairs() == whole == want and len(want) > len(names)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_task_has_all_pairs_of_a_segment(spark):
    """Names that share one segment, and little else, meet by a second part of the name."""
    rng = random.Random(8)
    names = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(13)) + " holding" for _ in range(20_000)}
    d = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    indexed = dedup.indexed_segments(d.select(F.col("name").alias("other")))
    assert indexed.groupBy("len", "k", "seg", "text").count().agg({"count": "max"}).first()[0] > 19_000
    near = dedup.candidate_pairs(d, d.withColumnRenamed("name", "other"))
    assert near.filter("name <> other").count() < 20_000_000 // 4


def test_lead_table_versions(spark, tmp_path):
    """Files do not grow with the searches, a commit that dies is not seen, deletes and replacements last."""
    from leadloom.sources import tables

    root, ddl = str(tmp_path / "t"), "lead_id long, search_id long, name string"
    rows = spark.range(4000).select(F.col("id").alias("lead_id"), (F.col("id") % 1000).alias("search_id"), F.lit("a").alias("name"))
    assert tables.read_leads(spark, root, ddl).collect() == []
    assert tables.commit_leads(rows, root, buckets=8) == 1
    assert len(list((tmp_path / "t/leads").rglob("*.parquet"))) == 8
    tables.delete_leads(spark, rows.filter("search_id < 10 OR search_id = 77"), root)
    tables.commit_leads(rows.filter("search_id IN (5, 500) AND lead_id < 1000").withColumn("name", F.lit("b")), root, buckets=8)
    # rows of a version that never came into force
    rows.withColumns({"version": F.lit(4).cast("long"), "bucket": F.lit(0)}).write.mode("append").partitionBy("bucket").parquet(f"{root}/leads")
    want = {(i, i % 1000, "a") for i in range(4000) if i % 1000 >= 10 and i % 1000 not in (77, 500)} | {(5, 5, "b"), (500, 500, "b")}
    assert {tuple(r) for r in tables.read_leads(spark, root, ddl).collect()} == want
    some = tables.read_leads(spark, root, ddl, spark.createDataFrame([(5,), (500,), (77,)], "search_id long"), buckets=8)
    assert {tuple(r) for r in some.collect()} == {(5, 5, "b"), (500, 500, "b")}
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString().replace("isnotnull(bucket", "[bucket")
    tables.compact_leads(spark, root, str(tmp_path / "u"), ddl, buckets=8)
    assert {tuple(r) for r in tables.read_leads(spark, str(tmp_path / "u"), ddl).collect()} == want


def test_deep_pages_equal_one_sort(spark):
    rng = random.Random(4)
    pick = lambda n: rng.choice([None, *range(n)])
    rows = [(i, pick(6), pick(6), pick(20), rng.choice([None, "", "Alpha trading", "Alpha trade", "Beta", "alpha"]), rng.randrange(5)) for i in rng.sample(range(5_000_000), 600)]
    d = spark.createDataFrame(rows, "lead_id long, quality_score int, verification_score int, signal_strength int, company_name string, day int")
    d = d.withColumn("created_at", F.timestamp_seconds(F.col("day") * 86_400 + F.col("lead_id") % 86_400)).drop("day").cache()
    for by, ascending in (("rank", False), ("quality_score", True), ("signal_strength", True), ("created_at", True), ("created_at", False), ("company_name", True), ("company_name", False)):
        whole = [r["lead_id"] for r in d.orderBy(*listing.lead_order(by, ascending)).collect()]
        for page in (1, 7, 24, 30):
            assert [r["lead_id"] for r in listing.deep_page(d, by, ascending, page, 25).collect()] == whole[(page - 1) * 25:page * 25], (by, page)
    assert listing.deep_page(d.limit(0), "rank", False, 3, 25).collect() == []


def test_team_pages_move_no_html(spark):
    d = spark.createDataFrame([(1, "https://a.com/", "<nav><a href='/team'>t</a></nav>"), (2, "http://www.a.com:8080/Team/?x", "x"), (3, None, None), (4, "https://b.org/team", "")], "page_id long, url string, html string")
    assert [tuple(r) for r in pages.team_pages(d).select("page_id", "team_page_id").collect()] == [(1, 2)]
    assert pages.team_pages(d.limit(0)).collect() == []


def test_later_sources_read_only_sites_that_need_them(spark):
    """A source sees no rows of sites that have enough people, nor rows without a site."""
    seen = []
    columns = {c: F.lit(None).cast("string") for c in ("title", "email", "source")} | {"confidence": F.lit(0.5)}

    def source(rows):
        seen.append(sorted(r["site"] for r in rows.select("site").distinct().collect()))
        return rows.select("site", F.col("n").alias("at"), F.concat(F.lit("Name "), F.col("n").cast("string")).alias("name"), *[c.alias(k) for k, c in columns.items()])
    stage = lambda rows: people.Stage(spark.createDataFrame(rows, "site string, n int"), source)
    out = people.people_in_stages([stage([("a", i) for i in range(6)] + [("b", 1), ("b", 1), (None, 3)]), stage([("a", 9), ("b", 1), ("b", 7), ("c", 2)]),
                                   stage([("c", i) for i in range(20)] + [("a", 1)])], limit=8)
    assert seen == [["a", "b"], ["b", "c"], ["c"]]
    got = sorted((r["site"], r["source_rank"], r["name"]) for r in out.collect())
    assert got == sorted([("a", 0, f"Name {i}") for i in range(6)] + [("b", 0, "Name 1"), ("b", 1, "Name 7"), ("c", 1, "Name 2")] + [("c", 2, f"Name {i}") for i in (0, 1, 3, 4, 5, 6, 7)])
