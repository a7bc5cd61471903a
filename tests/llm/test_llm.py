"""Operators of leadloom.llm against brute force, SQL and held-out labels, and on awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import contamination, fmindex, licenses, lines, mixing, queries, quality, rules, shared, simhash, similar, substrings, toxicity, urls
from leadloom.llm.components import components
from leadloom.llm.shared import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark, sf):
    return read(spark, sf, "labels")


@pytest.fixture(scope="module")
def items(spark, sf):
    return read(spark, sf, "benchmark")


PASSAGE = " ".join(f"w{i}" for i in range(45))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing column names."""
    rows = [
        (1, None, None, None, None), (None, "text without an id " * 8, "en", "a", 3), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4),
        (4, f"x {PASSAGE} y", "en", "a", 1), (5, f"{PASSAGE} z", "en", "a", 1), (5, f"{PASSAGE} z", "en", "a", 1), (6, "word " * 30000, "en", "b", 1),
        (7, "one\n\n\ntwo", "en", "b", 1), (-8, f"{PASSAGE} z", "fr", "b", 1),
    ]
    d = spark.createDataFrame(rows, DOCS)
    clash = ["fp", "fingerprint", "rate", "__common", "__kept", "component_id", "words", "score", "hits", "__t", "__id", "site", "lines", "n_words"]
    return d.withColumns({c: F.lit("own") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_fingerprint(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash(docs, texts, crowd):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = {(i, f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}
    assert {tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd).collect()} == want


def test_simhash_links_at_four_bits(spark):
    rng = np.random.RandomState(1)
    base = rng.randint(-1 << 62, 1 << 62, 40)
    fps = {int(b) for b in base}
    for b in base:
        for k in (1, 3, 4, 5):
            flip = sum(1 << int(x) for x in rng.choice(63, k, replace=False))
            fps.add(int(b) ^ flip)
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert set(got) == want and len(got) == len(want)


def brute_passages(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            g = tuple(w[k:k + 20])
            gone.update(range(k, k + 20) if g in seen else ())
            seen.add(g)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [substrings.CROWD, 2])
def test_substrings(docs, texts, crowd):
    got = substrings.repeated_passages(docs, crowd=crowd, shard_segments=500)
    assert {r[0]: tuple(r)[1:4] for r in got.collect()} == brute_passages(texts)


def test_substrings_periodic(spark):
    texts = {1: "a b c " * 50, 2: "x " + "a b c " * 20, 3: "q " * 70, 4: "q " * 25 + "r", 5: None, 6: ""}
    got = substrings.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r[0]: tuple(r)[1:4] for r in got.collect()} == brute_passages(texts)


def test_substrings_of_repeated_rows(spark):
    """A passage that only repeated rows of one document hold stays in them; a repeat within the document goes."""
    own, twice, shared = (" ".join(f"{c}{i}" for i in range(30)) for c in "ots")
    rows = [(1, own), (1, own), (2, f"{twice} . {twice}"), (2, f"{twice} . {twice}"), (3, shared), (3, shared), (4, shared)]
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 30), (2, 30), (3, 0), (3, 0), (4, 30)]


def test_fm_index():
    rng = np.random.RandomState(2)
    text = np.append(rng.randint(1, 5, 400), 0)
    index = fmindex.FMIndex(text, 3)
    patterns = np.stack([text[i:i + 3] for i in range(397)] + [np.array([4, 9, 9])[[0, 0, 0]]])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        assert sorted(index.suffixes[a:b]) == [i for i in range(len(text) - 2) if (text[i:i + 3] == p).all()]


@pytest.mark.parametrize("limit", [contamination.ITEM_BYTES, 500])
def test_contamination(docs, texts, items, limit):
    def norm(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = {}
    for i, t in items.collect():
        w = norm(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            own.setdefault(tuple(w[k:k + 13]), set()).add(str(i))
    want = {}
    for d, t in texts.items():
        w, hit, found = norm(t), set(), set()
        for n in {len(g) for g in own}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in own:
                    hit.update(range(k, k + n))
                    found |= own[tuple(w[k:k + n])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    got = docs.select("doc_id", contamination.summary(docs, items, limit=limit).alias("f")).select("doc_id", "f.*").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and any(v[1] for v in want.values())
    for r in contamination.find_passages(docs, items).filter("size(hits) > 0").collect():
        for h in r["hits"]:
            assert len(norm(texts[r["doc_id"]].encode()[h["first_byte"]:h["end_byte"]].decode())) == h["end_word"] - h["first_word"]


def test_contamination_without_item_id(spark):
    """Passages of items without an id are hits; only ids that are known are counted."""
    a, b = (" ".join(f"{c}{i}" for i in range(15)) for c in "ab")
    d = spark.createDataFrame([(1, f"x {a} y {b}"), (2, b)], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, "z1 z2"), (None, None), ("k", None), ("k", b), (None, b)], "item_id string, text string")
    got = d.select("doc_id", contamination.summary(d, items).alias("f")).select("doc_id", "f.*").collect()
    assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in got} == {i: (n, 1, hashlib.sha256(b"k").hexdigest()) for i, n in ((1, 30), (2, 15))}
    assert {(h["item_id"], h["first_word"]) for r in contamination.find_passages(d, items).filter("doc_id = 1").collect() for h in r["hits"]} == {(None, 1), (None, 17), ("k", 17)}


def test_quality_held_out(docs, labels):
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    test = [(got[i]["predicted"], q) for i, q, _ in labels.collect() if got[i]["held_out"]]
    assert sum(p == q for p, q in test) >= 0.9 * len(test)


def test_toxicity(spark):
    rng = np.random.RandomState(5)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = rng.choice(vocabulary, 60).tolist()
        n = int(rng.randint(1, 4)) if i % 5 == 0 else 0
        rows.append((i, " ".join(w + rng.choice(["vile", "nasty", "awful"], n).tolist())))
        marks.append((i, int(n > 0)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(d, y, rows=400)
    got = {r[0]: r[1] for r in d.select("doc_id", toxicity.severity(model, F.col("text"))).collect()}
    assert all((got[i]["p_toxic"] >= toxicity.REJECT_AT) == bool(t) for i, t in marks)
    assert all(-1e-9 <= r["severity"] <= toxicity.GRADES - 1 for r in got.values()) and list(model.thresholds) == sorted(model.thresholds)


def test_rates_match_targets(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    out = mixing.mix(docs, mixing.label_domains(labels), mixing.TARGETS, keep=["doc_id"]).collect()
    total = sum(r["n_tokens"] for r in out)
    for k, share in mixing.TARGETS.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r["posteriors"][k] for r in out) / total - share) < 1e-4
    assert min(r["rate"] for r in out) >= 0
    known = {r[0]: r[1] for r in mixing.label_domains(labels).collect()}
    right = [max(r["posteriors"], key=r["posteriors"].get) == known[r["doc_id"]] for r in out if r["doc_id"] in known]
    assert sum(right) >= 0.85 * len(right)


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://WWW.Example.com/en/x?y", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"), ("http://a.com/b", "a.com", "/b", "com/", "allow"),
    ("http://a.com?b", "a.com", "", None, "allow"), ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"), ("http://x.net/FR/", "x.net", "/FR/", None, "allow"),
    ("x.net/fr/", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://xcom/a", "xcom", "/a", None, "allow"), ("", "", "", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    r = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert tuple(r)[:5] == (1, host, path, rule, verdict)


def test_url_templates(spark):
    rows = [(f"h.org/spam/{i}", "block") for i in range(30)] + [(f"h.org/spam/{i}", None) for i in range(30, 40)]
    rows += [(f"h.org/news/{i}", "allow") for i in range(30)] + [(f"h.org/tag-{chr(97 + i % 26)}{chr(97 + i // 26)}/", None) for i in range(60)]
    rows += [("h.org/a/b/c/d/e/f", None)]
    p = spark.createDataFrame([(f"http://{u}", y) for u, y in rows], "url string, label string")
    p = p.select(urls.host_of(F.col("url")).alias("host"), urls.segments(urls.path_of(F.col("url"))).alias("segments"), "label")
    got = {(r["template"], r["n_pages"], r["n_blocked"], r["n_allowed"]) for r in urls.templates(p).collect()}
    assert ("/*", 60, 0, 0) in got and sum(x[1] for x in {(t, n) for t, n, *_ in got}) == len(rows)
    assert any(b == 30 for _, _, b, _ in got)


def test_license_spellings(spark):
    d = spark.createDataFrame([
        (1, "Copyright (c) 2020 Someone\n" + licenses.LICENSES[0][1].upper()), (2, "text\nRELEASED under the MIT licence!\nmore"), (3, None), (4, "mit"),
    ], "doc_id long, text string")
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan(d, licenses.known_texts(spark)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}


def test_rules_on_repeats(spark):
    d = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(8)) * 1 + " x " + " ".join(f"a{i}" for i in range(8))), (2, "z " * 20), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in rules.judge(d).collect()}
    assert got == {1: (17, 16, True), 2: (20, 20, True), 3: (0, 0, True)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(cur.fetchall())


OPERATORS = {
    "simhash": lambda d, y, b: simhash.near_duplicates(d), "quality": lambda d, y, b: quality.score_documents(d, y),
    "substrings": lambda d, y, b: substrings.repeated_passages(d), "licenses": lambda d, y, b: licenses.scan(d, licenses.known_texts(d.sparkSession)),
    "lines": lambda d, y, b: lines.without_boilerplate(d), "rules": lambda d, y, b: rules.judge(d),
    "contamination": lambda d, y, b: contamination.find_passages(d, b), "mixing": lambda d, y, b: mixing.mix(d, mixing.label_domains(y), mixing.TARGETS),
    "urls": lambda d, y, b: urls.judge(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")),
    "toxicity": lambda d, y, b: d.select("doc_id", toxicity.severity(toxicity.train(d, y), F.col("text")).alias("s")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_tables(name, awkward, empty, labels, items):
    run = OPERATORS[name]
    assert Counter(r[0] for r in run(awkward, labels, items).select("page_id" if name == "urls" else "doc_id").collect()) == Counter([1, None, 2, 3, 4, 5, 5, 6, 7, -8])
    assert run(empty, labels, items).collect() == []
    run(awkward, labels.limit(0), items.limit(0)).collect()


def test_awkward_passages(awkward):
    got = {r["doc_id"]: r["n_removed"] for r in substrings.repeated_passages(awkward).collect()}
    assert got == {1: 0, None: 0, 2: 0, 3: 0, 4: 45, 5: 46, 6: 29999, 7: 0, -8: 0}


def test_awkward_groups(awkward):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(awkward).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == got[-8] == -8
    assert sorted(r["doc_id"] for r in simhash.one_per_group(awkward.filter("doc_id IS NOT NULL")).collect()) == sorted({min(k for k in got if k is not None and got[k] == c) for c in got.values() if c is not None})


def test_groups_without_ids(spark):
    """One row stays per group: of the smallest id, or of no id if the group has none."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (4, c), (5, d), (5, d), (5, a[::-1]), (None, None), (None, " ")]
    got = simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter([(None, a), (None, b), (3, c), (5, d), (5, a[::-1])])
    assert Counter(tuple(r) for r in got if (r["text"] or "").strip()) == want and len(got) == 6


def test_stage_links_similar_texts(spark, sf):
    """Of texts with five-word Jaccard similarity from 0.8 one stays, also where fingerprints differ in more than 4 bits."""
    rng, base = np.random.RandomState(4), [[f"t{k}w{i}" for i in range(100)] for k in range(12)]
    rows = [(100 * k + j, [f"x{k}.{j}.{i}" if i in set(rng.choice(100, j, replace=False)) else w for i, w in enumerate(b)]) for k, b in enumerate(base) for j in (0, 1, 2, 4, 9)]
    rows += [(2000 + i, w) for i, w in enumerate([["one", "two"], ["ONE", "two"], ["three"]])]
    grams = {i: {tuple(x.lower() for x in w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in rows}
    fps, root = {i: brute_fingerprint(" ".join(w)) for i, w in rows}, {i: i for i, _ in rows}
    far = 0
    for a in grams:
        for b in grams:
            close = 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])
            far += a < b and close and (fps[a] ^ fps[b]).bit_count() > 4
            if a < b and (close or (fps[a] ^ fps[b]).bit_count() <= 4):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    d = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in rows], DOCS)
    assert far and sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, sf).collect()) == sorted(set(root.values()))
    marked = d.select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("key"), similar.sketches(F.col("text")).alias("s"))
    whole, dealt = ({tuple(r) for r in components(similar.links(d, "text", marked, block=n)).collect()} for n in (similar.BLOCK, 2))
    assert whole == dealt


@pytest.fixture
def many_tasks(spark):
    """Partitions stay as they are dealt, so that a test sees which rows meet in a task."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_fingerprint_is_many_tasks(spark, many_tasks):
    """A text that a third of the rows share does not bring them into one task."""
    rows = [(i, "one text of many copies" if i % 3 == 0 else f"a{i} b{i} c{i} d{i} e{i}") for i in range(3000)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 500 and sum(r["count"] for r in tasks) == 3000
    assert out.filter("component_id = 0").count() == 1000


def test_copies_of_a_text_stay_where_they_are(spark, monkeypatch):
    """Also where the chosen rows are not broadcast, one row per set gives its text, of a smallest id."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(50)] + [(None, " ".join(base))] * 3
    rows += [(100 + i, " ".join(base[:-1] + [f"z{i % 3}"])) for i in range(9)] + [(200, "some thing else of six words")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_per_group(d, shingled=True).collect()) == [0, 200]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_tables(k, spark, sf, awkward, empty):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, awkward, sf)
    out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == awkward.columns
    assert stage(spark, empty, sf).collect() == []


def test_pipeline(spark, sf, docs, texts, labels, items):
    """Each stage decides as its operator does, and the whole leaves only rows that every stage keeps."""
    toxic = {r["doc_id"] for r in docs.select("doc_id", toxicity.severity(toxicity.train(docs, labels), F.col("text")).alias("s")).filter(f"s.p_toxic >= {toxicity.REJECT_AT}").collect()}
    out = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "n_tokens", "posteriors", "rate"] and not toxic & set(kept) and kept
    fps = {i: brute_fingerprint(r["text"]) for i, r in kept.items()}
    assert all(c == i for i, c in brute_components(fps).items())
    left = spark.createDataFrame([(i, r["text"]) for i, r in kept.items()], "doc_id long, text string")
    assert contamination.without_contaminated(left, items).count() == len(kept)
