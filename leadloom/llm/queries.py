"""Registered queries of this subpackage, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm import audit, contamination, licenses, lines, mixing, quality, rules, simhash, spelling, substrings, superminhash, toxicity, urls
from leadloom.llm.shared import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query()
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query(f"""
WITH l AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     seen AS (SELECT source, unnest(list_distinct(ls)) AS line FROM l),
     t AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
     c AS (SELECT s.source, line FROM seen s JOIN t USING (source) WHERE trim(line) <> ''
           GROUP BY s.source, line, n_pages HAVING count(*) >= {lines.MIN_PAGES} AND 100 * count(*) > {lines.BOILERPLATE_PERCENT} * n_pages),
     g AS (SELECT source, list(line) AS common FROM c GROUP BY source),
     k AS (SELECT doc_id, len(ls) AS n_lines, list_filter(ls, lambda x: NOT coalesce(list_contains(common, x), FALSE)) AS kept
           FROM l LEFT JOIN g USING (source))
SELECT doc_id, CAST(n_lines AS INT) AS n_lines, CAST(n_lines - len(kept) AS INT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
""")
def op7_line_dedup(spark, sf_dir):
    out = lines.without_boilerplate(read(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_decontamination(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", contamination.summary(docs, read(spark, sf_dir, "benchmark")).alias("f"))
    return found.select("doc_id", "f.*", contamination.is_contaminated(F.col("f")).alias("contaminated"))


def _threshold_sql() -> str:
    parts = ["TRUE"]
    for r in rules.RULES:
        parts += [f"({r.base} = 0 OR {r.top} >= {r.low} * {r.base})"] * (r.low is not None)
        parts += [f"({r.base} = 0 OR {r.top} <= {r.high} * {r.base})"] * (r.high is not None)
    return " AND ".join(parts)


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
     g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
     r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
     c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
     m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                  coalesce(c.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: list_contains({rules.STOP_WORDS}, x))) AS n_stop_words,
                  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
           FROM w LEFT JOIN c USING (doc_id)),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_threshold_sql()} AS kept FROM b
""")
def op8_quality_rules(spark, sf_dir):
    return rules.judge(read(spark, sf_dir, "documents"))


@query()
def op3_quality(spark, sf_dir):
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op6_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    out = docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).select("doc_id", "s.*")
    return out.withColumn("rejected", F.col("p_toxic") >= toxicity.REJECT_AT)


def _canonical_sql(c: str) -> str:
    t = f"regexp_replace(lower(coalesce({c}, '')), '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '{licenses.NOT_WORD}', ' ', 'g')) || ' '"
    for a, b in licenses.SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t})"


def _known_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in licenses.LICENSES)


@query(f"""
WITH known AS (SELECT sha256({_canonical_sql('t')}) AS digest, min(i) AS license_id FROM (VALUES {_known_sql()}) v(i, t) GROUP BY 1),
     d AS (SELECT doc_id, text, sha256({_canonical_sql('text')}) AS digest FROM documents),
     l AS (SELECT DISTINCT doc_id, k.license_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x
           JOIN known k ON k.digest = sha256({_canonical_sql('line')})),
     n AS (SELECT doc_id, list_sort(list(license_id)) AS ids FROM l GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(array_to_string(n.ids, ','), '') AS notices, CAST(coalesce(len(n.ids), 0) AS INT) AS n_notices
FROM d LEFT JOIN known k USING (digest) LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op5_licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_texts(spark))


@query()
def op4_substring_dedup(spark, sf_dir):
    return substrings.repeated_passages(read(spark, sf_dir, "documents")).drop("spans")


@query()
def op1_url_filters(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"))


@query()
def op10_mixing(spark, sf_dir):
    out = mixing.mix(read(spark, sf_dir, "documents"), mixing.label_domains(read(spark, sf_dir, "labels")), mixing.TARGETS, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", *[F.col("posteriors")[d].alias(f"p_{d}") for d in sorted(mixing.TARGETS)], "rate")


@query(rf"""
WITH y AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
     d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
     m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < {audit.MIN_WORDS} AS INT)
                  + 2 * CAST(100 * len(list_distinct(ws)) < {audit.MIN_DISTINCT_PERCENT} * len(ws) AS INT)
                  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.MAX_CAPITALS_PERCENT} * length(t) AS INT)
                  + 8 * CAST(regexp_matches(t, '{audit.SYMBOLS}') AS INT)
                  + 16 * CAST(coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), FALSE) AS INT) AS mask
           FROM w LEFT JOIN y ON w.doc_id = y.doc_id),
     h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
     f AS (SELECT unnest(range(5)) AS f),
     o AS (SELECT [a.f, b.f, c.f, e.f, g.f] AS o FROM f a, f b, f c, f e, f g WHERE len(list_distinct([a.f, b.f, c.f, e.f, g.f])) = 5),
     s AS (SELECT o, i, o[i] AS f FROM o, (SELECT unnest(range(1, 6)) AS i)),
     r AS (SELECT o, mask, coalesce(min(i) FILTER (mask >> f & 1 = 1), 6) AS r FROM s, (SELECT unnest(range(32)) AS mask) GROUP BY o, mask),
     t AS (SELECT part, s.o, i, s.f, sum(n * CAST(r > i AS INT)) AS kept, sum(n * CAST(r = i AS INT)) AS removed,
                  sum(n * CAST(r < i AND h.mask >> s.f & 1 = 1 AS INT)) AS redundant, sum(n * CAST(h.mask = 1 << s.f AS INT)) AS unique_fails,
                  sum(good * CAST(r = i AS INT)) AS good_lost, sum(toxic * CAST(r = i AS INT)) AS toxic_lost
           FROM h JOIN r USING (mask) JOIN s ON s.o = r.o GROUP BY part, s.o, i, s.f)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, CAST(i AS INT) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM t
""")
def op11_filter_audit(spark, sf_dir):
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


@query()
def op13_superminhash(spark, sf_dir):
    return superminhash.near_duplicates(read(spark, sf_dir, "documents"))
