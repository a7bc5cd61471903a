"""Template trees and mixing against plain Python over collected rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import mixing, similar, urls
from leadloom.llm.components import components
from leadloom.llm.shared import checkpointed, read


def plain_parts(path):
    s = [x for x in path.split("/") if x]
    s = [re.sub("[0-9]+", "<n>", re.sub(r"[0-9a-fA-F]{12,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "<x>", x)) for x in s]
    return (*s[:urls.DEPTH], "**") if len(s) > urls.DEPTH else tuple(s)


def plain_templates(pages):
    """{(host, parts): (template, purity)} of pages (host, parts, label), node by node."""
    n, bad, good = Counter(), Counter(), Counter()
    for host, parts, label in pages:
        k = (host, parts)
        n[k], bad[k], good[k] = n[k] + 1, bad[k] + (label == "block"), good[k] + (label == "allow")
    at = {k: "" for k in n}
    for level in range(urls.DEPTH + 1):
        nodes = defaultdict(lambda: defaultdict(list))
        for (host, parts), t in at.items():
            if len(parts) > level:
                nodes[host, t][parts[level]].append((host, parts))
        for children in nodes.values():
            sums = {c: tuple(sum(x[k] for k in ks) for x in (n, bad, good)) for c, ks in children.items()}
            known = {c: (b, b + g) for c, (_, b, g) in sums.items() if b + g}
            thin = len(sums) > urls.MAX_CHILDREN and sum(v[0] for v in sums.values()) < urls.FEW * len(sums)
            for c, ks in children.items():
                name = c
                if c in known and len(known) > 1:
                    b, m = known[c]
                    share = sum(x for x, _ in known.values()) / sum(x for _, x in known.values())
                    if abs(b / m - share) <= urls.ERRORS * math.sqrt(max(share * (1 - share), 0.0) / m) + 1e-9:
                        name = "+"
                for k in ks:
                    at[k] += "/" + ("*" if thin else name)
    b, m = Counter(), Counter()
    for k, t in at.items():
        b[k[0], t] += bad[k]
        m[k[0], t] += bad[k] + good[k]
    return {k: (t, (b[k[0], t] + 0.5 * urls.SMOOTH) / (m[k[0], t] + urls.SMOOTH)) for k, t in at.items()}


def plain_judge(rows):
    out, pages = [], []
    for i, url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, label = max(fits, default=(0, None, None))
        pages.append((host, plain_parts(path), label))
        out.append((i, host, path, rule, label))
    tree = plain_templates(pages)
    return [(i, h, p, r, y or ("block" if tree[k[:2]][1] >= urls.REJECT_AT else "allow"), *tree[k[:2]]) for (i, h, p, r, y), k in zip(out, pages)]


def same_rows(got, want):
    key = lambda r: tuple(map(repr, r[:6]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_url_filters_equal_plain_tree(spark, size):
    pages = read(spark, f"/root/testdata/{size}", "pages")
    same_rows(urls.judge(pages).collect(), plain_judge([tuple(r) for r in pages.select("page_id", "url").collect()]))


def test_url_filters_where_the_tree_decides(spark):
    """Nulls, repeats, deep paths, thin children, and a host whose unlabelled pages are below blocked ones."""
    rows = [(1, None), (None, "http://a.net/es/1"), (2, ""), (2, ""), (3, "http://a.com/x"), (3, "http://a.com/x"), (4, "http://b.org/1/2/3/4/5/6/7")]
    rows += [(10 + i, f"http://c.net/{lang}/{i % 7}/p{i}") for i in range(60) for lang in ("es", "fr", "de")]
    rows += [(100 + i, f"http://d.org/{'abcdefgh'[i % 8]}{'xyzuvw'[i % 6]}q{'kl'[i % 2]}/") for i in range(90)]
    rows += [(300 + i, f"http://m.example.com/{'en' if i % 3 else 'fr'}/{'ab'[i % 2]}") for i in range(40)]
    want = plain_judge(rows)
    assert {"allow", "block"} == {r[4] for r in want} and any("*" in r[5] for r in want) and any("+" in r[5] for r in want)
    same_rows(urls.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(5)).collect(), want)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def plain_words(t):
    return [w for w in re.split(mixing.BLANKS, t.lower()) if w]


def plain_seen(t):
    w = plain_words(t)
    marks = [(10 * len(re.findall("[#*$%&|<>]", t)) > len(w), "\x01symbols"), (10 * t.count("!") > len(w), "\x01calls"), (len(set(w)) < 0.3 * len(w), "\x01repeats")]
    return set(w) | {m for holds, m in marks if holds}


def test_mixing_equals_plain_posteriors(spark, sf):
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    domain = {r["doc_id"]: r["domain"] for r in mixing.label_domains(labels).collect() if r["doc_id"] in texts}
    names = sorted(mixing.TARGETS)
    model = mixing.fit_classifier(docs, mixing.label_domains(labels), names)
    size = Counter(domain.values())
    held = Counter((domain[i], w) for i in domain for w in plain_seen(texts[i]))
    assert model.weights
    for w, v in model.weights.items():
        p = [(held[k, w] + 0.5) / (size[k] + 1) for k in names]
        assert np.allclose(v, [math.log(x / (1 - x)) for x in p])
    extra = [(-1, None), (-2, ""), (-3, " .,! "), (-4, "####### !!!!!! a"), (-5, "again " * 500), (-5, "again " * 500), (None, "no id")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = mixing.mix(table, mixing.label_domains(labels), mixing.TARGETS).collect()
    assert len(got) == len(texts) + len(extra)
    for r in got:
        t = r["text"] or ""
        score = np.array(model.base) + sum((np.array(model.weights[w]) for w in plain_seen(t) if w in model.weights), np.zeros(len(names)))
        want = np.exp(score - score.max())
        assert r["n_tokens"] == len(plain_words(t)) and r["rate"] >= 0
        assert np.allclose([r["posteriors"][k] for k in names], want / want.sum(), atol=1e-9)
    tokens, p = np.array([r["n_tokens"] for r in got], float), np.array([[r["posteriors"][k] for k in names] for r in got])
    off = (np.array([r["rate"] for r in got]) * tokens) @ p / tokens.sum() - [mixing.TARGETS[k] for k in names]
    assert np.linalg.norm(off) <= mixing.TOLERANCE * 1.01


def similar_pairs(texts, top=4, base=5):
    """All pairs of ids whose sets of five-word shingles have an intersection of at least top / base of the union.

    Of the rarest shingles of a set, one more than the similarity lets it miss, each similar set holds one.
    """
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda x: x.group().lower(), t or "").encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    n = Counter(g for s in sets.values() for g in s)
    index, out = defaultdict(list), set()
    for i, s in sets.items():
        first = sorted(s, key=lambda g: (n[g], g))[:len(s) - -(-top * len(s) // base) + 1]
        for j in {j for g in first for j in index[g]}:
            if base * len(s & sets[j]) >= top * len(s | sets[j]):
                out.add((j, i))
        for g in first:
            index[g].append(i)
    return out


def linked_share(docs):
    """(linked, all) of the similar pairs of whole ``docs``: recall of the pipeline's search for similar texts."""
    marked = checkpointed(docs.select("doc_id", F.col("doc_id").alias("node"), F.xxhash64("text").alias("key"), similar.sketches(F.col("text")).alias("s")))
    root = {r["node"]: r["root"] for r in components(similar.links(docs, "text", marked, doc_id="doc_id")).collect()}
    pairs = similar_pairs({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    return sum(root.get(a, a) == root.get(b, b) for a, b in pairs), len(pairs)


def test_recall_of_similar_texts(spark):
    linked, pairs = linked_share(read(spark, "/root/testdata/sf0.01", "documents"))
    assert linked == pairs > 0
