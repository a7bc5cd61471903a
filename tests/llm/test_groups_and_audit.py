"""The filter audit, spelling variants and SuperMinHash groups against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from leadloom.llm import audit, licenses, spelling, superminhash
from leadloom.llm.shared import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing column names."""
    rows = [(1, None, None, None, None), (None, "some text " * 9, "en", "a", 3), (None, "some text " * 9, "en", "a", 3), (2, "", "en", "a", 0),
            (3, " \n\t ", "en", None, 4), (5, "a b c d e f # g", "en", "b", 1), (5, "a b c d e f # g", "en", "b", 1), (-8, "a b c d e f # g", "fr", "", 1),
            (6, "WORD " * 30000, "en", "b", 1), (7, "A" * 20000 + " x", "en", "b", 1), (8, "a" * 20000 + " " + "a" * 19999, "en", "b", 1), (5, "another text", "en", "b", 1)]
    d = spark.createDataFrame(rows, DOCS)
    clash = ["n", "word", "words", "digest", "mask", "good", "set", "slots", "bands", "key", "own", "row", "root", "component_id", "slot", "part", "step"]
    return d.withColumns({c: d["lang"] for c in clash})


@pytest.fixture(scope="module")
def awkward_labels(spark):
    return spark.createDataFrame([(5, 0, 1), (5, 1, None), (None, 1, 1), (7, None, 1), (6, 1, 0), (99, 1, 1)], LABELS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]


def brute_audit(docs, labels):
    lowest = {}
    for i, t, _ in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(Counter)
    for i, t, part in docs:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": bool(set(t) & set("#$%&*|")), "E": i is not None and lowest[t] < i}
        for order in permutations("ABCDE"):
            at = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                c = out[part or "", "".join(order), k + 1]
                c["kept"] += at > k
                c["removed"] += at == k
                c["redundant"] += fails[f] and at < k
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += at == k and i in good
                c["toxic_lost"] += at == k and i in toxic
    for (part, order, k), c in out.items():
        c["shapley"] = sum(out[part, "".join(o), o.index(order[k - 1]) + 1]["removed"] for o in permutations("ABCDE"))
    return {(*key, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))) for key, c in out.items()}


def test_audit_on_awkward_tables(awkward, awkward_labels, empty):
    got = [tuple(r) for r in audit.audit(awkward, awkward_labels).collect()]
    want = brute_audit(plain(awkward, "doc_id", "text", "source"), plain(awkward_labels, "doc_id", "quality", "toxic"))
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == want
    assert audit.audit(empty, awkward_labels).collect() == []
    assert sum(r["good_lost"] + r["toxic_lost"] for r in audit.audit(awkward, awkward_labels.limit(0)).collect()) == 0


def test_removal_steps():
    orders, positions, steps = audit.removal_steps(3)
    assert steps.shape == (6, 8) and np.isinf(steps[:, 0]).all()
    for o, order in enumerate(orders):
        for mask in range(1, 8):
            assert steps[o, mask] == 1 + min(k for k, f in enumerate(order) if mask >> f & 1)


def test_audit_in_small_batches(spark, monkeypatch):
    """Parts that are worked out a few at a time give the same rows."""
    counts = spark.createDataFrame([(f"p{i % 7}", i % 4, i, 0, 1) for i in range(28)], "part string, mask int, n long, good long, toxic long")
    whole = Counter(map(tuple, audit.interactions(counts, "AB").collect()))
    batches = [audit._tables(b, "AB") for b in counts.groupBy("part").agg({"mask": "max"}).limit(0).toArrow().to_batches()]
    assert sum(whole.values()) == 7 * 4 and batches == batches
    by_part = {p: r for p, o, s, *r in whole if (o, s) == ("AB", 1)}
    for p in range(7):
        own = [(i % 4, i) for i in range(28) if i % 7 == p]
        assert by_part[f"p{p}"][:2] == [sum(n for m, n in own if not m & 1), sum(n for m, n in own if m & 1)]


def brute_counts(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(n):
    at_hand = defaultdict(set)
    for w in n:
        for k in range(len(w) + 1):
            at_hand[w[:k] + w[k + 1:]].add(w)
    near = {w: {x for k in range(len(w) + 1) for x in at_hand[w[:k] + w[k + 1:]] if one_edit(w, x)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_variants(docs):
    want = brute_variants(brute_counts(plain(docs, "doc_id", "text")))
    got = [tuple(r) for r in spelling.variants(docs).collect()]
    assert len(got) == len(want) and set(got) == want and any(x[1] for x in want)


@pytest.mark.parametrize("letters, share", [("ab", 4096), ("abcdefghijklmnopq", 2), ("aàÿ×z", 4096)])
def test_variants_of_random_words(spark, monkeypatch, letters, share):
    """Few letters make many near words, chains of forms and ties; nodes that many words share are dealt out."""
    monkeypatch.setattr(spelling, "SHARE", share)
    rng = random.Random(5)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(150)}
    for w in list(words):
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w + letters[0], letters[-1] + w}
    n = {w: rng.choice([2, 3, 25, 300, 300, 4000]) for w in words if len(w) >= 7}
    got = {tuple(r) for r in spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == brute_variants(n)


def test_variants_on_awkward_tables(spark, awkward, empty):
    assert spelling.variants(empty).collect() == []
    assert {tuple(r) for r in spelling.variants(awkward).collect()} == brute_variants(brute_counts(plain(awkward, "doc_id", "text")))
    long = "q" * 3000 + "".join(chr(97 + i % 26) for i in range(3000))
    n = {long: 50, long[:4000] + "x" + long[4000:]: 2, long[:10] + long[11:]: 3, long[::-1]: 2}
    assert {tuple(r) for r in spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()} == brute_variants(n)


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_groups(rows):
    """(doc_id, n_shingles, component_id, kept) per row."""
    s = shingle_sets(rows)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = defaultdict(list)
    for k, (_, own) in enumerate(s):
        both = Counter(j for g in own for j in holders[g])
        for j, c in both.items():
            if 100 * c >= 85 * (len(own) + len(s[j][1]) - c):
                root[find(k)] = find(j)
        for g in own:
            holders[g].append(k)
    low = {}
    for k, (i, _) in enumerate(s):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return Counter((i, len(own), low.get(find(k)), i == low.get(find(k))) for k, (i, own) in enumerate(s))


def drifting():
    """Chains of near copies, and texts that share most of their words but seldom link."""
    rng, rows = random.Random(3), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(80 + 20 * g)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10 ** 6)}"
            rows.append(" ".join(own))
        tail = [f"g{g}t{k}" for k in range(60)]
        rows += [" ".join(tail + [f"u{len(rows)}.{j}.{k}" for k in range(rng.choice([3, 6, 9, 15]))]) for j in range(25)]
    rows += ["one two", "ONE  two", "one two three four five", None, "", " \n"]
    return list(enumerate(rows))


@pytest.mark.parametrize("rounds, block", [(superminhash.HEAD_ROUNDS, superminhash.BLOCK), (0, 7), (3, 16)])
def test_groups(spark, rounds, block):
    rows = drifting()
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds, block=block)
    want = brute_groups(rows)
    assert Counter(map(tuple, got.collect())) == want and 10 < sum(not r[3] for r in want) < 200


def test_groups_of_documents(docs):
    assert Counter(map(tuple, superminhash.near_duplicates(docs).collect())) == brute_groups(plain(docs, "doc_id", "text"))


def test_groups_on_awkward_tables(awkward, empty):
    assert superminhash.near_duplicates(empty).collect() == []
    assert Counter(map(tuple, superminhash.near_duplicates(awkward).collect())) == brute_groups(plain(awkward, "doc_id", "text"))


def test_signatures_estimate_similarity():
    """Agreeing slots estimate the similarity with less variance than independent slots; sets of any size stop early."""
    rng = np.random.RandomState(2)
    errors = []
    for trial in range(60):
        pool = rng.randint(1, 1 << 62, 130, dtype=np.int64).astype(np.uint64)
        a, b = pool[:115], pool[15:]
        h = superminhash.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        errors.append((h[0] == h[1]).mean() - 100 / 130)
    independent = (100 / 130) * (30 / 130) / superminhash.SLOTS
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < independent
    one = superminhash.signatures(np.zeros(1, int), np.array([7], np.uint64), 1)
    assert sorted((one[0] >> np.uint64(56)).tolist()) == list(range(superminhash.SLOTS))


def test_notices_stay_in_their_row(spark):
    """Rows of one id, or of none, do not share notices."""
    mit, cc = (next(t for i, t in licenses.LICENSES if i == name and "\n" not in t) for name in ("MIT", "CC-BY-4.0"))
    rows = [(None, "hello there"), (None, f"text\n{mit}"), (7, "plain words"), (7, f"{cc}\nmore"), (7, f"{cc}\nmore"), (8, None)]
    got = Counter((r["doc_id"], r["notices"], r["n_notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_texts(spark)).collect())
    assert got == Counter([(None, "", 0), (None, "MIT", 1), (7, "", 0), (7, "CC-BY-4.0", 1), (7, "CC-BY-4.0", 1), (8, "", 0)])
