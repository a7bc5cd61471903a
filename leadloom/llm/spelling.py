"""Groups of spelling variants: words one edit apart, found by walking tries level by level.

1. Words with their counts. A word is walked in two tries, one of words and one of reversed words. One edit leaves one
   half of a word as it is, so each trie is rooted below the first ``MIN_LETTERS // 2`` letters and edits are only
   allowed in the second half of the word that walks it. No state fans out over the crowded first levels.
2. Nodes of a trie are prefixes, known by a rolling hash. A node stays where words branch or end; the letters between
   two such nodes are the label of an edge, so the number of levels is that of the branches on a path, not of letters.
3. The frontier holds (word, position, node, edits). Each level joins it with the edge table and keeps what the label
   allows with one edit at most. States that have used their edit and end at a word's node are neighbours.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.shared import checkpointed, stored
from leadloom.llm.words import hashes

RUN = "[A-Za-zÀ-ÿ]"
MIN_LETTERS, MIN_COUNT = 7, 2
#: A word is a variant of its near word of largest count if that has this many times its own count.
TIMES = 10
#: One in so many (document, word) pairs is taken with a letter left out.
DAMAGED = 31
#: Words below a node for each copy of its edges: states at a node that more words share are dealt to several tasks.
SHARE = 4096


def _damaged(doc_id: Column, run: Column) -> Column:
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n) of words of at least ``min_letters`` letters and two occurrences in all texts.

    Runs of fewer letters cannot become such words, so they are not taken out of the text at all.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN}{{{min_letters},}})")))
    runs = docs.select(F.col(doc_id).alias("doc_id"), run.alias("run"))
    lower = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = runs.select("doc_id", lower.otherwise(F.lower("run")).alias("run")).select(_damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _prefixes(words: pa.Array, root: int) -> pa.Array:
    """For each prefix of at least ``root`` letters: its hash and the letter behind it, -1 behind the whole word."""
    text = words.cast(pa.large_string())
    data = np.frombuffer(b"".join(w.as_buffer().to_pybytes() for w in text), np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    letters = np.append(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32), -1)
    size = np.asarray(pa.compute.utf8_length(text)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    n = np.maximum(size - root + 1, 0)
    word = np.repeat(np.arange(len(size)), n)
    depth = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + root
    at = first[word] + depth
    h = hashes(data, starts[first[word]], starts[at])
    following = np.where(depth == size[word], -1, letters[at])
    pairs = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(following)], ["h", "following"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pairs)


def _directed(words: DataFrame, root: int) -> DataFrame:
    """(id, word, back, prefixes) of each word, forwards and backwards.

    Hashes differ between directions, so both tries lie in one table. The id is the hash of the whole word.
    """
    both = words.select(F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("word")),
                                          F.struct(F.lit(True).alias("back"), F.reverse("word").alias("word")))).alias("w")).select("w.*")

    @F.arrow_udf("array<struct<h: long, following: int>>")
    def prefixes(w: pa.Array) -> pa.Array:
        return _prefixes(w, root)
    rows = both.withColumn("prefixes", prefixes("word"))
    return rows.select(_turned(F.element_at("prefixes", -1)["h"]).alias("id"), "word", "back", "prefixes")


def _turned(h: Column) -> Column:
    return F.when(F.col("back"), F.bitwise_not(h)).otherwise(h)


def tries(words: DataFrame, root: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, starts, ends) of both tries.

    edges: node, slot, label, child, ends (a word ends at the child), following (letters that go on from the child),
    spread (of the child). A node that many words share has its edges once per slot. starts: word, back, i, node,
    spread: the last node of the word's own path in its first half. ends: node, near: the words by the nodes they end at.
    """
    directed = stored(_directed(words, root), "directed")
    paths = directed.select("id", "back", F.posexplode("prefixes").alias("depth", "p")).select(
        "id", (F.col("depth") + root).alias("depth"), _turned(F.col("p.h")).alias("h"), F.col("p.following").alias("following"))
    kinds = paths.groupBy("h").agg(F.min("depth").alias("d"), F.count("*").alias("n"), F.min("following").alias("low"), F.max("following").alias("high"))
    kept = kinds.filter(f"d = {root} OR low <> high OR low = -1").select(
        "h", F.ceil(F.col("n") / SHARE).cast("int").alias("spread"), (F.col("low") == -1).alias("ends"))
    own = paths.select("id", "depth", "h").join(kept, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "h", "spread", "ends"))).alias("path"))
    own = stored(own.join(directed.select("id", "word", "back"), "id"), "paths")
    steps = own.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(
        F.get("path", k - 1).alias("a"), F.get("path", k).alias("b")))).alias("e"))
    label = F.substring("word", F.col("e.a.depth") + 1, F.col("e.b.depth") - F.col("e.a.depth"))
    edges = steps.select(F.col("e.a.h").alias("node"), F.col("e.b.h").alias("child"), label.alias("label"), F.col("e.a.spread").alias("copies"),
                         F.col("e.b.spread").alias("spread"), F.col("e.b.ends").alias("ends"))
    edges = stored(edges.groupBy("node", "child").agg(*[F.first(c).alias(c) for c in ("label", "copies", "spread", "ends")]), "edges")
    letters = edges.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_set(F.substring("label", 1, 1))).alias("following"))
    edges = edges.join(letters, "child", "left").withColumn("following", F.coalesce("following", F.lit("")))
    edges = edges.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    start = F.element_at(F.filter("path", lambda p: p["depth"] <= F.floor(F.length("word") / 2)), -1)
    starts = own.withColumn("s", start).select("word", "back", F.col("s.depth").alias("i"), F.col("s.h").alias("node"), F.col("s.spread").alias("spread"))
    return stored(edges, "edges"), starts, directed.select(F.col("id").alias("node"), F.col("word").alias("near"))


def _advanced(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """States behind every edge that the words can pass with one edit at most.

    A pair is found from one of its words: from the longer one, which has a letter more than the label, or from the
    one with the smaller letter where both differ. Before the first half of the word ends, letters must agree, so an
    edit is only looked for where the label reaches beyond it. A state stays if the child has the word's next letter,
    or a word that ends there.
    """
    slot = F.pmod(F.xxhash64("word"), F.col("spread")).cast("int")
    fixed = F.greatest(F.floor(F.length("word") / 2) - F.col("i"), F.lit(0)).cast("int")
    letter = lambda c, k: F.substring(c, k, 1)
    f = frontier.select("word", "back", "i", "node", "edits", slot.alias("slot"), fixed.alias("fixed"), (F.length("word") - F.col("i")).alias("left"),
                        F.substring("word", F.col("i") + 1, F.length("word")).alias("rest"))
    f = f.withColumns({"c1": letter("rest", 1), "c2": letter("rest", 2)}).alias("f")
    e = edges.withColumns({"width": F.length("label"), "l1": letter("label", 1), "l2": letter("label", 2)}).alias("e")
    c, width, left = F.col, F.col("width"), F.col("left")
    start = lambda x, n: F.substring(x, F.lit(1), n)
    goes_on = lambda n: c("following").contains(F.substring("rest", width + n + 1, F.lit(1)))
    alive = lambda n: F.when(left > width + n, goes_on(n)).otherwise(c("ends"))
    # first letters rule most edges out before longer texts are compared
    first, short = c("c1") == c("l1"), width == 1
    may = (c("edits") == 0) & (width > c("fixed")) & ((c("fixed") == 0) | (start("rest", c("fixed")) == start("label", c("fixed"))))
    same = first & c("rest").startswith(c("label")) & F.when(c("edits") == 0, c("following") != "").otherwise(alive(0))
    replaced = may & (short | first | (c("c2") == c("l2"))) & (left >= width) & (c("label") > start("rest", width)) & alive(0) & (
        short | (F.levenshtein(start("rest", width), c("label"), 1) == 1))
    removed = may & (first | (c("c2") == c("l1"))) & (left > width) & alive(1) & (
        short | (F.levenshtein(start("rest", width + 1), c("label"), 1) == 1))
    joined = f.join(e, [c("f.node") == c("e.node"), c("f.slot") == c("e.slot"), same | replaced | removed])
    moves = F.array(*[F.when(how, F.struct((F.col("i") + width + n).cast("int").alias("i"), used.alias("edits")))
                      for how, n, used in ((same, 0, F.col("edits")), (replaced, 0, F.lit(1)), (removed, 1, F.lit(1)))])
    out = joined.select("word", "back", "child", "spread", "ends", F.explode(moves).alias("m")).filter("m IS NOT NULL")
    return out.select("word", "back", F.col("m.i").alias("i"), F.col("child").alias("node"), F.col("m.edits").alias("edits"), "spread", "ends")


def near_words(words: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, near): ordered pairs of the words of ``words`` (distinct, at least ``min_letters`` letters) one edit apart."""
    edges, frontier, ends = tries(words.select("word"), min_letters // 2)
    frontier = frontier.withColumn("edits", F.lit(0))
    found: list[DataFrame] = []
    while True:
        level = checkpointed(_advanced(frontier, edges))
        if level.isEmpty():
            break
        found.append(level.filter("edits = 1 AND ends AND i = length(word)").select("word", "back", "node"))
        frontier = level.filter("edits = 0 OR i < length(word)")
    if not found:
        return words.select("word", F.col("word").alias("near")).limit(0)
    pairs = reduce(DataFrame.unionByName, found).join(ends, "node").filter(F.levenshtein("word", "near", 1) == 1)
    straight = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = checkpointed(pairs.select(straight("word").alias("word"), straight("near").alias("near")).distinct())
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms are followed to the last, twice as far in each round."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = checkpointed(now.join(ahead, "root", "left"))
        now = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next IS NOT NULL").isEmpty():
            return now


def group_variants(counts: DataFrame, min_letters: int = MIN_LETTERS, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each (word, n) of ``counts``."""
    counts = stored(counts, "words")
    pairs = near_words(counts, min_letters).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    judged = counts.join(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    judged = checkpointed(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all texts with the word they are a spelling variant of.

    Null and empty texts have no words; a null id counts as empty text in the choice of damaged words. Repeated rows
    count again. Equal counts are settled by the smaller near word in code-point order. An empty table gives no rows;
    other columns are not read. A word of any length is walked: its cost grows with the branches on its path.
    """
    return group_variants(word_counts(docs, doc_id, text))
