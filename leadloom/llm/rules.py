"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "was", "for", "on", "are", "with", "as", "be", "by", "at", "this", "from",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "dans", "que", "qui", "pour", "par", "sur", "avec", "au", "est", "il",
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "ist", "nicht", "mit", "von", "zu", "auf", "für", "im", "sich", "als", "auch", "an",
    "el", "los", "las", "y", "se", "del", "una", "no", "con", "su", "es", "lo", "al", "como", "más", "o",
]


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= top / base <= high``; texts whose base is zero pass."""

    name: str
    top: str
    base: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols per word", "n_symbols", "n_words", high=0.25),
    Rule("stop words", "n_stop_words", "n_words", low=0.02),
    Rule("capital letters", "n_capitals", "word_chars", high=0.4),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.5),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` applied to ``value``, which is evaluated once."""
    return F.transform(F.array(value), then)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes within one text. Sorting brings equal ones together; only texts with a
    repeated window sort positions as well.
    """
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda acc, p: F.struct(
            (acc["n"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).alias("n"), (p + WINDOW).alias("end")), lambda acc: acc["n"])
    any_twice = lambda h: let(F.sort_array(h), lambda s: F.exists(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.get(s, k) == F.get(s, k + 1)))
    return let(hashed, lambda h: F.when(F.size(h) < 2, F.lit(0).cast("long")).when(any_twice(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text on which rules are built."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.select("doc_id", "text", F.array_remove(F.split("text", BLANKS, -1), "").alias("words"),
                 F.filter(F.split("text", "\n", -1), lambda x: F.length(_without(x, BLANK_CHARS)) > 0).alias("lines"))
    count = lambda c: c.cast("long")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return t.select(
        "doc_id", count(F.size("words")).alias("n_words"), count(F.length(F.array_join("words", ""))).alias("word_chars"),
        count(F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
        count(F.size("lines")).alias("n_lines"), count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        count(F.size(F.filter("words", lambda w: (F.length(w) <= 5) & w.isin(STOP_WORDS)))).alias("n_stop_words"),
        count(F.length("text") - F.length(_without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).alias("n_capitals"))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """All thresholds as one condition over the measures."""
    out = F.lit(True)
    for r in rules:
        top, base = F.col(r.top), F.col(r.base)
        if r.low is not None:
            out = out & ((base == 0) | (top >= r.low * base))
        if r.high is not None:
            out = out & ((base == 0) | (top <= r.high * base))
    return out


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: the measures, base_failed (too short or too repetitive) and kept.

    Null and blank texts have no words, so they fail. Repeated rows come out as often as they go in; other columns are
    not read.
    """
    m = measures(docs, doc_id, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))
