"""Small string helpers shared by the column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from leadloom import refdata as R


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """True when the text is present and not only blanks."""
    return F.length(F.trim(text_or_empty(c))) > 0


def null_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def group(pattern: str, c: Column, n: int = 1) -> Column:
    """Capture group ``n`` of the first match, NULL when there is none."""
    return null_if_empty(F.regexp_extract(c, pattern, n))


def all_groups(pattern: str, c: Column, n: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(n))


def alternation(words: list[str], escape: bool = True) -> str:
    return "|".join(re.escape(w) if escape else w for w in words)


def has_any(c: Column, words: list[str]) -> Column:
    """Substring test against a fixed word list as one regex."""
    return c.rlike("(" + alternation(words) + ")")


def whole_word(words: list[str]) -> str:
    return r"\b(" + alternation(words) + r")\b"


def fold_accents(c: Column | str) -> Column:
    return F.translate(F.lower(text_or_empty(c)), R.ACCENTED, R.UNACCENTED)


def words_of(c: Column, min_length: int = 1) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= min_length)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Keeps plans and generated code small where a rule reads a derived text many times.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def literal_lower_map(pairs: dict[str, str]) -> Column:
    return R.literal_map({k.lower(): v for k, v in pairs.items()})
