"""Selector rules over the element array of a page (columns ``nodes`` and ``page_pieces``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from leadloom.sources.html_nodes import PIECE

Rule = Callable[[Column], Column]


def attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def has_class(*names: str) -> Rule:
    def rule(n: Column) -> Column:
        padded = F.concat(F.lit(" "), F.regexp_replace(attr(n, "class"), r"\s+", " "), F.lit(" "))
        hit = F.lit(False)
        for name in names:
            hit = hit | padded.contains(f" {name} ")
        return hit
    return rule


def class_contains(*parts: str) -> Rule:
    return lambda n: attr(n, "class").rlike("(" + "|".join(parts) + ")")


def has_tag(*tags: str) -> Rule:
    return lambda n: n["tag"].isin(*tags)


def attr_is(name: str, value: str) -> Rule:
    return lambda n: attr(n, name) == value


def has_attr(*names: str) -> Rule:
    def rule(n: Column) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | F.map_contains_key(n["attrs"], name)
        return hit
    return rule


def any_of(*rules: Rule) -> Rule:
    def rule(n: Column) -> Column:
        hit = rules[0](n)
        for r in rules[1:]:
            hit = hit | r(n)
        return hit
    return rule


def all_nodes() -> Column:
    return F.col("nodes")


def select(rule: Rule, nodes: Column | None = None) -> Column:
    return F.filter(all_nodes() if nodes is None else nodes, rule)


def first(rule: Rule, nodes: Column | None = None) -> Column:
    return F.get(select(rule, nodes), F.lit(0))


def inside(node: Column) -> Column:
    """Descendants of a node, none for no node. ``seq`` is the place in the array, so they are one slice of it."""
    return F.slice(all_nodes(), F.coalesce(node["seq"] + 2, F.lit(1)), F.coalesce(node["stop"] - node["seq"] - 1, F.lit(0)))


def text_of(node: Column) -> Column:
    """Trimmed text of a node, NULL for no node; only the pieces it covers are read."""
    bits = PIECE.bit_length() - 1
    first, stop = F.shiftright(node["a"], bits), F.shiftright(node["b"] + PIECE - 1, bits)
    covered = F.array_join(F.slice(F.col("page_pieces"), first + 1, stop - first), "")
    raw = F.substr(covered, node["a"] - F.shiftleft(first, bits) + 1, node["b"] - node["a"])
    return F.regexp_replace(raw, r"^\s+|\s+$", "")


def count(rule: Rule) -> Column:
    return F.size(select(rule))
