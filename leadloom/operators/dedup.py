"""Duplicate leads within a search, by site and by company name, and similar company names."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.functions.company import normalize_company, similarity
from leadloom.functions.text import text_or_empty
from leadloom.functions.url import bare_domain, is_query_link
from leadloom.operators.skew import attach_per_key, top_per_key
from leadloom.session import checkpointed, stored

NAME_RATIO = 0.85
#: Old names of up to this many characters list their possible matches, at most 46 of them.
LONG = 64
#: Characters of the grams by which longer names are found.
GRAM = 8
#: Leads of a search up to which they are taken one by one where they meet.
FEW = 64
#: Names that share a segment or part from which it does not make pairs by itself.
CROWD = 512


def dedup_domain(website: Column | str) -> Column:
    """Domain that identifies a lead's site; NULL without one and for search links, which are unique per query."""
    domain = bare_domain(website)
    return F.when((domain != "") & ~is_query_link(website), domain)


def first_by_domain(leads: DataFrame) -> DataFrame:
    """Site rule alone: the first lead per (search, domain) is canonical, later ones point to it.

    One aggregate finds the canonical lead per key and is written, as the look-up, which spreads hot keys, reads it twice.
    """
    d = leads.withColumn("domain", dedup_domain("website"))
    first = stored(d.filter("domain IS NOT NULL").groupBy("search_id", "domain").agg(
        F.min(F.struct("created_at", "lead_id"))["lead_id"].alias("first_id"), F.count(F.lit(1)).alias("n")), "firsts")
    out = attach_per_key(d, first, ["search_id", "domain"], "n")
    dup = F.coalesce(F.col("first_id") != F.col("lead_id"), F.lit(False))
    return out.select(
        *leads.columns, "domain", dup.alias("is_duplicate"), F.when(dup, F.col("first_id")).alias("duplicate_of"))


def name_matches(names: DataFrame, scope: list[str], name: str = "name") -> DataFrame:
    """Pairs (scope, new_name, old_name) of different names where old contains new and is at most 1/0.85 as long.

    New names need more than three characters. ``names`` must be distinct. Old names of up to ``LONG`` characters list
    the few substrings that can match and join by equality; longer ones have too many and are found by grams.
    """
    n = F.length(name)
    return _short_matches(names, names.filter(n <= LONG), scope, name).unionByName(_long_matches(names, scope, name))


def _shortest(n: Column) -> Column:
    """Fewest characters of a name that an old one of ``n`` characters can match."""
    return F.greatest(F.lit(4), F.floor(n * F.lit(NAME_RATIO)).cast("int") + 1)


def _short_matches(names: DataFrame, olds: DataFrame, scope: list[str], name: str) -> DataFrame:
    n = F.length(name)
    starts = F.sequence(F.lit(1), n)
    lengths = F.sequence(_shortest(n), n - 1)
    cuts = F.flatten(F.transform(lengths, lambda k: F.transform(
        F.filter(starts, lambda i: i + k - 1 <= n), lambda i: F.substr(F.col(name), i, k))))
    old = olds.filter(_shortest(n) <= n - 1).select(
        *scope, F.col(name).alias("old_name"), F.explode(F.array_distinct(cuts)).alias("new_name"))
    new = names.filter(n > 3).select(*scope, F.col(name).alias("new_name"))
    return old.join(new, [*scope, "new_name"]).select(*scope, "new_name", "old_name")


def _grams(names: DataFrame, scope: list[str], name: str) -> DataFrame:
    """(scope, id, n, gram): the distinct grams of each name as hashes; the id is a hash of the name."""
    chars = names.select(*scope, F.xxhash64(name).alias("id"), F.length(name).alias("n"), F.split(name, "").alias("c"))
    places = F.sequence(F.lit(1), F.col("n") - GRAM + 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("c", i, GRAM), ""))))
    return chars.select(*scope, "id", "n", F.explode(grams).alias("gram"))


def _long_matches(names: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Matches of old names of more than ``LONG`` characters: a new name is looked up by its rarest gram.

    An old name holds every gram of a name it contains, so one is enough, and a new name with a gram that no old name
    of fitting length has is done. Lengths are in classes by powers of 1/0.85; a match is of the same class or the next.
    Rows carry hashes, so the work grows with the length of a name; names meet only where a rarest gram does.
    """
    size = lambda c: F.floor(F.log(c) / F.lit(-math.log(NAME_RATIO))).cast("int")
    grams = _grams(names.filter(F.length(name) > int(LONG * NAME_RATIO)), scope, name)
    old = grams.filter(F.col("n") > LONG).withColumn("class", size(F.col("n")))
    new = grams.withColumn("class", F.explode(F.array(size(F.col("n")), size(F.col("n")) + 1)))
    counts = old.groupBy(*scope, "class", "gram").agg(F.count(F.lit(1)).alias("holders"))
    # a name of more than LONG characters is a holder of its own grams
    own = F.when((F.col("n") > LONG) & (F.col("class") == size(F.col("n"))), 1).otherwise(0)
    ranked = new.join(counts, [*scope, "class", "gram"], "left").groupBy(*scope, "class", "id", "n").agg(
        F.min(F.struct((F.coalesce("holders", F.lit(0)) - own).alias("others"), "gram")).alias("best"))
    sought = ranked.filter("best.others > 0").select(*scope, "class", F.col("best.gram").alias("gram"), F.col("id").alias("new_id"), F.col("n").alias("k"))
    fits = (F.col("k") < F.col("n")) & (F.col("k") >= _shortest(F.col("n")))
    pairs = old.join(sought, [*scope, "class", "gram"]).filter(fits).select(*scope, "new_id", F.col("id").alias("old_id"))
    named = lambda x: names.select(*scope, F.xxhash64(name).alias(f"{x}_id"), F.col(name).alias(f"{x}_name"))
    found = pairs.join(named("old"), [*scope, "old_id"]).join(named("new"), [*scope, "new_id"])
    return found.filter(F.contains("old_name", "new_name")).select(*scope, "new_name", "old_name")


def mark_duplicates(leads: DataFrame, rules: tuple[str, ...] = ("domain", "name"), few: int = FEW) -> DataFrame:
    """Adds ``is_duplicate`` and ``duplicate_of``: leads are taken in order of (created_at, lead_id) and a lead is a
    duplicate when an earlier kept lead of its search has its domain, or a name that contains its name at more than
    0.85 of the length.

    "Kept" depends on earlier decisions. The leads of a search with at most ``few`` of them meet in one row and are taken
    one by one; larger searches are decided in rounds, so that none is a single task. Each round decides every lead
    whose earlier matches are settled: it is a duplicate as soon as one of them is kept, and kept when none is kept or
    open. Decisions only depend on earlier leads, so the result is that of the one-by-one pass. Groups are reduced to
    their first kept and first open lead, so no round pairs the leads of a group. A round reads the open leads and those
    kept in the round before.
    """
    # compares like the order in which leads are taken
    pos = F.struct(F.col("created_at"), F.col("lead_id"))
    rows = leads.select(
        "lead_id", "search_id", pos.alias("pos"),
        (dedup_domain("website") if "domain" in rules else F.lit(None).cast("string")).alias("domain"),
        (F.when(text_or_empty("company_name") != "", F.lower("company_name"))
         if "name" in rules else F.lit(None).cast("string")).alias("name"))
    rows = stored(rows, "rows")
    large = stored(rows.groupBy("search_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("search_id"), "large")
    if large.isEmpty():
        marks = _one_by_one(rows)
    else:
        marks = _one_by_one(rows.join(large, "search_id", "left_anti")).unionByName(
            _in_rounds(rows.join(large, "search_id", "left_semi").select(*rows.columns)))
    base = leads.drop("is_duplicate", "duplicate_of")
    return base.join(marks, "lead_id").select(*base.columns, "is_duplicate", "duplicate_of")


def _one_by_one(rows: DataFrame) -> DataFrame:
    """(lead_id, is_duplicate, duplicate_of) of searches with few leads: the pass itself, over an array per search.

    Leads without a search have no earlier lead.
    """
    lead = F.struct("pos", "domain", "name")

    def same_site(old: Column, new: Column) -> Column:
        return F.coalesce(old["domain"] == new["domain"], F.lit(False))

    def same_name(old: Column, new: Column) -> Column:
        n, k = F.length(old["name"]), F.length(new["name"])
        inside = (k >= _shortest(n)) & (k < n) & F.contains(old["name"], new["name"])
        return F.coalesce((k > 3) & ((old["name"] == new["name"]) | inside), F.lit(False))

    def earlier(kept: Column, new: Column, rule: Callable[[Column, Column], Column]) -> Column:
        return F.filter(kept, lambda old: (old["pos"] < new["pos"]) & rule(old, new))

    def either(old: Column, new: Column) -> Column:
        return same_site(old, new) | same_name(old, new)

    each = rows.filter("search_id IS NOT NULL").groupBy("search_id").agg(F.array_sort(F.collect_list(lead)).alias("leads"))
    kept = F.aggregate("leads", F.slice("leads", 1, 0), lambda done, new: F.when(
        F.size(earlier(done, new, either)) == 0, F.concat(done, F.array(new))).otherwise(done))

    def mark(kept: Column, new: Column) -> Column:
        first = F.coalesce(F.get(earlier(kept, new, same_site), F.lit(0)), F.get(earlier(kept, new, same_name), F.lit(0)))
        return F.struct(new["pos"]["lead_id"].alias("lead_id"), first.isNotNull().alias("is_duplicate"), first["pos"]["lead_id"].alias("duplicate_of"))

    marks = each.select("leads", kept.alias("kept")).select(F.explode(F.transform("leads", lambda new: mark(F.col("kept"), new))).alias("m"))
    alone = rows.filter("search_id IS NULL").select("lead_id", F.lit(False).alias("is_duplicate"), F.lit(None).cast(rows.schema["lead_id"].dataType).alias("duplicate_of"))
    return marks.select("m.*").unionByName(alone)


def _in_rounds(rows: DataFrame) -> DataFrame:
    """(lead_id, is_duplicate, duplicate_of) of searches of any size."""
    rows = checkpointed(rows.withColumn("state", F.lit("open")))
    names = rows.filter("name IS NOT NULL").select("search_id", "name").distinct()
    edges = checkpointed(name_matches(names, ["search_id"]))
    active, settled = rows, None
    while True:
        decided = checkpointed(_round(active, edges))
        done = decided.filter("state IN ('kept', 'duplicate')")
        settled = done if settled is None else settled.unionByName(done)
        # rows kept in earlier rounds were already compared with every row that is still open
        active = decided.filter("state IN ('kept', 'open')")
        if active.filter("state = 'open'").isEmpty():
            break
    state = settled
    kept = F.when(F.col("state") == "kept", F.col("pos"))
    bests = _first_positions(state, edges, {"kept_pos": kept})
    first_domain, first_name = F.col("d_kept_pos"), F.col("n_kept_pos")
    dup = F.col("state") == "duplicate"
    target = F.when(first_domain < F.col("pos"), first_domain).otherwise(first_name)["lead_id"]
    return bests.select("lead_id", dup.alias("is_duplicate"), F.when(dup, target).alias("duplicate_of"))


def _first_positions(state: DataFrame, edges: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Attach, per lead, the smallest position of each measure among its domain group and its matching names."""
    def mins() -> list[Column]:
        return [F.min(c).alias(k) for k, c in measures.items()] + [F.count(F.lit(1)).alias("n")]

    by_domain = state.filter("domain IS NOT NULL").groupBy("search_id", "domain").agg(*mins())
    by_domain = by_domain.select("search_id", "domain", *[F.col(k).alias("d_" + k) for k in measures], "n")
    own = state.filter("name IS NOT NULL").groupBy("search_id", "name").agg(*mins())
    # names of three characters or fewer never count as new
    usable = own.withColumn("self", F.length("name") > 3)
    through = edges.join(
        own.select("search_id", F.col("name").alias("old_name"), *measures), ["search_id", "old_name"]
    ).groupBy("search_id", F.col("new_name").alias("name")).agg(*[F.min(k).alias("e_" + k) for k in measures])
    by_name = usable.join(through, ["search_id", "name"], "left").select(
        "search_id", "name",
        *[F.least(F.when(F.col("self"), F.col(k)), F.col("e_" + k)).alias("n_" + k) for k in measures], "n")
    out = attach_per_key(state, by_domain, ["search_id", "domain"], "n")
    return attach_per_key(out, by_name, ["search_id", "name"], "n")


def _round(state: DataFrame, edges: DataFrame) -> DataFrame:
    is_kept, is_open = F.col("state") == "kept", F.col("state") == "open"
    seen = _first_positions(state, edges, {
        "kept": F.when(is_kept, F.col("pos")), "open": F.when(is_open, F.col("pos"))})

    def earlier(*cs: str) -> Column:
        hit = F.lit(False)
        for c in cs:
            hit = hit | F.coalesce(F.col(c) < F.col("pos"), F.lit(False))
        return hit

    new_state = (
        F.when(~is_open, "done")
        .when(earlier("d_kept", "n_kept"), "duplicate")
        .when(~earlier("d_open", "n_open"), "kept")
        .otherwise("open"))
    return seen.withColumn("state", new_state).select(*state.columns)


# --- similar company names -----------------------------------------------------------------------

def _allowed_edits(length: Column) -> Column:
    """Largest edit distance that keeps similarity >= 0.85 for a longer name of this length."""
    return F.floor((length * 15) / 100).cast("int")


def _segments(edits: Column, name: Column) -> Column:
    """Even cut of a name into edits+1 segments: array<struct(seg, start, text)>, start from 1."""
    parts = edits + 1
    n = F.length(name)

    def one(i: Column) -> Column:
        start, stop = F.floor(n * i / parts).cast("int"), F.floor(n * (i + 1) / parts).cast("int")
        return F.struct(i.alias("seg"), F.substr(name, start + 1, stop - start).alias("text"))

    return F.transform(F.sequence(F.lit(0), edits), one)


def indexed_segments(right: DataFrame) -> DataFrame:
    """(other, len, k, seg, text): the segments of each indexed name for every number of edits its pairs can have."""
    n = F.length("other")
    # the longer of a pair has length between len(other) and len(other)/0.85, hence this range of k
    ks = F.sequence(_allowed_edits(n), _allowed_edits(F.floor(n * 100 / 85).cast("int")))
    return right.select("other", n.alias("len"), F.explode(ks).alias("k")).select(
        "other", "len", "k", F.explode(_segments(F.col("k"), F.col("other"))).alias("s")
    ).select("other", "len", "k", F.col("s.seg").alias("seg"), F.col("s.text").alias("text"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, other, k) of names that agree on a segment at a fitting place; every pair within k edits is among them."""
    indexed = indexed_segments(right)
    m = F.length("name")
    lens = F.sequence(F.ceil(m * 85 / 100).cast("int"), F.floor(m * 100 / 85).cast("int"))
    probe = left.select("name", m.alias("m"), F.explode(lens).alias("len"))
    probe = probe.withColumn("k", _allowed_edits(F.greatest("len", "m"))).filter(F.abs(F.col("len") - F.col("m")) <= F.col("k"))
    probe = probe.select("name", "m", "len", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("seg"))
    start, stop = (_cut(F.col("len"), F.col("k"), F.col("seg") + i) for i in (0, 1))
    probe = probe.withColumn("start", start).withColumn("size", stop - start)
    # with j segments before this one and k - j after it, at most as many edits can have moved it on either side
    shift, after = F.col("m") - F.col("len"), F.col("k") - F.col("seg")
    low = F.greatest(F.col("start") - F.col("seg"), F.col("start") + shift - after, F.lit(0))
    high = F.least(F.col("start") + F.col("seg"), F.col("start") + shift + after, F.col("m") - F.col("size"))
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    texts = F.array_distinct(F.transform(places, lambda i: F.substr(F.col("name"), i + 1, F.col("size"))))
    probe = probe.select("name", "len", "k", "seg", F.explode(texts).alias("text"))
    return _meet(indexed.withColumn("at", _cut(F.col("len"), F.col("k"), F.col("seg"))), probe)


def similar_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (name, other, similarity) with similarity >= 0.85, for distinct non-empty names on both sides.

    Two names within k edits agree on one of k+1 segments of the indexed name, at a place moved no further than the
    edits before or after it allow. The join key is (length, k, segment, text); names of up to six characters have
    k = 0 and meet by equality through the same key.
    """
    # a pair may meet in several segments; taking each once also spreads the pairs of a segment over all tasks
    near = candidate_pairs(left, right).distinct()
    return near.filter(_within("name", "other", F.col("k"))).select(
        "name", "other", similarity("name", "other").alias("similarity")).filter(F.col("similarity") >= NAME_RATIO)


def _cut(length: Column, k: Column, seg: Column) -> Column:
    """Where segment ``seg`` of an even cut into k+1 begins, from 0."""
    return F.floor(length * seg / (k + 1)).cast("int")


def _meet(indexed: DataFrame, probe: DataFrame) -> DataFrame:
    """(name, other, k) of names that share a segment key (len, k, seg, text).

    A segment that more than ``CROWD`` indexed names share is no key for pairs. There, what is left of the indexed name
    around the segment is cut into k+1 parts, of which k edits leave one intact, moved by k places at most; names have
    to agree on such a part as well. Parts are counted too, and what is still crowded is dealt out by blocks of the
    indexed names, so that no task has all pairs of a key.
    """
    key = ["len", "k", "seg", "text"]
    crowded = checkpointed(indexed.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > CROWD).select(*key))
    few = indexed.join(crowded, key, "left_anti").join(probe, key).select("name", "other", "k")
    rest = F.concat(F.substr("other", F.lit(1), F.col("at")), F.substr("other", F.col("at") + F.length("text") + 1, F.length("other")))
    # parts are places in the indexed name: those before the segment keep theirs, those behind skip it
    parts = indexed.join(crowded, key, "left_semi").withColumn("rest", rest).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin, end = (_cut(F.length("rest"), F.col("k"), F.col("part") + i) for i in (0, 1))
    size = F.length("text")
    parts = parts.withColumn("begin", begin).withColumn("end", end).filter("begin < end")
    # a part that lies on both sides of the segment is taken up to it, which is shorter and so found wherever it was
    parts = parts.withColumn("end", F.when((F.col("begin") < F.col("at")) & (F.col("end") > F.col("at")), F.col("at")).otherwise(F.col("end")))
    place = F.when(F.col("begin") < F.col("at"), F.col("begin")).otherwise(F.col("begin") + size)
    parts = parts.select(*key, "other", place.alias("place"), F.substr("rest", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"))
    # probes list their pieces only for the places and sizes that the indexed names of the key have
    shapes = parts.select(*key, "place", F.length("piece").alias("width")).distinct()
    low = F.greatest(F.col("place") - F.col("k"), F.lit(0))
    high = F.least(F.col("place") + F.col("k"), F.length("name") - F.col("width"))
    pieces = F.when(low <= high, F.array_distinct(F.transform(F.sequence(low, high), lambda i: F.substr(F.col("name"), i + 1, F.col("width")))))
    sought = probe.join(crowded, key, "left_semi").join(shapes, key).select(*key, "name", "place", F.explode(pieces).alias("piece"))
    both = [*key, "place", "piece"]
    blocks = parts.groupBy(*both).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("blocks"))
    dealt = parts.join(blocks, both).withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")).drop("blocks")
    sought = sought.join(blocks, both).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    many = dealt.join(sought, [*both, "block"]).select("name", "other", "k")
    return few.unionByName(many)


def _within(a: str, b: str, k: Column) -> Column:
    """Edit distance at most ``k``. The bounded form stops early; its bound must be a constant, so it goes by steps."""
    steps = F.when(k == 0, F.when(F.col(a) == F.col(b), 0).otherwise(-1))
    for bound in (2, 4, 8):
        steps = steps.when(k <= bound, F.levenshtein(a, b, bound))
    return steps.otherwise(F.levenshtein(a, b)).between(F.lit(0), k)


def match_companies(names: DataFrame, companies: DataFrame, alternatives: int = 3) -> DataFrame:
    """Best company per name: an equal normalised name, else the most similar ones.

    ``names``: ``name``; ``companies``: ``company_id, normalized_name``. One row per match with ``rank`` (1 = best),
    ``similarity`` and ``match_type`` exact/similar; names without a match get one row of type none.
    """
    wanted = names.select("name", normalize_company("name").alias("key")).distinct()
    # several companies may share a normalised name; the lowest id stands for it
    known = companies.groupBy(F.col("normalized_name").alias("other")).agg(F.min("company_id").alias("company_id"))
    exact = wanted.join(known, F.col("key") == F.col("other")).select(
        "name", "company_id", F.lit(1.0).alias("similarity"), F.lit("exact").alias("match_type"), F.lit(1).alias("rank"))
    open_names = wanted.join(known.select(F.col("other").alias("key")), "key", "left_anti")
    pairs = similar_pairs(open_names.filter("key <> ''").select(F.col("key").alias("name")).distinct(),
                          known.filter("other <> ''").select("other"))
    ranked = top_per_key(
        pairs.join(known, "other"), ["name"], [F.desc("similarity"), F.asc("company_id")], alternatives, "rank")
    close = open_names.join(ranked.withColumnRenamed("name", "key"), "key").select(
        "name", "company_id", "similarity", F.lit("similar").alias("match_type"), "rank")
    found = exact.unionByName(close)
    none = wanted.join(found.select("name").distinct(), "name", "left_anti").select(
        "name", F.lit(None).cast("long").alias("company_id"), F.lit(0.0).alias("similarity"),
        F.lit("none").alias("match_type"), F.lit(0).alias("rank"))
    return found.unionByName(none)
