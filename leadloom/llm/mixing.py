"""Document rates that mix soft domains to target weights. Native: DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.shared import labelled_sample, stored, unused

#: The classifier is fitted on this many labelled rows, those of the smallest hashes of their ids.
SAMPLE_ROWS = 4_000
#: Words the classifier looks at, the most telling ones of the sample.
VOCABULARY = 256
MIN_DOCUMENTS = 5
#: A word counts if some domain has it so many times as often as all rows together.
MIN_LIFT = 2.0
#: ... and so many standard errors more often than chance would have it there.
MIN_ERRORS = 5.0
#: Largest relative distance of a domain's expected tokens from its target at which the descent ends, and its last step.
TOLERANCE, STEPS = 1e-6, 40
#: Weights of the domains that the labels of the pipeline tables tell apart.
TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}

#: What separates words here: blanks and punctuation.
BLANKS = r"[\x20\x09-\x0D.,;:!?()\"'#*$%&|<>]+"


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the table labels: toxic, else low for quality 0, else clean; null labels count as 0 toxic and 1 quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("clean")
    return labels.select("doc_id", domain.alias("domain"))


def _words(text: Column) -> Column:
    """Words of a text in lower case, without punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS, -1), "")


def _telling(text: Column, words: Column) -> Column:
    """Distinct words, and marks of the shape of the text."""
    count = lambda pattern: F.size(F.split(F.coalesce(text, F.lit("")), pattern, -1)) - 1
    distinct = F.array_distinct(words)
    marks = F.array(F.when(10 * count("[#*$%&|<>]") > F.size(words), "\x01symbols"), F.when(10 * count("!") > F.size(words), "\x01calls"),
                    F.when(F.size(distinct) < 0.3 * F.size(words), "\x01repeats"))
    return F.concat(distinct, F.array_compact(marks))


@dataclass
class Classifier:
    """Bernoulli naive Bayes on telling words: the score of a text without any per domain, and what each word adds."""

    domains: list[str]
    base: list[float]
    weights: dict[str, list[float]]

    def matching(self, words: Column) -> Column:
        return F.array_intersect(words, F.array(*map(F.lit, self.weights))) if self.weights else F.array().cast("array<string>")

    def posteriors(self, seen: Column) -> Column:
        """Array of the domains' posteriors, in the order of ``domains``, from the ``matching`` words of a text."""
        score = F.array(*map(F.lit, self.base))
        if self.weights:
            table = F.create_map(*[x for w, v in self.weights.items() for x in (F.lit(w), F.array(*map(F.lit, v)))])
            score = F.aggregate(seen, score, lambda acc, w: F.zip_with(acc, table[w], lambda a, b: a + b))
        raised = F.transform(F.array(score), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
        return F.transform(F.array(raised), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b)))[0]


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text",
                   rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Classifier:
    """From at most ``rows`` labelled documents. Labels of other domains, null labels and null ids are left out."""
    wanted = labelled.select(F.col(doc_id).alias("id"), F.col("domain").alias("y")).filter(F.col("y").isin(domains))
    d = labelled_sample(docs, wanted, doc_id, text, rows).select(F.col("y").alias("__domain"), "text", _words(F.col("text")).alias("words"))
    d = stored(d.select("__domain", _telling(F.col("text"), F.col("words")).alias("words")), "labelled")
    sizes = {r[0]: r[1] for r in d.groupBy("__domain").count().collect()}
    total = sum(sizes.values())
    within = [F.sum(F.when(F.col("__domain") == k, 1).otherwise(0)).alias(f"n{i}") for i, k in enumerate(domains)]
    words = d.select("__domain", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *within).filter(F.col("n") >= MIN_DOCUMENTS)
    gain, best = F.lit(0.0), F.lit(0.0)
    for i, k in enumerate(domains):
        lift = F.log((F.col(f"n{i}") + 0.5) / (sizes.get(k, 0) + 1.0) * (total + 1.0) / (F.col("n") + 0.5))
        share = sizes.get(k, 0) / max(1, total)
        errors = (F.col(f"n{i}") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-12))
        gain, best = gain + F.col(f"n{i}") * lift, F.greatest(best, F.when(errors >= MIN_ERRORS, lift).otherwise(0.0))
    top = words.withColumn("gain", gain).filter(best >= float(np.log(MIN_LIFT))).orderBy(F.desc("gain"), "w").limit(vocabulary).collect()
    base = [float(np.log((sizes.get(k, 0) + 0.5) / (total + 0.5 * len(domains)))) for k in domains]
    weights = {}
    for r in top:
        p = [(r[f"n{i}"] + 0.5) / (sizes.get(k, 0) + 1) for i, k in enumerate(domains)]
        base = [b + float(np.log(1 - x)) for b, x in zip(base, p)]
        weights[r["w"]] = [float(np.log(x / (1 - x))) for x in p]
    return Classifier(domains, base, weights)


def _rate(start: float, steps: list[list[float]], p: str = "__p") -> Column:
    """Rate of a document after all steps: each moves it along its posteriors and projects it to 0 or more."""
    if not steps:
        return F.lit(start)
    taken = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    return F.aggregate(taken, F.lit(start), lambda r, s: F.greatest(F.lit(0.0), r - F.aggregate(
        F.zip_with(F.col(p), s, lambda a, x: a * x), F.lit(0.0), lambda a, b: a + b)))


def fit_rates(table: DataFrame, targets: list[float]) -> tuple[float, list[list[float]]]:
    """Start rate and steps of the projected gradient descent; ``table`` has __tokens and __p.

    Minimised is the squared distance between the domains' expected tokens, the sum of rate * tokens * posterior, and
    their targets (weight * all tokens). The gradient is taken in the metric of the token moments of the documents
    whose rate is above 0, as projection holds the others; a step that does not come closer is halved. Each round is
    one aggregation over all documents; the driver holds one number per domain or pair of domains.
    """
    k, goal = len(targets), np.array(targets)
    steps: list[list[float]] = []
    best, near, step = [], np.inf, np.zeros(k)
    for _ in range(STEPS):
        rated = table.select("__tokens", "__p", _rate(1.0, steps).alias("r"))
        mass = [F.col("__tokens") * F.col("__p")[i] for i in range(k)]
        now = rated.agg(F.sum("__tokens").alias("t"), *[F.sum(F.col("r") * mass[i]).alias(f"s{i}") for i in range(k)],
                        *[F.sum(F.when(F.col("r") > 0, mass[i] * F.col("__p")[j])).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
        if not now["t"]:
            return 1.0, []
        off = np.array([now[f"s{i}"] for i in range(k)], float) / now["t"] - goal
        if np.linalg.norm(off) < near:
            best, near = list(steps), np.linalg.norm(off)
            moments = np.array([[now[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)], float) / now["t"]
            step = np.linalg.pinv(moments, rcond=1e-6) @ off
        else:
            step = step / 2
        if near <= TOLERANCE:
            break
        steps = [*best, step.tolist()]
    return 1.0, best


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) with n_tokens, posteriors (map by domain) and rate.

    ``targets`` are relative weights of the domains. Rates are at least 0 and say how often a document is to be read;
    drawing is left to the reader, so no row is dropped. A text without words has no tokens and the posteriors of an
    empty word list. Columns of ``docs`` with the names of the new ones are replaced. A domain without any posterior
    mass stays empty. An empty table gives no rows; repeated rows come out as often as they go in.
    """
    domains = sorted(targets)
    model = fit_classifier(docs, labelled, domains, doc_id, text)
    new = ("n_tokens", "posteriors", "rate")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    w, seen, tokens, p = unused(docs, "words_", "seen_", "__tokens", "__p")
    table = docs.select(*kept, *([] if text in kept else [text]), _words(F.col(text)).alias(w))
    table = table.select(*kept, F.size(w).cast("long").alias(tokens), model.matching(_telling(F.col(text), F.col(w))).alias(seen))
    table = table.select(*kept, tokens, model.posteriors(F.col(seen)).alias(p))
    table = stored(table, "posteriors")
    weight = sum(targets.values())
    start, steps = fit_rates(table.select(F.col(tokens).alias("__tokens"), F.col(p).alias("__p")), [targets[d] / weight for d in domains])
    posteriors = F.map_from_arrays(F.array(*map(F.lit, domains)), F.col(p))
    return table.select(*kept, F.col(tokens).alias("n_tokens"), posteriors.alias("posteriors"), _rate(start, steps, p).alias("rate"))
