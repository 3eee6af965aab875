"""Mixing sources to target weights with soft membership: table classifier, then projected-gradient least squares.

Everything is DataFrame functions.

1. Every whole text gives a few counts (words, length, and how often some signs and letters occur), and from them the
   cell of each of FEATURES: a ratio cut at fixed powers of two.
2. Labelled documents (a table of doc_id and domain) give, for each cell, how often each domain falls in it: a table with
   one row for each feature, cell and domain, whatever the number of documents. The posterior of a document over the
   domains is that of naive Bayes from these tables; a document belongs to every domain in part.
3. Each document gets a rate r >= 0, its expected number of copies. With n words and posteriors p, domain k has the
   expected total S_k = sum of r n p_k. The rates minimise sum((S_k - T_k)**2) / 2T**2 + ridge * sum(n (r - 1)**2) / 2N, where
   T_k is the target weight times the budget of words. At the optimum a rate is max(0, 1 - pull / ridge), the pull being the
   gaps weighed by the posteriors, so the steps move one number a domain: projected gradient steps scaled by the domains'
   curvature matrix, each one sum over a written table, until the projected gradient is under the tolerance.

Null and empty texts have no words: they get the rate 1, which changes no total. Rows without doc_id keep their columns
and are mixed like others. Domains without labelled documents get no posterior and their target can't be met. Without any
labelled document all rates are 1. Target weights are scaled to sum to 1.
"""

from __future__ import annotations

import logging
import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.util import free_name, materialize, release


def _rate(*signs: str) -> str:
    """How often the signs occur for each word."""
    return "(" + " + ".join(f"(length(text) - length(replace(text, '{c}', '')))" for c in signs) + ") / greatest(n_words, 1)"


#: What the cells are cut from; each is a ratio of counts.
FEATURES = {
    "symbols": _rate("%", "*", "&"),
    "shouts": _rate("!"),
    "bars": _rate("|"),
    "stops": _rate("."),
    "length": "length(text) / greatest(n_words, 1) / 4",
    "umlauts": _rate("ä", "ß"),
    "accents": _rate("è", "é"),
    "tildes": _rate("ñ", "ó"),
}
#: Cells reach from 2**-8 and less to 2**8 and more.
SPAN = 8


def _counted(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, others, n_words, and the cell of each feature."""
    words = "if(text is null, 0, size(split(trim(BOTH ' \\t\\n\\r\\u000B\\u000C' FROM text), '[ \\\\t-\\\\r]+')) - if(trim(BOTH ' \\t\\n\\r\\u000B\\u000C' FROM text) = '', 1, 0))"
    base = docs.withColumn("n_words", F.expr(words).cast("long"))
    cells = [F.expr(f"coalesce(cast(least({SPAN}, greatest(-{SPAN}, round(log2(greatest(({e}), 1e-9D))))) as int), -{SPAN})").alias(f) for f, e in FEATURES.items()]
    return base.select("doc_id", *others, "n_words", *cells)


def cell_tables(counted: DataFrame, labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """Domains, and log likelihoods (feature, cell, one number for each domain), of 17 * len(FEATURES) rows at most."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    met = counted.join(known, "doc_id")
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*FEATURES))).alias("feature", "cell")
    rows = materialize(met.select("domain", pairs).groupBy("feature", "cell", "domain").agg(F.count("*").alias("n")), "cells")
    sizes = {r["domain"]: r["n"] for r in rows.where(F.col("feature") == next(iter(FEATURES))).groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(sizes)
    cells = 2 * SPAN + 1
    logs = [F.log((F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + 0.5) / (sizes[d] + 0.5 * cells)) for d in domains]
    every = counted.sparkSession.range(cells * len(FEATURES)).select(F.element_at(F.array(*map(F.lit, FEATURES)), (F.col("id") % len(FEATURES) + 1).cast("int")).alias("feature"), (F.floor(F.col("id") / len(FEATURES)) - SPAN).cast("int").alias("cell"))
    if not domains:
        return domains, every.select("feature", "cell", F.array().cast("array<double>").alias("logs"))
    table = every.join(rows, ["feature", "cell"], "left").groupBy("feature", "cell").agg(F.array(*logs).alias("logs"))
    prior = sum(sizes.values())
    return domains, materialize(table.withColumn("prior", F.array(*(F.lit(math.log((sizes[d] + 0.5) / (prior + 0.5 * len(domains)))) for d in domains))), "tables")


def posteriors(counted: DataFrame, domains: list[str], table: DataFrame) -> DataFrame:
    """counted with p, an array of the posterior of each domain."""
    one = table.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat("feature", F.lit(":"), "cell"), "logs"))).alias("logs"), F.first("prior").alias("prior"))
    # one row, of a number of cells that is fixed
    held = counted.join(F.broadcast(one), how="cross")
    terms = ", ".join(f"logs[concat('{f}:', {f})]" for f in FEATURES)
    total = f"aggregate(array({terms}), prior, (s, x) -> zip_with(s, x, (a, b) -> a + b))"
    shifted = held.withColumn("sums", F.expr(total)).withColumn("likely", F.expr("transform(sums, x -> exp(x - array_max(sums)))"))
    return shifted.withColumn("p", F.expr("transform(likely, x -> x / aggregate(likely, 0D, (s, v) -> s + v))")).drop("logs", "prior", "sums", "likely")


def _shares(domains: list[str], weights: dict[str, float]) -> list[float]:
    scale = sum(max(0.0, weights.get(d, 0.0)) for d in domains) or 1.0
    return [max(0.0, weights.get(d, 0.0)) / scale for d in domains]


def _rate_of(gaps: np.ndarray, ridge: float, p: str = "p[{}]") -> str:
    """The rate that these gaps ask of posteriors p: where they are the gaps that the rates leave, the projected gradient is 0."""
    pull = " + ".join(f"({float(g)!r}D * {p.format(i)})" for i, g in enumerate(gaps))
    return f"greatest(0D, 1 - ({pull}) / {max(ridge, 1e-9)!r}D)"


def solve_gaps(members: DataFrame, targets: list[float], ridge: float, steps: int, tolerance: float) -> np.ndarray | None:
    """One number a domain, from which _rate_of has the rates of members (doc_id, n_words, p); None without any words.

    targets are shares of the words, in the order of p. Documents of equal posteriors move alike, so each step sums a table
    that has one row for each distinct posterior. A rate only follows its document's posterior: the gradient by r is
    n times sum((S_k - T_k) p_k) / T**2 + ridge (r - 1) / N.
    It is divided by n (the metric of words), so all documents move alike and the projection stays a floor at 0. Reached
    shares are logged against the targets; rates that are not within `tolerance` of the optimum after `steps` give a warning.
    """
    k, ridge = len(targets), max(ridge, 1e-9)
    flat = materialize(members.where("n_words > 0").groupBy(*(F.col("p")[i].alias(f"p{i}") for i in range(k))).agg(F.sum("n_words").alias("n_words")), "posteriors")
    total = float(flat.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    if not total:
        return None
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    want = np.array(targets)

    def look(gaps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Objective of the gaps, its gradient and curvature, and the domains' shares."""
        rated = flat.withColumn("rate", F.expr(_rate_of(gaps, ridge, "p{}")))
        sums = [f"sum(rate * n_words * p{i})" for i in range(k)] + [f"sum(if(rate > 0, n_words * p{i} * p{j}, 0D))" for i, j in pairs] + ["sum(n_words * rate * rate)"]
        got = np.array(rated.agg(*(F.expr(f"coalesce({x}, 0D)").alias(f"s{n}") for n, x in enumerate(sums))).first(), float) / total
        curve = np.eye(k)
        for (i, j), c in zip(pairs, got[k:-1], strict=True):
            curve[i, j] += c / ridge
            curve[j, i] = curve[i, j]
        return float(gaps @ gaps / 2 + gaps @ want + ridge * got[-1] / 2), gaps + want - got[:k], curve, got[:k]

    gaps = np.zeros(k)
    value, slope, curve, shares = look(gaps)
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance * ridge:
            break
        move, length = -np.linalg.solve(curve, slope), 1.0
        while (after := look(gaps + length * move))[0] > value + 1e-4 * length * float(slope @ move) + 1e-15 and length > 1e-6:
            length /= 2
        gaps = gaps + length * move
        value, slope, curve, shares = after
    reached = ", ".join(f"{x:.6f} of {t:.6f}" for x, t in zip(shares, targets, strict=True))
    if np.abs(slope).max() > tolerance * ridge:
        warnings.warn(f"rates are not at their optimum after {steps} steps; shares of words reached: {reached}", stacklevel=2)
    logging.getLogger(__name__).info("shares of words reached: %s", reached)
    return gaps


def solve_rates(members: DataFrame, targets: list[float], ridge: float, steps: int, tolerance: float) -> DataFrame:
    """members (doc_id, n_words, p) with rate; documents without words, which change no total, have 1."""
    gaps = solve_gaps(members, targets, ridge, steps, tolerance)
    return members.withColumn("rate", F.lit(1.0) if gaps is None else F.expr(f"if(n_words = 0, 1D, {_rate_of(gaps, ridge)})"))


def mixing_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], ridge: float = 0.001, steps: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """doc_id, n_words, p_<domain> for each domain, rate.

    labelled: doc_id, domain. weights: the target share of words of each domain.
    """
    counted = materialize(_counted(docs), "counted")
    domains, table = cell_tables(counted, labelled)
    if not domains:
        return counted.select("doc_id", "n_words", F.lit(1.0).alias("rate"))
    members = materialize(posteriors(counted, domains, table).select("doc_id", "n_words", "p"), "members")
    rated = solve_rates(members, _shares(domains, weights), ridge, steps, tolerance)
    return rated.select("doc_id", "n_words", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate")


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], ridge: float = 0.001, steps: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """The documents with rate, their expected number of copies; nothing is drawn or dropped.

    A column rate that they have is replaced. The rate is an expression of each row's own text, so rows that repeat a
    doc_id, or have none, get the rate of their text.
    """
    release(docs.sparkSession)
    counted = materialize(_counted(docs), "counted")
    domains, table = cell_tables(counted, labelled)
    if not domains:
        return docs.withColumn("rate", F.lit(1.0))
    members = materialize(posteriors(counted, domains, table).select("doc_id", "n_words", "p"), "members")
    gaps = solve_gaps(members, _shares(domains, weights), ridge, steps, tolerance)
    if gaps is None:
        return docs.withColumn("rate", F.lit(1.0))
    row = free_name(docs, "row")
    kept = [F.col(f"{row}.`{c}`") for c in docs.columns if c != "rate"]
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    rated = posteriors(_counted(every, row), domains, table).withColumn("rate", F.expr(_rate_of(gaps, ridge)))
    return rated.select(*kept, F.expr("if(n_words = 0, 1D, rate)").alias("rate"))


#: The query's domains, and the shares of words they should have.
WEIGHTS = {"en": 0.55, "de": 0.18, "fr": 0.16, "es": 0.09, "poor": 0.02}


def label_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: their language where the label is good, else poor."""
    good = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").join(good, "doc_id").select("doc_id", F.expr("if(quality = 1, lang, 'poor')").alias("domain"))
