"""Learned decision lists over text statistics: sequential covering of the documents that labels reject.

One Arrow pass computes the statistics of every whole text into a table. A bounded, documented sample of labelled rows
then teaches an ordered list of rules: each rule is grown condition by condition (FOIL gain) on two thirds of what no
earlier rule covers, pruned from its end on the other third, and kept only while it is precise; the list becomes one
ordered Spark conditional expression, applied to the table.

Null and empty texts have no words, fail the base rule (n_words < 10) and are not kept. Rows without doc_id are left
out; repeated rows each return a row. Without labels of both kinds the list is empty and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import window_hashes, word_hashes
from gridloom.llm.util import materialize, ship_package, small, small_batches

#: Features that the rules may test, as ratios of the statistics.
FEATURES = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "exclaim_ratio": "n_exclaims / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "adjacent_ratio": "n_adjacent / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_exclaims", "n_lines", "n_adjacent", "n_distinct"]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SPACE, _SYMBOL, _UPPER, _DIGIT = _class(b" \t\n\x0b\x0c\r"), _class(b"#*$%&|<>"), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789")


def repeat_words(hashes: np.ndarray, k: int = 5) -> int:
    """Words that lie in k-word windows which occur twice or more."""
    windows = window_hashes(hashes, k)
    if not windows.size:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    edge = np.zeros(hashes.size + 1, np.int64)
    edge[: hit.size] += hit
    edge[k : k + hit.size] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> list[int]:
    """The counts in the order of _COUNTS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    if not tokens:
        return [0] * len(_COUNTS)
    data = np.frombuffer(raw, np.uint8)
    hashes = word_hashes(tokens)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = int(((data & 0xC0) != 0x80).sum() - _SPACE[data].sum())
    per = np.bincount(data, minlength=256)
    adjacent = int((hashes[1:] == hashes[:-1]).sum())
    return [len(tokens), chars, int(per[_SYMBOL].sum()), len(lines) - len(set(lines)), repeat_words(hashes), int(per[_UPPER].sum()), int(per[_DIGIT].sum()), int(per[0x21]), len(lines), adjacent, np.unique(hashes).size]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame(np.array([text_counts(t) for t in batch["text"]], np.int64).reshape(-1, len(_COUNTS)), columns=_COUNTS)
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return docs.mapInPandas(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), bool)
    for feature, op, cut in rule:
        hit &= x[feature] >= cut if op == ">=" else x[feature] <= cut
    return hit


def _best(x: dict[str, np.ndarray], y: np.ndarray, on: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The condition of highest FOIL gain on the covered rows."""
    p0, n0 = int((y & on).sum()), int((~y & on).sum())
    top: tuple[float, tuple[str, str, float] | None] = (0.0, None)
    base = np.log2(p0 / (p0 + n0)) if p0 else 0.0
    for feature, values in x.items():
        v, t = values[on], y[on]
        order = np.argsort(v, kind="stable")
        v, t = v[order], t[order]
        below = np.cumsum(t)
        cut = np.flatnonzero(v[1:] > v[:-1])
        for op, pos, size in (("<=", below[cut], cut + 1), (">=", p0 - below[cut], v.size - cut - 1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / size) - base), 0)
            if gain.size and gain.max() > top[0]:
                i = int(gain.argmax())
                top = (float(gain[i]), (feature, op, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return top


def learn_rules(x: dict[str, np.ndarray], reject: np.ndarray, precision: float = 0.97, least: int = 3) -> list[Rule]:
    """Ordered rules that cover the rejected rows; a rule must be right in at least `precision` of what it covers anew.

    A rule that is not precise enough ends nothing: the feature that it began with is set aside, and the next one is tried.
    Covering ends when under `least` rejected rows are left or no feature begins a precise rule.
    """
    rules: list[Rule] = []
    left = np.ones(reject.size, bool)
    third = np.arange(reject.size) % 3 == 2
    aside: set[str] = set()
    while (reject & left).sum() >= least and len(aside) < len(x):
        rule: Rule = []
        on = left & ~third
        while (on & ~reject).any():
            _, found = _best({f: v for f, v in x.items() if rule or f not in aside}, reject, on)
            if found is None:
                break
            rule.append(found)
            on = left & ~third & _covers(rule, x)
        if not rule:
            break

        def worth(r: Rule) -> float:
            hit = left & third & _covers(r, x)
            return ((reject & hit).sum() - (~reject & hit).sum()) / max(hit.sum(), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = left & _covers(rule, x)
        good = int((reject & hit).sum())
        if good < least or good < precision * hit.sum():
            aside.add(rule[0][0])
            continue
        rules.append(rule)
        left &= ~hit
        aside.clear()
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """Number of the first rule that fits, from 1, or 0."""
    if not rules:
        return F.lit(0)
    out = None
    for i, rule in enumerate(rules, 1):
        fits = F.expr(" and ".join(f"{f} {op} {cut!r}D" for f, op, cut in rule))
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and rule (number of the rule that rejected it, else 0).

    The list is learned from per_class labelled rows of each kind at most, in hash order.
    """
    with small_batches(docs.sparkSession):
        counts = materialize(statistics(docs), "statistics")
    stats = counts.select("*", *(F.expr(f"double({e})").alias(f) for f, e in FEATURES.items()))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    learn = stats.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "y", *FEATURES).toPandas().sort_values("doc_id", kind="stable")
    rules = learn_rules({f: learn[f].to_numpy(float) for f in FEATURES}, learn["y"].to_numpy() == 0) if learn["y"].nunique() == 2 else []
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    ruled = stats.withColumn("base_failed", failed).withColumn("rule", as_expression(rules))
    return ruled.select("doc_id", *_COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def keep_quality(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> DataFrame:
    """The documents that quality_rules keeps, unchanged; rows without doc_id can't be judged and stay."""
    gone = materialize(quality_rules(docs, labels, per_class).where(~F.col("kept")).select("doc_id").distinct(), "rejected")
    return docs.join(small(gone, gone.count(), 16), "doc_id", "left_anti").select(docs.columns)
