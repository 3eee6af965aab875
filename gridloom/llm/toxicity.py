"""Toxicity: a noisy channel undoes disguised spelling before the text is scored.

1. A character trigram model is counted over every document (one 27 by 27 by 27 table for each task, summed).
2. Every whole text is split into words. A word that holds digits, symbols or long repetitions, and a run of single
   characters, is a lattice: each character stands for itself or a letter that it imitates, separators may vanish, a
   masking sign may be any letter, a repeated letter may be one or two. Viterbi decoding finds the likeliest letters
   under channel costs and the trigram model. Plain words have one path and stay as they are.
3. Character n-grams and whole words of the restored texts are weighed by a lower confidence bound of their log odds in
   toxic documents (learned from per_class labelled documents of each label at most, in hash order); a document's
   score is a logistic function of how strong its strongest words are and how many there are, fitted on the same sample.

Null and empty texts have no words and get the lowest score. Rows without doc_id are left out; repeated rows each
return a row. Without labels of both kinds every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import held_out, sample
from gridloom.llm.util import ship_package

#: Letters that a character may imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Characters that may hide one letter, and characters that only separate.
MASKS, SEPARATORS = "*#", ".-_~'`^,:;/\\"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TRAIL = re.compile(r"^[\"'(\[{.,;:?*#%&_~-]+|(?:[\"')\]}.,;:?!*#%&_~-]|\$\$+|!!+)+$")
_ODD = re.compile(r"[^\W\d_]([^\w]|[\d_])|([^\w]|[\d_])[^\W\d_]|([^\W\d_])\3\3")
#: Ends in signs that may hide letters, after a letter or an imitated one; and what may stand around such a word.
_MASKED = re.compile(r"[^\W_].*[*#$@]+[\"')\]}.,;:?!]*$")
_QUOTES = re.compile(r"^[\"'(\[{]+|[\"')\]}.,;:?!]+$")
_SINGLES = re.compile(r"(?:(?<=[\x20\x09-\x0D])|^)(?:[^\x20\x09-\x0D][\x20\x09-\x0D]){2,}[^\x20\x09-\x0D](?=[\x20\x09-\x0D]|$)")
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CACHE_WORDS = 400_000


def _count_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(27**3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            if text:
                c = _CODE[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=total.size)
    yield pd.DataFrame({"block": np.arange(27), "counts": [x.tobytes() for x in total.reshape(27, -1)]})


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"], batch["counts"], strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
    if total:
        yield pd.DataFrame({"block": list(total), "counts": [x.tobytes() for x in total.values()]})


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first two) over boundary and a to z, from all documents.

    Each task counts its own documents; the tables are summed by block, one for each first letter, and 27 rows are collected.
    """
    counted = docs.mapInPandas(_count_letters, "block int, counts binary")
    total = np.zeros((27, 27**2), np.int64)
    for row in counted.repartition(27, "block").mapInPandas(_add, "block int, counts binary").collect():
        total[row["block"]] += np.frombuffer(row["counts"], np.int64)
    table = total.reshape(27, 27, 27).astype(float)
    one = table.sum((0, 1)) + 1
    two = table.sum(0) + 20 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = table + 20 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each position of the lower-case word, what it may stand for and the channel's cost (a log probability)."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        c, run = word[i], 1
        while i + run < len(word) and word[i + run] == c:
            run += 1
        if c.isalpha() or c not in IMITATES and c not in MASKS and c not in SEPARATORS:
            out.append([(c, 0.0)] if run == 1 else [(c * 2, 0.0 if run == 2 else -0.2), (c, -3.0 if run == 2 else -0.2)])
        else:
            own = [(x * n, -1.5 - (n - 1)) for x in IMITATES.get(c, "") for n in range(1, min(run, 2) + 1)]
            if c in MASKS:
                own += [(x, -4.0) for x in _LETTERS] if run == 1 else []
            out.append([*own, ("", -0.5 if c in SEPARATORS or c in MASKS else -9.0)])
        i += run
    return out


def decode(word: str, model: np.ndarray) -> str:
    """The likeliest letters of a lower-case word: Viterbi over its lattice; states are the last two letters."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(word):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, price in options:
                x, y, total = a, b, cost + price
                for ch in letters:
                    z = ord(ch) - 96 if "a" <= ch <= "z" else 0
                    total += model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, (path, letters))
        states = after
    path = max(((cost + model[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])[1]
    parts = []
    while path:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def restored(text: str | None, model: np.ndarray, cache: dict[str, str]) -> set[str]:
    """Distinct words of the text, lower-cased and undisguised."""
    if not text:
        return set()
    low = text.lower()
    out = set()
    for raw in set(low.split()):
        word = cache.get(raw)
        if word is None:
            word = _TRAIL.sub("", raw)
            if _ODD.search(word):
                word = decode(word, model)
            if _MASKED.search(raw):
                # signs at the end may stand for letters: both readings count
                word += " " + decode(_QUOTES.sub("", raw), model)
            if len(cache) >= _CACHE_WORDS:
                cache.clear()
            cache[raw] = word
        out.update(word.split(" "))
    for found in _SINGLES.finditer(low):
        letters = "".join(found.group().split())
        out.add(letters if letters.isalpha() else decode(letters, model))
    out.discard("")
    return out


def features(word: str) -> list[str]:
    """The whole word and its character 4- and 5-grams, the first with a mark for the start."""
    marked = "^" + word
    return [f"={word}", *(marked[i : i + n] for n in (4, 5) for i in range(max(0, len(marked) - n + 1)))]


def _feature_counts(model: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        seen = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                seen[y].update({f for w in restored(text, model, cache) for f in features(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pd.DataFrame({"feature": part, "c0": [seen[0][f] for f in part], "c1": [seen[1][f] for f in part]})

    return run


def _strength(word: str, weights: dict[str, float]) -> float:
    return max((weights.get(f, 0.0) for f in features(word)), default=0.0)


#: What a document's score is made of, from the strengths of its distinct words.
EVIDENCE = ["first", "second", "squared", "six", "density"]

_EVIDENCE_TYPE = ", ".join(f"{name} double" for name in EVIDENCE)


def _evidence(model: np.ndarray, weights: dict[str, float]):
    """Function of a text: its EVIDENCE, that is the two strongest words, the first one's square, the sum of the
    strongest six, and the sum of all over the square root of the number of distinct words."""
    words: dict[str, str] = {}
    strengths: dict[str, float] = {}

    def run(text: str | None) -> tuple[float, ...]:
        found, n = [], 0
        for word in restored(text, model, words):
            n += 1
            s = strengths.get(word)
            if s is None:
                if len(strengths) >= _CACHE_WORDS:
                    strengths.clear()
                s = strengths[word] = _strength(word, weights)
            if s:
                found.append(s)
        found.sort(reverse=True)
        first, second = [*found[:2], 0.0, 0.0][:2]
        return first, second, first * first, sum(found[:6]), sum(found) / max(n, 1) ** 0.5

    return run


def _strengths(model: np.ndarray, weights: dict[str, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = _evidence(model, weights)
        for batch in batches:
            got = np.array([evidence(t) for t in batch["text"]], float).reshape(-1, len(EVIDENCE))
            yield batch.drop(columns="text").assign(**dict(zip(EVIDENCE, got.T, strict=True)))

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by damped Newton steps; the rarer label counts for the root of its scarcity more."""
    x = np.c_[x, np.ones(len(x))]
    much = np.where(y == 1, np.sqrt((1 - y.mean()) / y.mean()), 1.0)
    much /= much.mean()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (much * (p - y)) / len(y) + 1e-3 * w
        h = (x * (much * p * (1 - p))[:, None]).T @ x / len(y) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int):
    """Letter model, feature weights (as many as the bounded sample's words have) and the logistic function's weights; None without both labels."""
    model = letter_model(docs)
    learn = sample(docs, labels, "toxic", per_class).repartition(8)
    sizes = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return model, {}, None, float(bool(n1))
    counts = learn.mapInPandas(_feature_counts(model), "feature string, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    weight = F.expr(f"log((c1 + 0.5D) / {n1 + 1}) - log((c0 + 0.5D) / {n0 + 1}) - sqrt(1 / (c1 + 0.5D) + 1 / (c0 + 0.5D))")
    chosen = counts.where("c1 >= 2").withColumn("weight", weight).where("weight > 1")
    weights = {r["feature"]: r["weight"] for r in chosen.select("feature", "weight").collect()}
    fit = learn.select("doc_id", "y", "text").mapInPandas(_strengths(model, weights), "doc_id long, y int, " + _EVIDENCE_TYPE).toPandas()
    return model, weights, _logistic(fit[EVIDENCE].to_numpy(), fit["y"].to_numpy(float)), n1 / (n0 + n1)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for every document."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    model, weights, w, share = train(docs, labels, per_class)
    if w is None:
        scored = docs.select("doc_id", F.lit(share).alias("score"))
    else:
        rated = docs.mapInPandas(_strengths(model, weights), "doc_id long, " + _EVIDENCE_TYPE)
        logit = " + ".join([f"{float(x)!r}D * {name}" for x, name in zip(w, EVIDENCE, strict=False)] + [f"{float(w[-1])!r}D"])
        scored = rated.select("doc_id", F.expr(f"1 / (1 + exp(-({logit})))").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
