"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Every passage of every whole text is encoded as a vector: hashed byte
trigrams, and shares of capitals, digits, symbols, exclamation marks, repeated and distinct words. A small network embeds
the passages, learns from document labels alone how much attention each deserves (tanh and sigmoid gates), and scores
the attention-weighted sum. It is fitted in numpy on a bounded sample of labelled documents (per_class of each label at
most, in hash order) and then scores all documents in one Arrow pass, without a shuffle.

Null and empty texts are one empty passage and get the score the network gives it. Rows without doc_id are left out;
repeated rows each return a row. Without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import held_out, sample
from gridloom.llm.textops import word_hashes
from gridloom.llm.util import ship_package

PASSAGE = 64
_TRIGRAMS = 64
_SHARES = 9
WIDTH = _TRIGRAMS + _SHARES


def _flag(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SPACE = _flag(b" \t\n\x0b\x0c\r")
_CLASSES = [_flag(bytes(range(65, 91))), _flag(b"0123456789"), _flag(b"#*$%&|<>"), _flag(b"!"), _flag(b".,;:?"), _flag(bytes(range(128, 192)))]


def encode(text: str | None) -> np.ndarray:
    """One row of WIDTH numbers for each passage of the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    if not tokens:
        return np.zeros((1, WIDTH), np.float32)
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    heads = starts[::PASSAGE].copy()
    heads[0] = 0
    n = heads.size
    sizes = np.diff(np.r_[heads, data.size]).astype(np.float32)
    counts = np.minimum(PASSAGE, len(tokens) - PASSAGE * np.arange(n)).astype(np.float32)
    out = np.empty((n, WIDTH), np.float32)
    of = np.repeat(np.arange(n), np.diff(np.r_[heads, data.size]))
    wide = data.astype(np.int64)
    tri = (wide[:-2] * 2654435761 + wide[1:-1] * 40503 + wide[2:] * 97) >> 7 & (_TRIGRAMS - 1)
    bags = np.bincount(of[: tri.size] * _TRIGRAMS + tri, minlength=n * _TRIGRAMS).reshape(n, _TRIGRAMS)
    out[:, :_TRIGRAMS] = 8 * bags / sizes[:, None]
    for i, flags in enumerate(_CLASSES):
        out[:, _TRIGRAMS + i] = 8 * np.add.reduceat(flags[data].astype(np.float32), heads) / sizes
    h = word_hashes(tokens)
    passage = np.arange(h.size) // PASSAGE
    _, ranks = np.unique(h, return_inverse=True)
    distinct = np.unique(passage * (ranks.max() + 1) + ranks) // (ranks.max() + 1)
    out[:, _TRIGRAMS + 6] = np.bincount(distinct, minlength=n) / counts
    same = np.r_[False, h[1:] == h[:-1]].astype(np.float32)
    out[:, _TRIGRAMS + 7] = np.bincount(passage, same, minlength=n) / counts
    out[:, _TRIGRAMS + 8] = np.log1p(counts) / 4
    return out


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "bag": [encode(t).astype(np.float16).tobytes() for t in batch["text"]]})


class AttentionMIL:
    """Gated-attention network for bags of passage vectors (numpy; forward, backward and Adam)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"E": init(WIDTH, hidden), "e": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def _forward(self, x: np.ndarray, heads: np.ndarray):
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        sizes = np.diff(np.r_[heads, len(x)])
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, heads), sizes))
        a /= np.repeat(np.add.reduceat(a, heads), sizes)
        bag = np.add.reduceat(h * a[:, None], heads)
        return z, h, t, g, a, sizes, bag, bag @ p["c"] + p["b"][0]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        heads = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return 1 / (1 + np.exp(-np.clip(self._forward(np.concatenate(bags).astype(float), heads)[-1], -30, 30)))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(11)
        every = np.concatenate(bags).astype(float)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        share = np.clip(y.mean(), 0.01, 0.99)
        self.p["b"][:] = np.log(share / (1 - share))
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        epochs = max(epochs, min(400, 20_000 // max(1, len(bags))))
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(bags), batch):
                pick = order[lo : lo + batch]
                group = [bags[i] for i in pick]
                heads = np.cumsum([0, *(len(b) for b in group[:-1])])
                z, h, t, g, a, sizes, bag, logit = self._forward(np.concatenate(group).astype(float), heads)
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[pick]) / len(pick)
                p = self.p
                dbag = d[:, None] * p["c"]
                up = np.repeat(dbag, sizes, axis=0)
                da = (up * h).sum(1)
                ds = a * (da - np.repeat(np.add.reduceat(a * da, heads), sizes))
                dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
                dh = (up * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
                grad = {"E": z.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": bag.T @ d, "b": np.array([d.sum()])}
                step += 1
                for k in p:
                    gk = grad[k] + decay * p[k] * (k != "b")
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk * gk
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def _score(model: AttentionMIL | None, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, scores = batch["text"].tolist(), []
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                scores.append(model.scores([encode(t) for t in part]) if model else np.full(len(part), share))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(scores) if scores else []})

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4_000) -> tuple[AttentionMIL | None, float]:
    """The network, and the share of label 1; both from 2 * per_class labelled documents at most, none held out."""
    ship_package(docs.sparkSession)
    learn = sample(docs, labels, "quality", per_class).mapInPandas(_bags, "doc_id long, y int, bag binary").toPandas().sort_values("doc_id", kind="stable")
    y = learn["y"].to_numpy(float)
    if not y.size or y.min() == y.max():
        return None, float(y.mean()) if y.size else 0.5
    model = AttentionMIL()
    model.fit([np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float32) for b in learn["bag"]], y)
    return model, float(y.mean())


def quality_classifier(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    model, share = train(docs, labels, per_class)
    scored = docs.mapInPandas(_score(model, share), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
