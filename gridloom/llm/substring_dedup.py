"""Removal of word spans that an earlier document already has: de Bruijn paths of repeated passages.

Every k consecutive words (k = 13) are an edge of the de Bruijn graph whose nodes are (k-1)-word sequences.

1. Map: each task hashes the k-mers of its documents, sorts them and settles what it can see locally: a window that
   a smaller document of the same task has too needs no shuffle, so a passage that a third of all documents share
   costs each task one record. What is left is packed by hash range: six bytes of hash difference, a document number
   and a position for each window.
2. Edge join: each hash range finds, for every repeated edge, the smallest document with it (the edge's source
   coordinates), and sends the edge to the other documents that walk through it. Ranges and buckets hold BUCKET_BYTES of text
   each, so their number follows the input and one task's memory does not.
3. Compaction: along a document, edges whose source coordinates advance with them meet at nodes that are nonbranching
   for this walk, and become one path (start, edges, source, source start). Only the paths' ends are kept as nodes. Documents
   that repeat the same passage share its path, so the distinct paths are grouped by Spark before they are looked up.
4. Verification: the distinct paths are joined with their source documents, which return a 128-bit digest of the very words under
   the path; these are joined with the walks. A document gives up a path's words only if its own words there have that digest.
5. Edges of paths that do not verify (64-bit hashes that collide, rows that share a doc_id) are compared as words: all
   windows of those hashes are grouped by their word sequence. Without such edges, which is the rule, nothing runs here.

Nulls and texts without words give n_words 0, n_removed 0 and the digest of the empty string; texts under k words
lose nothing; rows without doc_id are left out; rows that repeat a doc_id are each judged by their own text, against smaller
doc_ids. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textops
from gridloom.llm.util import materialize, ship_package, small

#: Windows that a map task gathers before it sorts and ships them; bounds its memory (about 40 bytes each).
FLUSH_WINDOWS = 1_500_000
#: Bytes of text whose windows make a hash range, and whose documents make a bucket.
BUCKET_BYTES = 12 << 20
#: Distinct paths of one source that are looked up together.
PATHS = 2000

_PACKED = "bucket int, n long, hashes binary, wide boolean, docs binary, counts binary, owner binary, pos binary, pos_width int"
_EDGES = "bucket int, blob binary, src binary, meta binary"


def _narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Unsigned numbers in two bytes each if they fit, else four or eight."""
    width = 2 if not values.size or values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8
    return values.astype(f"<u{width}").tobytes(), width


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of each hash range in sorted hashes."""
    edges = [(i << 64) // parts for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, np.uint64)), [hashes.size]]).astype(np.int64)


def _edge_rows(doc: np.ndarray, pos: np.ndarray, src: np.ndarray, spos: np.ndarray, parts: int) -> pd.DataFrame:
    """Edges packed by the document's bucket: sorted by document, source and position."""
    rows = []
    where = doc % parts
    order = np.lexsort((pos, src, doc, where))
    doc, pos, src, spos, where = doc[order], pos[order], src[order], spos[order], where[order]
    cut = np.flatnonzero(np.diff(where)) + 1
    for lo, hi in zip(np.r_[0, cut], np.r_[cut, where.size], strict=True):
        if hi > lo:
            d, s = doc[lo:hi], src[lo:hi]
            head = np.r_[True, (np.diff(d) != 0) | (np.diff(s) != 0)]
            at = np.flatnonzero(head)
            counts = np.diff(np.r_[at, hi - lo]).astype("<u4")
            p, width = _narrow(pos[lo:hi].astype(np.int64))
            pairs = np.stack([d[at], s[at]]).astype("<i8").tobytes()
            meta = np.array([at.size, hi - lo, width], "<i8").tobytes() + counts.tobytes()
            rows.append((int(where[lo]), p + (pos[lo:hi] - spos[lo:hi]).astype("<i4").tobytes(), pairs, meta))
    return pd.DataFrame(rows, columns=["bucket", "blob", "src", "meta"])


def _unpack_edges(blob: bytes, src: bytes, meta: bytes) -> tuple[np.ndarray, ...]:
    groups, n, width = np.frombuffer(meta[:24], "<i8")
    counts = np.frombuffer(meta[24:], "<u4")
    pairs = np.frombuffer(src, "<i8").reshape(2, groups)
    pos = np.frombuffer(blob[: n * width], f"<u{width}").astype(np.int64)
    spos = pos - np.frombuffer(blob[n * width :], "<i4")
    return np.repeat(pairs[0], counts), pos, np.repeat(pairs[1], counts), spos


def _ship(k: int, parts: int, flush_windows: int):
    """Stage 1: windows packed by hash range and, with n = 0, edges settled within the task packed by document bucket."""

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        held.sort(key=lambda x: x[0])
        ids = np.array([d for d, _ in held], np.int64)
        sizes = np.array([h.size for _, h in held], np.int64)
        hashes = np.concatenate([h for _, h in held])
        owner = np.repeat(np.arange(ids.size), sizes)
        pos = np.arange(hashes.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner, pos = hashes[order], owner[order], pos[order]
        head = np.r_[True, hashes[1:] != hashes[:-1]]
        at = np.flatnonzero(head)
        first = np.repeat(at, np.diff(np.r_[at, hashes.size]))
        later = ids[owner] != ids[owner[first]]
        if later.any():
            f = first[later]
            packed = _edge_rows(ids[owner[later]], pos[later], ids[owner[f]], pos[f], parts)
            yield pd.DataFrame({"bucket": packed["bucket"], "n": 0, "hashes": packed["blob"], "wide": False, "docs": packed["src"], "counts": packed["meta"], "owner": b"", "pos": b"", "pos_width": 0})
        hashes, owner, pos = hashes[~later], owner[~later], pos[~later]
        cut, rows = _ranges(hashes, parts), []
        for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if hi > lo:
                step = np.diff(hashes[lo:hi], prepend=np.uint64(0))
                step[0] = hashes[lo]
                wide = bool(step[1:].max(initial=np.uint64(0)) >= np.uint64(1 << 48))
                body = step.view(np.uint8).reshape(-1, 8)
                body = body.tobytes() if wide else body[0].tobytes() + np.ascontiguousarray(body[1:, :6]).tobytes()
                used, own = np.unique(owner[lo:hi], return_inverse=True)
                o, ow = _narrow(own)
                p, pw = _narrow(pos[lo:hi])
                # the documents' numbers are sorted: the first one and the differences
                steps, dw = _narrow(np.diff(ids[used]))
                rows.append((b, hi - lo, body, wide, ids[used[:1]].astype("<i8").tobytes() + steps, bytes([ow, dw]), o, p, pw))
        yield pd.DataFrame(rows, columns=["bucket", "n", "hashes", "wide", "docs", "counts", "owner", "pos", "pos_width"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = textops.window_hashes(textops.word_hashes(textops.words(text)), k)
                if h.size:
                    held.append((int(doc), h))
                    size += h.size
                    if size >= flush_windows:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _meet(parts: int):
    """Stage 2: all windows of one hash range; gives the edges that a smaller document has, with source coordinates, and passes settled edges on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        settled = pdf[pdf["n"] == 0]
        passed = pd.DataFrame({"bucket": settled["bucket"], "blob": settled["hashes"], "src": settled["docs"], "meta": settled["counts"]})
        hs, ds, ps = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for r in pdf[pdf["n"] > 0].itertuples():
            n = int(r.n)
            if r.wide:
                step = np.frombuffer(r.hashes, "<u8")
            else:
                step = np.zeros((n, 8), np.uint8)
                step[0] = np.frombuffer(r.hashes[:8], np.uint8)
                step[1:, :6] = np.frombuffer(r.hashes[8:], np.uint8).reshape(-1, 6)
                step = step.reshape(-1).view("<u8")
            hs.append(np.cumsum(step, dtype=np.uint64))
            own = np.frombuffer(r.owner, f"<u{r.counts[0]}")
            steps = np.frombuffer(r.docs[8:], f"<u{r.counts[1]}").astype(np.int64)
            ds.append((np.frombuffer(r.docs[:8], "<i8") + np.concatenate([[0], np.cumsum(steps)]))[own])
            ps.append(np.frombuffer(r.pos, f"<u{r.pos_width}").astype(np.int64))
        h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
        order = np.argsort(h, kind="stable")
        h, d, p = h[order], d[order], p[order]
        same = h[1:] == h[:-1]
        keep = (np.r_[False, same] | np.r_[same, False])[: h.size]
        h, d, p = h[keep], d[keep], p[keep]
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if h.size else np.empty(0, np.int64)
        first = np.repeat(at, np.diff(np.r_[at, h.size]))
        later = d != d[first]
        f = first[later]
        return pd.concat([passed, _edge_rows(d[later], p[later], d[f], p[f], parts)], ignore_index=True)

    return run


_PATHS = "doc_id long, start int, edges int, src long, sstart int"


def compact(doc: np.ndarray, pos: np.ndarray, src: np.ndarray, spos: np.ndarray) -> pd.DataFrame:
    """Paths: edges of a document whose source coordinates advance with them."""
    order = np.lexsort((pos, spos - pos, src, doc))
    doc, pos, src, spos = doc[order], pos[order], src[order], spos[order]
    # rows that share a doc_id may give an edge twice
    once = np.r_[True, (np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(pos) != 0) | (np.diff(spos) != 0)][: doc.size]
    doc, pos, src, spos = doc[once], pos[once], src[once], spos[once]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(pos) != 1) | (np.diff(spos) != 1)][: doc.size]
    at = np.flatnonzero(new)
    return pd.DataFrame({"doc_id": doc[at], "start": pos[at], "edges": np.diff(np.r_[at, doc.size]), "src": src[at], "sstart": spos[at]})


def _compacted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stage 3: the paths of one document bucket."""
    edges = [_unpack_edges(r.blob, r.src, r.meta) for r in pdf.itertuples()]
    return compact(*(np.concatenate(x) for x in zip(*edges, strict=True)))


class _Words:
    """The words of a text, joined by single spaces, and digests of runs of them."""

    def __init__(self, text: str | None):
        self.tokens = textops.words(text)
        self.data = b" ".join(self.tokens)
        self.at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.tokens], dtype=np.int64)])

    def digest(self, start: int, n: int) -> bytes | None:
        """Of n words from start; None where there are not so many."""
        if start + n > len(self.tokens):
            return None
        return xxhash.xxh3_128_digest(self.data[self.at[start] : self.at[start + n] - 1])


def _source_digests(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for src, text, paths in zip(batch["src"], batch["text"], batch["paths"], strict=True):
                held = _Words(text)
                rows += [(int(src), int(p["sstart"]), int(p["edges"]), held.digest(int(p["sstart"]), int(p["edges"]) + k - 1)) for p in paths]
            yield pd.DataFrame([r for r in rows if r[3] is not None], columns=["src", "sstart", "edges", "mark"])

    return run


def _verified_walks(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(doc_id, walks): each document's paths with the digests that the words under them may have."""
    distinct = materialize(paths.select("src", "sstart", "edges").distinct(), "distinct-paths")
    sizes = materialize(distinct.groupBy("src").agg(F.count("*").alias("n")), "sources")
    asked = distinct.join(small(sizes, sizes.count(), 24), "src").withColumn("part", F.expr(f"pmod(xxhash64(sstart, edges), cast(ceil(n / {PATHS}) as bigint))"))
    asked = materialize(asked.groupBy("src", "part").agg(F.collect_list(F.struct("sstart", "edges")).alias("paths")), "asked")
    n, held = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("paths")), F.lit(0))).first()
    sources = docs.withColumnRenamed("doc_id", "src").join(small(asked, 5 * n + held, 8), "src").select("src", "text", "paths")
    marks = sources.mapInPandas(_source_digests(k), "src long, sstart int, edges int, mark binary")
    marks = materialize(marks.groupBy("src", "sstart", "edges").agg(F.collect_set("mark").alias("marks")), "marks")
    walks = paths.join(small(marks, marks.count(), 64), ["src", "sstart", "edges"], "left")
    return materialize(walks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges", "marks")).alias("walks")), "walks")


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_paths long, text string, unsure array<long>"


def _cut(k: int, keep_text: bool):
    """The last stage: each text without the words under its verified paths, and the hashes of edges that did not verify."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, walks, exact in zip(batch["doc_id"], batch["text"], batch["walks"], batch["exact"], strict=True):
                held = _Words(text)
                n, paths, unsure = len(held.tokens), 0, []
                gone = np.zeros(n + 1, np.int64)
                for walk in walks if walks is not None else ():
                    start, edges = int(walk["start"]), int(walk["edges"])
                    own = held.digest(start, edges + k - 1)
                    if own is not None and walk["marks"] is not None and any(own == bytes(m) for m in walk["marks"]):
                        gone[start] += 1
                        gone[start + edges + k - 1] -= 1
                        paths += 1
                    elif start + k <= n:
                        unsure.append((start, edges))
                if exact is not None:
                    tag = _tag(text)
                    for window in exact:
                        if window["tag"] == tag:
                            gone[window["pos"]] += 1
                            gone[window["pos"] + k] -= 1
                hashes = []
                if unsure:
                    every = textops.window_hashes(textops.word_hashes(held.tokens), k).view(np.int64)
                    hashes = np.unique(np.concatenate([every[s : s + e] for s, e in unsure])).tolist()
                left = np.flatnonzero(np.cumsum(gone[:n]) == 0)
                body = held.data if left.size == n else b" ".join([held.tokens[i] for i in left.tolist()])
                out.append((int(doc), n, n - left.size, hashlib.sha256(body).hexdigest(), paths, body.decode("utf-8", "replace") if keep_text else None, hashes))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "n_paths", "text", "unsure"])

    return run


def _tag(text: str | None) -> int:
    """Tells rows of one doc_id apart."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _windows(k: int):
    """Every window with its hash, row and words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = textops.words(text)
                hashes = textops.window_hashes(textops.word_hashes(tokens), k)
                if hashes.size:
                    told = [b" ".join(tokens[i : i + k]).decode("utf-8", "surrogatepass") for i in range(hashes.size)]
                    yield pd.DataFrame({"doc_id": int(doc), "tag": _tag(text), "pos": np.arange(hashes.size), "hash": hashes.view(np.int64), "words": told})

    return run


def _exact(docs: DataFrame, unsure: DataFrame, k: int) -> DataFrame:
    """(doc_id, exact): windows of the unsure hashes whose very words a smaller document has."""
    hashes = materialize(unsure.select(F.explode("unsure").alias("hash")).distinct(), "unsure")
    met = docs.mapInPandas(_windows(k), "doc_id long, tag long, pos int, hash long, words string").join(small(hashes, hashes.count(), 16), "hash")
    met = materialize(met.select("doc_id", "tag", "pos", "words"), "unsure-windows")
    first = met.groupBy("words").agg(F.min("doc_id").alias("first"))
    later = met.join(first, "words").where("doc_id > first")
    return materialize(later.groupBy("doc_id").agg(F.collect_set(F.struct("tag", "pos")).alias("exact")), "exact")


def _joined(docs: DataFrame, lists: DataFrame, column: str, width: int) -> DataFrame:
    """docs with the lists of their doc_id, or null."""
    n, held = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return docs.join(small(lists, 4 * n + held, width), "doc_id", "left")


def substring_dedup(docs: DataFrame, k: int = 13, keep_text: bool = True, flush_windows: int = FLUSH_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_paths, and text (the kept words) if keep_text."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES), 1)
    met = docs.mapInPandas(_ship(k, parts, flush_windows), _PACKED).groupBy("bucket").applyInPandas(_meet(parts), _EDGES)
    paths = materialize(met.groupBy("bucket").applyInPandas(_compacted, _PATHS), "paths")
    walking = _joined(docs, _verified_walks(docs, paths, k), "walks", 80)
    none = F.lit(None).cast("array<struct<tag: bigint, pos: int>>").alias("exact")
    result = materialize(walking.select("doc_id", "text", "walks", none).mapInPandas(_cut(k, keep_text), _RESULT), "cut")
    unsure = result.where("size(unsure) > 0")
    if not unsure.isEmpty():
        again = _joined(walking, _exact(docs, unsure, k), "exact", 24)
        result = again.select("doc_id", "text", "walks", "exact").mapInPandas(_cut(k, keep_text), _RESULT)
    return result.drop("unsure") if keep_text else result.drop("unsure", "text")
