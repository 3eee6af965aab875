"""Exact Jaccard self-join of documents on word n-grams, as components: rare-first prefix filtering.

1. One pass counts every n-gram of every document in a fixed table of 2**sketch_bits counters (summed in each task,
   then by block of the table). The counts order the n-grams, rare first; ties go by hash. Any one order keeps the join
   exact, so the table's fixed size costs candidates only, never results.
2. A second pass gives each document its set size, a 128-bit digest of its set, the prefix of its set in that order
   (n - ceil(t n) + 1 n-grams: two sets of similarity t share one of them) and a 32-part histogram of the set.
   Documents with equal sets collapse to the smallest doc_id before anything is joined.
3. Documents that share a prefix n-gram are candidates. Large groups of near copies make no square of pairs: under each
   prefix n-gram and length band, all documents are first compared with two leaders (the one with the fewest rarer
   n-grams before it, which is close to what the copies have in common, and one by hash), which connects near copies. Then only n-grams that still hold several components give pairs, and only of different
   components; those are complete, so no link between components is missed.
4. Length filter, positional filter (what can follow the first shared n-gram) and suffix filter (histograms bound the
   Hamming distance of the sets) drop pairs; what is left is verified once per pair on the whole sets.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased. Null and empty texts have an empty
set, link with nothing and are their own component. Rows without doc_id are left out; rows that share a doc_id count as
one document of the graph and each returns a row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.graph import components
from gridloom.llm.textops import shingle_set, words
from gridloom.llm.util import materialize, release, scratch, ship_package, small, small_batches

_BLOCK = 1 << 13
#: Documents of one set from which their group is joined by a broadcast of its representative.
_COPIES = 1000
_HIST_BITS = 5


def _lower(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _count(n: int, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << bits, np.int64)
        shift = np.uint64(64 - bits)
        for batch in batches:
            sets = [shingle_set(_lower(t), n) for t in batch["text"]]
            if sets:
                table += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=table.size)
        if table.any():
            blocks = table.reshape(-1, min(_BLOCK, table.size))
            yield pd.DataFrame({"block": np.arange(len(blocks)), "counts": [b.tobytes() for b in blocks]})

    return run


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"], batch["counts"], strict=True):
            got = np.frombuffer(counts, np.int64)
            total[block] = total[block] + got if block in total else got
    if total:
        yield pd.DataFrame({"block": list(total), "counts": [x.tobytes() for x in total.values()]})


def ngram_counts(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Counters of all n-grams of all documents, by the first bits of their hash; 8 << bits bytes whatever the input."""
    parts = docs.mapInPandas(_count(n, bits), "block int, counts binary")
    table = np.zeros((max(1, (1 << bits) // _BLOCK), min(_BLOCK, 1 << bits)), np.int64)
    with small_batches(docs.sparkSession):
        summed = parts.repartition(len(table), "block").mapInPandas(_sum, "block int, counts binary").collect()
    for row in summed:
        table[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1)


def _prefixes(n: int, percent: int, bits: int, ranks):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, shift, top = ranks.value, np.uint64(64 - bits), np.uint64(64 - _HIST_BITS)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                grams = shingle_set(_lower(text), n)
                size = grams.size
                digest = xxhash.xxh3_128_digest(grams.tobytes())
                hi, lo = np.frombuffer(digest, "<i8").tolist()
                keep = size - -(-percent * size // 100) + 1 if size else 0
                order = np.lexsort((grams, counts[(grams >> shift).astype(np.int64)]))[:keep]
                rows.append((int(doc), size, hi, lo, grams[order].view(np.int64), np.bincount((grams >> top).astype(np.int64), minlength=1 << _HIST_BITS)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "hi", "lo", "prefix", "hist"])

    return run


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pd.DataFrame({"id": batch["doc_id"], "blob": [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]})


def _verify(n: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, held = zstandard.ZstdDecompressor(), {}

        def grams(doc: int, blob: bytes) -> np.ndarray:
            if doc not in held:
                if len(held) >= 64:
                    held.pop(next(iter(held)))
                held[doc] = shingle_set(unpack.decompress(blob).lower().split(), n)
            return held[doc]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["blob_a"], batch["blob_b"], strict=True):
                g, h = grams(a, x), grams(b, y)
                both = np.intersect1d(g, h, assume_unique=True).size
                ok.append(100 * both >= percent * (g.size + h.size - both))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": ok})

    return run


def _needed(percent: int) -> str:
    """Smallest overlap of sets of na and nb n-grams at the similarity."""
    return f"-floor(-({percent} * (na + nb)) / {100 + percent})"


def _filtered(pairs: DataFrame, hists: DataFrame, percent: int) -> DataFrame:
    """(a, b) once each, after the length, positional and suffix filters; pairs holds a, b, na, nb, pa, pb.

    A pair may come with several shared n-grams; the positional filter takes each for the first shared one, before which
    the sets have nothing in common. For the pair's true first one that is so, hence no linked pair is lost.
    """
    near = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and least(na - pa, nb - pb) >= {_needed(percent)}")
    once = near.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    with_a = once.join(hists.select(F.col("rep").alias("a"), F.col("hist").alias("ha")), "a")
    with_b = with_a.join(hists.select(F.col("rep").alias("b"), F.col("hist").alias("hb")), "b")
    apart = "aggregate(zip_with(ha, hb, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)"
    return with_b.where(f"{apart} <= na + nb - 2 * {_needed(percent)}").select("a", "b").distinct()


def _checked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, linked) for each pair, from the whole texts."""
    pairs = materialize(pairs, "pairs")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    with small_batches(docs.sparkSession):
        blobs = materialize(docs.join(small(ids, ids.count(), 16), "doc_id", "left_semi").mapInPandas(_blobs, "id long, blob binary"), "blobs")
    sides = pairs.join(blobs.select(F.col("id").alias("a"), F.col("blob").alias("blob_a")), "a").join(blobs.select(F.col("id").alias("b"), F.col("blob").alias("blob_b")), "b")
    with small_batches(docs.sparkSession):
        return materialize(sides.select("a", "b", "blob_a", "blob_b").mapInPandas(_verify(n, percent), "a long, b long, linked boolean"), "checked")


def ngram_join(docs: DataFrame, n: int = 4, percent: int = 85, sketch_bits: int = 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and rep_id (smallest doc_id with an equal set)."""
    spark = docs.sparkSession
    ship_package(spark)
    release(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ranks = spark.sparkContext.broadcast(ngram_counts(docs, n, sketch_bits))
    with small_batches(spark):
        sets = materialize(docs.mapInPandas(_prefixes(n, percent, sketch_bits, ranks), "doc_id long, n long, hi long, lo long, prefix array<long>, hist array<int>"), "sets")
    reps = sets.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    unique = sets.join(reps.select(F.col("rep").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi").withColumnRenamed("doc_id", "rep")
    hists = unique.select("rep", "hist")

    postings = unique.select("rep", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = postings.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) if percent < 100 else F.col("n")).cast("int")
    postings = materialize(postings.join(shared, "gram", "left_semi").withColumn("band", band), "postings")

    def lead(order: Column) -> DataFrame:
        first = F.min(F.struct(order.alias("order"), F.xxhash64("rep").alias("h"), F.col("rep").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos")))
        return postings.groupBy("gram", "band").agg(first.alias("l")).select("gram", "band", "l.lead", "l.lead_n", "l.lead_pos")

    def ordered(df: DataFrame) -> DataFrame:
        up = "rep < lead"
        return df.where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"), *(F.expr(f"if({up}, {x}, {y})").alias(z) for x, y, z in (("n", "lead_n", "na"), ("lead_n", "n", "nb"), ("pos", "lead_pos", "pa"), ("lead_pos", "pos", "pb"))))

    leads = materialize(lead(F.col("pos")).unionByName(lead(F.lit(0))).distinct(), "leads")
    below = leads.select("gram", (F.col("band") + 1).alias("band"), F.col("lead").alias("rep"), F.col("lead_n").alias("n"), F.col("lead_pos").alias("pos"))
    stars = ordered(postings.join(leads, ["gram", "band"])).unionByName(ordered(below.join(leads, ["gram", "band"])))
    checked = _checked(_filtered(stars, hists, percent), docs, n, percent)
    links = checked.where("linked").select("a", "b")

    found = components(links)
    release(spark)
    placed = postings.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed, "placed")
    several = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gram")
    left = placed.join(several, "gram", "left_semi")
    x = left.select("gram", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"), F.col("band").alias("band"))
    y = left.select("gram", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"), F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"))
    across = x.join(y, ["gram", "band"]).where("a < b and ca <> cb")
    rest = _filtered(across, hists, percent).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = _checked(rest, docs, n, percent).where("linked").select("a", "b")
    whole = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = materialize(reps.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("hi", "lo", "copies", "rep", F.coalesce("component", "rep").alias("component")), "named")
    # groups of many copies are few: they meet their documents where these are, the others by a shuffle
    many = named.where(F.col("copies") >= _COPIES).select("hi", "lo", F.struct("component", "rep").alias("group"))
    mine = sets.where("n > 0").select("doc_id", "n", "hi", "lo").join(small(many, many.count(), 48), ["hi", "lo"], "left")
    rest = mine.where("group is null").drop("group").join(named.where(F.col("copies") < _COPIES), ["hi", "lo"]).select("doc_id", "n", "component", "rep")
    alone = sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"), F.col("doc_id").alias("rep"))
    out = mine.where("group is not null").select("doc_id", "n", "group.component", "group.rep").union(rest).union(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("rep").alias("rep_id"))


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The documents, of each component only the one with the smallest doc_id; rows without doc_id stay."""
    with scratch() as keep:
        gone = keep(ngram_join(docs, n, percent).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(small(gone, gone.count(), 16), "doc_id", "left_anti").select(docs.columns)
