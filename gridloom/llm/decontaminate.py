"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are maximal runs of characters other than space and tab to carriage return, lower-cased; shingles are five words
(the whole item where it is shorter). Everything is DataFrame functions:

1. Every shingle of every whole text is hashed in place and probed against the shingles of the items. A window of
   weighted similarity s with an item holds shingles of at least s of the item's weight, so documents that do not hold
   that much of an item in all need no window: this loses nothing.
2. Every item-sized window of the remaining documents that holds enough shared shingles for the similarity, wherever and in
   whatever order they stand, is fingerprinted: 64-bit SimHash over its weighted shingles. Windows of one size with
   weighted similarity s have 2 s / (1 + s) of their shingles in common, so this loses nothing either.
3. The fingerprints of windows and items of one size meet in a multi-index: 64 bits in BLOCKS parts, each item entered
   under every value within RADIUS // BLOCKS bits of each part. Two fingerprints within RADIUS bits agree so closely
   in one part at least, so the index returns all of them.
4. Candidates within RADIUS are verified on the exact weights: sum of smaller over sum of larger shingle counts.

The items' shingles are counted before they are broadcast; beyond the size bound they are joined with a shuffle.
Null and empty texts and items match nothing; rows without doc_id or item_id are left out; repeated rows count once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.util import BROADCAST_BYTES, materialize, release, scratch, small

SHINGLE = 5
#: Bits by which two fingerprints may differ; three standard deviations beyond what a similarity of 0.8 makes likely.
RADIUS = 19
#: Bits of the parts of a fingerprint.
PARTS = (13, 13, 13, 13, 12)


def with_words(df: DataFrame, key: str) -> DataFrame:
    """key and words (lower-cased) of rows with a text; a text without words has one empty word."""
    clean = "trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM lower(text))"
    return df.where(f"{key} is not null and text is not null").select(F.col(key).cast("long").alias(key), F.expr(f"split({clean}, '[ \\\\t-\\\\r]+')").alias("words"))


def _hashes(words: str, length: int) -> str:
    """Hash of each `length` consecutive words of the array, in order."""
    parts = ", ".join(f"get({words}, i + {j})" if j else f"get({words}, i)" for j in range(length))
    return f"if(size({words}) >= {length}, transform(sequence(0, size({words}) - {length}), i -> xxhash64({parts}, {length})), cast(array() as array<bigint>))"


def _simhash(hashes: str) -> str:
    """64-bit fingerprint: each bit is the majority of that bit over the shingles, repeats counted."""
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(aggregate({hashes}, 0, (s, h) -> s + if((shiftright(h, b) & 1L) = 1L, 1, -1)) > 0, shiftleft(1L, b), 0L))"


def _part(fingerprint: str, k: int) -> str:
    return f"(shiftrightunsigned({fingerprint}, {sum(PARTS[:k])}) & {(1 << PARTS[k]) - 1}L)"


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def multi_index(fingerprints: DataFrame, value: str, exact: bool) -> DataFrame:
    """Adds part (number and value in one) under which `value` is entered: near values too, unless exact."""
    near = RADIUS // len(PARTS)
    parts = []
    for k, bits in enumerate(PARTS):
        at = f"shiftleft({k}L, 32) | {_part(value, k)}"
        parts.append(f"array({at})" if exact else f"transform(array({', '.join(f'{m}L' for m in _masks(bits, near))}), m -> shiftleft({k}L, 32) | ({_part(value, k)} ^ m))")
    return fingerprints.withColumn("part", F.explode(F.expr(f"concat({', '.join(parts)})")))


def meet(printed: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, size, start, item_id): fingerprints of windows with those of items of one size within RADIUS bits.

    An item has about 1,800 entries, which Spark's own estimate does not know of: they are counted, and are broadcast only if they fit.
    """
    index = multi_index(prints.select("item_id", "size", "item_print"), "item_print", exact=False)
    rows = prints.count() * sum(len(_masks(bits, RADIUS // len(PARTS))) for bits in PARTS)
    index = small(index, rows, 40) if rows * 40 <= BROADCAST_BYTES else index.hint("merge")
    near = multi_index(printed, "print", exact=True).join(index, ["size", "part"]).where(f"bit_count(print ^ item_print) <= {RADIUS}")
    return near.select("doc_id", "size", "start", "item_id").distinct()


def _shared(a: str, b: str) -> str:
    """Sum of the smaller counts of the hashes in two arrays."""
    return f"aggregate(array_distinct({a}), 0, (s, h) -> s + least(size(filter({a}, x -> x = h)), size(filter({b}, x -> x = h))))"


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start): each item that a document holds, with its best window's first word."""
    release(docs.sparkSession)
    items = with_words(benchmark, "item_id").where("words[0] <> ''").withColumn("size", F.size("words")).withColumn("length", F.least("size", F.lit(SHINGLE)))
    lengths = sorted(r["length"] for r in items.select("length").distinct().limit(SHINGLE).collect())
    texts = with_words(docs, "doc_id")
    found, forms = [], []
    for length in lengths:
        forms.append(items.where(F.col("length") == length).select("item_id", "size", "length", F.expr(_hashes("words", length)).alias("hashes")))
    if not forms:
        return texts.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start")).limit(0)
    formed = forms[0]
    for form in forms[1:]:
        formed = formed.union(form)
    formed = materialize(formed.distinct(), "items")
    entries = formed.select("item_id", "size", "length", F.size("hashes").alias("weight"), F.posexplode("hashes").alias("off", "hash"))
    n = entries.count()
    weights = entries.groupBy("hash", "item_id", "weight").agg(F.count("*").alias("own"))
    for length in lengths:
        shingles = texts.select("doc_id", F.posexplode(F.expr(_hashes("words", length))).alias("pos", "hash"))
        met = shingles.join(small(weights, n, 64), "hash").groupBy("doc_id", "item_id", "weight", "hash").agg(F.first("own").alias("own"))
        found.append(met.groupBy("doc_id", "item_id").agg(F.sum("own").alias("held"), F.first("weight").alias("weight")).where(F.col("held") >= least * F.col("weight")).select("doc_id", "item_id"))
    held = found[0]
    for more in found[1:]:
        held = held.union(more)
    held = materialize(held.distinct(), "held")
    ids = held.select("doc_id").distinct()
    few = materialize(texts.join(small(ids, held.count(), 16), "doc_id").distinct(), "few")

    release(docs.sparkSession)
    windows = []
    for length in lengths:
        own = held.join(entries.where(F.col("length") == length), "item_id").select("doc_id", "item_id", "size", "hash").distinct()
        # a window's shingles are a slice of its document's
        hashed = materialize(few.select("doc_id", F.size("words").alias("n"), F.expr(_hashes("words", length)).alias("hashes")), "hashed")
        shingles = hashed.select("doc_id", "n", F.posexplode("hashes").alias("pos", "hash"))
        about = own.join(shingles, ["doc_id", "hash"]).select("doc_id", "item_id", "size", "n", "pos")
        around = f"if(n >= size, sequence(greatest(0, pos - size + {length}), least(pos, n - size)), cast(array() as array<int>))"
        enough = f"count(*) * {1 + least!r}D >= {2 * least!r}D * (size - {length - 1}) - 1e-6D"
        starts = about.select("doc_id", "item_id", "size", F.explode(F.expr(around)).alias("start")).groupBy("doc_id", "item_id", "size", "start").agg(F.expr(enough).alias("enough")).where("enough").select("doc_id", "size", "start").distinct()
        # a document that is shorter than the item has one window, itself
        whole = about.where("n < size").select("doc_id", "size", F.lit(0).alias("start")).distinct()
        windows.append(starts.union(whole).join(hashed.select("doc_id", "hashes"), "doc_id").select("doc_id", "size", "start", F.expr(f"slice(hashes, start + 1, size - {length - 1})").alias("window")))
    every = windows[0]
    for more in windows[1:]:
        every = every.union(more)
    # both are written down so that no later expression evaluates a window or a fingerprint again
    cut = materialize(every.where("size(window) > 0"), "cut")
    printed = materialize(cut.select("doc_id", "size", "start", F.expr(_simhash("window")).alias("print")), "printed")
    prints = materialize(formed.withColumn("item_print", F.expr(_simhash("hashes"))), "prints")
    once = meet(printed, prints)
    whole = once.join(cut, ["doc_id", "size", "start"]).join(prints.select("item_id", "hashes"), "item_id")
    both = whole.select("doc_id", "item_id", "start", F.expr("size(window) + size(hashes)").alias("sizes"), F.expr(_shared("window", "hashes")).alias("both"))
    alike = materialize(both, "verified").withColumn("similarity", F.expr("both / (sizes - both)")).where(F.col("similarity") >= least)
    return alike.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")).select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents that hold no item, unchanged; rows without doc_id stay."""
    with scratch() as keep:
        dirty = keep(leaks(docs, benchmark, least).select("doc_id").distinct(), "dirty")
    return docs.join(small(dirty, dirty.count(), 16), "doc_id", "left_anti").select(docs.columns)
