"""Statistics of values and bytes: histograms, describe, differences, Shannon entropy, runs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, key).agg(F.count("*").alias("n"))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear interpolation), max; exact."""
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *(F.expr(f"percentile({value}, {q})").alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)), F.max(value).alias("max"))


def differences(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """by, order, diff: first differences in order, without the first row. One sort for each group of `by`."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(*by, order, (F.col(value) - F.lag(value).over(w)).alias("diff")).where("diff is not null")


def entropy(df: DataFrame, value: str, by: Sequence[str] = (), item_bytes: int = 1) -> DataFrame:
    """Shannon entropy to the base 256**item_bytes: two aggregations, the first by value. More symbols than the base raise."""
    base = 256**item_bytes
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("symbols"), F.sum(F.col("c") * F.log("c")).alias("s"))
    fits = F.when(F.col("symbols") <= base, (F.log("n") - F.col("s") / F.col("n")) / math.log(base)).otherwise(F.raise_error(F.lit("more symbols than the base")).cast("double"))
    return total.select(*by, F.col("n"), F.col("symbols"), fits.alias("entropy"))


def block_entropy(df: DataFrame, value: str, position: str, block: int = 16384, by: Sequence[str] = (), item_bytes: int = 1) -> DataFrame:
    """Entropy of each block of consecutive positions."""
    return entropy(df.withColumn("block", F.expr(f"{position} div {block}")), value, [*by, "block"], item_bytes)


def runs(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """by, start, value, n: maximal runs of equal values in order."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = df.withColumn("new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1))
    marked = changed.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", value).agg(F.min(order).alias("start"), F.count("*").alias("n")).drop("run")


def capped_runs(df: DataFrame, value: str, order: str, by: Sequence[str] = (), cap: int = 255) -> DataFrame:
    """Runs cut into pieces of at most cap, as the run-length code stores them."""
    pieces = runs(df, value, order, by).withColumn("piece", F.explode(F.expr(f"sequence(0, cast((n - 1) div {cap} as int))")))
    return pieces.select(*by, "start", value, "piece", F.least(F.lit(cap), F.col("n") - F.col("piece") * cap).alias("n"))


def text_bytes(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """by, pos, byte: the UTF-8 bytes of a text column."""
    hexed = df.select(*by, F.hex(F.encode(text, "UTF-8")).alias("h"))
    return hexed.select(*by, F.posexplode(F.expr("transform(sequence(1, greatest(length(h), 2) - 1, 2), i -> if(h = '', null, cast(conv(substring(h, i, 2), 16, 10) as int)))")).alias("pos", "byte")).where("byte is not null")


def byte_histogram(df: DataFrame, text: str, by: Sequence[str]) -> DataFrame:
    """by, byte, n: how often each byte is in the UTF-8 form of a text column.

    Each text is counted where it is, so that only its distinct bytes become rows; equal keys are summed afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = np.stack([np.bincount(np.frombuffer(b or b"", np.uint8), minlength=256) for b in part.column(len(by)).to_pylist()])
                row, byte = counts.nonzero()
                keys = [part.column(i).take(pa.array(row)) for i in range(len(by))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(byte.astype(np.int32)), pa.array(counts[row, byte].astype(np.int64))], names=[*by, "byte", "n"])

    texts = df.select(*by, F.col(text).cast("binary"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{fields}byte int, n long").groupBy(*by, "byte").agg(F.sum("n").alias("n"))
