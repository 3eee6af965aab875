"""Runs of consecutive numbers: islands, merged intervals, and the curve ranges of a box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import curves


def islands(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., lo, hi) for each maximal run of consecutive integers; repeats count once. Windows are per group of `by`."""
    w = Window.partitionBy(*by).orderBy(value)
    runs = df.select(*by, value).distinct().withColumn("run", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*by, "run").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("run")


def merge_intervals(df: DataFrame, lo: str, hi: str, by: Sequence[str] = (), as_given: bool = False) -> DataFrame:
    """Union of closed integer intervals, ends in any order; touching ones (hi + 1 = lo) merge.

    as_given: ends are not put in order, and a null end is no end instead of the other one. Nulls sort last, as in DuckDB.
    """
    low, high = (F.col(lo), F.col(hi)) if as_given else (F.least(lo, hi), F.greatest(lo, hi))
    ends = df.select(*by, low.alias("lo"), high.alias("hi"))
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("lo"), F.asc_nulls_last("hi"))
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.withColumn("reach", reach).withColumn("new", F.when(F.expr("reach is null or lo > reach + 1"), 1).otherwise(0))
    runs = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def insert_values(intervals: DataFrame, values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Intervals (lo, hi) with single values added."""
    return merge_intervals(intervals.select(*by, "lo", "hi").unionByName(values.select(*by, F.col(value).alias("lo"), F.col(value).alias("hi"))), "lo", "hi", by)


def box_ranges(spark, name: str, k: int, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """(lo, hi): the curve ranges that cover a closed box exactly.

    A cell starts a range if the cell before it on the curve lies outside the box, and ends one if the cell after it does:
    two local tests, so only the starts and ends (not the cells) are matched, by order.
    """
    n = len(low)
    cells = spark.range(1)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        cells = cells.crossJoin(spark.range(a, b + 1).withColumnRenamed("id", f"c{i}"))
    d = curves.curve(name).forward([F.col(f"c{i}") for i in range(n)], k)
    placed = cells.select(d.alias("d"))

    def outside(at):
        back = curves.curve(name).inverse(at, k, n)
        return ~((at >= 0) & (at < (1 << (n * k))) & F.expr("true") & _inside(back, low, high))

    edges = placed.where(outside(F.col("d") - 1) | outside(F.col("d") + 1)).select("d", outside(F.col("d") - 1).alias("starts"), outside(F.col("d") + 1).alias("ends"))
    # the number of edges is bounded by the box's surface, not by the table that is searched
    ordered = edges.withColumn("hi", F.min(F.when(F.col("ends"), F.col("d"))).over(Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)))
    return ordered.where("starts").select(F.col("d").alias("lo"), "hi")


def _inside(coords, low, high):
    out = F.lit(True)
    for c, a, b in zip(coords, low, high, strict=True):
        out = out & c.between(a, b)
    return out
