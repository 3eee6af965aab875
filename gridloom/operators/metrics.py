"""Locality metrics of curves: histograms over windows, pairs and edges of a grid of side 2**k.

Each returns (key..., regions, normalised), lazily. `exact` and `corrected` give the mathematically plain variant beside
the published one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import curves
from gridloom.functions.geometry import euclidean
from gridloom.operators.arrays import permutation

_AXES = ["x", "y", "z"]


def pair_normaliser(cells: int) -> float:
    """(n - 1)(n - 2) / 2, the published constant of the pair metrics; n (n - 1) / 2 pairs exist."""
    return (cells - 1) * (cells - 2) / 2


def _histogram(df: DataFrame, keys: list[str], by: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("regions")).withColumn("normalised", F.col("regions") / F.lit(float(by)))


def clusters(spark: SparkSession, name: str, k: int, side: int = 4, n: int = 2) -> DataFrame:
    """key: number of runs of consecutive distances in a window of `side` cells a dimension, over all windows.

    A cell starts a run if the cell before it on the curve is outside the window: no sort and no window function, only a
    small shuffle for the histogram.
    """
    if side < 1:
        raise ValueError("the window needs a side of 1 or more")
    span = (1 << k) - side + 1
    axes = _AXES[:n]
    windows = spark.range(span**n).select(*(c.alias(f"w{i}") for i, c in enumerate(curves.raster_inverse(F.col("id"), span, n))), F.col("id").alias("w"))
    cells = windows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(side**n - 1)))).select("*", *((F.col(f"w{i}") + o).alias(a) for i, (a, o) in enumerate(zip(axes, curves.raster_inverse(F.col("o"), side, n), strict=True))))
    placed = cells.withColumn("d", curves.curve(name).forward([F.col(a) for a in axes], k))
    before = curves.curve(name).inverse(F.col("d") - 1, k, n)
    inside = F.lit(True)
    for i, c in enumerate(before):
        inside = inside & c.between(F.col(f"w{i}"), F.col(f"w{i}") + side - 1)
    starts = placed.select("w", F.when((F.col("d") > 0) & inside, 0).otherwise(1).alias("starts"))
    # a window's cells come from one row, so counting them needs no shuffle of cells beyond partial sums
    return _histogram(starts.groupBy("w").agg(F.sum("starts").alias("key")), ["key"], span**2)


def _pairs(spark: SparkSession, name: str, k: int, n: int) -> DataFrame:
    """Each unordered pair of cells as one row, made by explosion (no join)."""
    total = 1 << (n * k)
    rows = spark.range(total - 1).withColumnRenamed("id", "a").withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.lit(total - 1).cast("long"))))
    here, there = curves.curve(name).inverse(F.col("a"), k, n), curves.curve(name).inverse(F.col("b"), k, n)
    return rows.select("a", "b", *(c.alias(f"{x}a") for x, c in zip(_AXES, here, strict=False)), *(c.alias(f"{x}b") for x, c in zip(_AXES, there, strict=False)))


def ratio(spark: SparkSession, name: str, k: int, n: int = 2, exact: bool = False) -> DataFrame:
    """key: 1000 times the distance on the curve over the Euclidean norm (cut to an integer unless exact), cut."""
    pairs = _pairs(spark, name, k, n)
    norm = euclidean([F.col(f"{x}a") for x in _AXES[:n]], [F.col(f"{x}b") for x in _AXES[:n]])
    norm = norm if exact else F.floor(norm)
    return _histogram(pairs.select(F.floor(F.lit(1000.0) * (F.col("b") - F.col("a")) / norm).cast("long").alias("key")), ["key"], pair_normaliser(1 << (n * k)))


def bounding_boxes(spark: SparkSession, name: str, k: int, n: int = 2) -> DataFrame:
    """area and gap: the box around all cells from one to a later cell of the curve, and how far apart they are; key their ratio.

    Running minima are kept by numpy for each start; a task counts before it sends, so the shuffle holds histogram rows.
    """
    total = 1 << (n * k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # every task makes the grid's cells in curve order itself: nothing is collected or joined
        raster = np.argsort(permutation(name, k, n))
        points = np.stack([(raster >> (k * i)) & ((1 << k) - 1) for i in range(n)], axis=1)
        for batch in batches:
            seen: dict[tuple[int, int], int] = {}
            for start in batch["a"]:
                later = points[start:]
                area = np.prod(np.maximum.accumulate(later) - np.minimum.accumulate(later) + 1, axis=1)[1:]
                for key in zip(area.tolist(), range(1, area.size + 1), strict=True):
                    seen[key] = seen.get(key, 0) + 1
            yield pd.DataFrame([(a, g, c) for (a, g), c in seen.items()], columns=["area", "gap", "c"])

    starts = spark.range(total - 1).withColumnRenamed("id", "a")
    counted = starts.mapInPandas(run, "area long, gap long, c long").groupBy("area", "gap").agg(F.sum("c").alias("regions"))
    return counted.select("area", "gap", (F.col("area") / F.col("gap")).alias("key"), "regions", (F.col("regions") / F.lit(pair_normaliser(total))).alias("normalised"))


def grid_edges(spark: SparkSession, name: str, k: int, n: int = 2, corrected: bool = False) -> DataFrame:
    """key: difference on the curve along grid edges from the cells of a raster one shorter than the grid.

    As published, the centre counts with its raster position; corrected, with its own place on the curve.
    """
    side = (1 << k) - 1
    axes = _AXES[:n]
    cells = spark.range(side**n).select(F.col("id").alias("raster"), *(c.alias(a) for a, c in zip(axes, curves.raster_inverse(F.col("id"), side, n), strict=True)))
    forward = curves.curve(name).forward
    base = forward([F.col(a) for a in axes], k) if corrected else F.col("raster")
    ends = []
    for i in range(n):
        for step in (-1, 1):
            to = forward([F.col(a) + (step if i == j else 0) for j, a in enumerate(axes)], k)
            gap = F.abs(to - base)
            ends.append(gap if step == 1 else F.when(F.col(axes[i]) > 0, gap))
    rows = cells.select(F.explode(F.array(*ends)).alias("key")).where("key is not null")
    return _histogram(rows, ["key"], pair_normaliser(1 << (n * k)))


METRICS = {"clusters": clusters, "ratio": ratio, "bbox": bounding_boxes, "gridedges": grid_edges}


def metric(spark: SparkSession, name: str, curve: str, k: int, **options) -> DataFrame:
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return METRICS[name](spark, curve, k, **options)
