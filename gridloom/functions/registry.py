"""Curves as SQL functions: scalar functions in Arrow batches and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.functions.curves import ALIASES, CURVES


def _key(name: str) -> str:
    key = ALIASES.get(name.lower(), name.lower())
    if key not in CURVES:
        raise ValueError(f"unsupported curve: {name}")
    return key


class GridWalk:
    """d, x, y along a 2-D curve on a grid of side 2**k."""

    def eval(self, name: str, k: int) -> Iterator[tuple[int, int, int]]:
        from gridloom.operators.arrays import permutation

        order = np.argsort(permutation(_key(name), k, 2))
        for d, cell in enumerate(order.tolist()):
            yield d, cell & ((1 << k) - 1), cell >> k


def register(spark: SparkSession) -> None:
    """curve_distance(name, k, x, y) and the table function grid_walk(name, k) for SQL of this session."""

    @F.pandas_udf("long")
    def distance(name: pd.Series, k: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        from gridloom.operators.arrays import distances

        out = np.empty(len(x), np.int64)
        kinds = pd.Series(list(zip(name, k, strict=True)))
        for (curve, bits), rows in kinds.groupby(kinds).groups.items():
            at = np.stack([x.to_numpy(np.int64)[rows], y.to_numpy(np.int64)[rows]])
            out[rows] = distances(_key(curve), at, int(bits))
        return pd.Series(out)

    spark.udf.register("curve_distance", distance)
    spark.udtf.register("grid_walk", F.udtf(GridWalk, returnType="d: bigint, x: bigint, y: bigint"))
