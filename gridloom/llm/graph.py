"""Connected components by repeated contraction; only DataFrame operations, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.util import materialize, scratch


def _parents(edges: DataFrame) -> DataFrame:
    """(id, parent): each vertex with its smallest neighbour or itself, followed twice towards the root."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
    hop = materialize(both.groupBy("id").agg(F.least("id", F.min("to")).alias("parent")), "hop")
    for _ in range(2):
        up = hop.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        hop = hop.join(up, "parent").select("id", F.col("above").alias("parent"))
    return hop


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of the undirected edges (a, b), component being the smallest id it reaches.

    Each round points every vertex at its smallest neighbour, shortens the pointers and contracts the edges; rounds
    grow with the logarithm of the diameter. An empty edge table gives an empty result; loops and repeats are harmless.
    """
    with scratch() as keep:
        live = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        levels = []
        while not live.isEmpty():
            parents = materialize(_parents(live), "parents")
            levels.append(parents)
            pa = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
            pb = parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
            moved = live.join(pa, "a").join(pb, "b").where("pa <> pb")
            live = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        out = levels[0].withColumnRenamed("parent", "component") if levels else live.select(F.col("a").alias("id"), F.col("b").alias("component"))
        for level in levels[1:]:
            up = level.select(F.col("id").alias("component"), F.col("parent").alias("above"))
            out = out.join(up, "component", "left").select("id", F.coalesce("above", "component").alias("component"))
        return keep(out, "components")
