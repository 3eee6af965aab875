"""Bounded samples of labelled documents and the fold that no model learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that is kept for measuring: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of up to per_class learning rows of each label, in hash order; at most 2 * per_class rows.

    Null ids, texts and labels, and labels other than 0 and 1, teach nothing. The chosen ids, 2 * per_class at most,
    are broadcast.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
