"""A corpus pipeline over the table documents: five stages, each one operator of gridloom.llm.

Each stage works on all that the one before kept, and all but the last return the columns of documents:

1. quality: documents that the base rule or the learned decision list rejects go.
2. lines: of each group of equal or similar lines the first stays, in all other places the line goes;
   documents that have no line left go too.
3. copies: of each group of near copies (5-word shingles, similarity 0.8 or more) the smallest doc_id stays.
4. benchmark: documents that hold a benchmark item go.
5. mix: each document gets a rate, its expected number of copies, so that the domains' words meet target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.mixing import WEIGHTS, label_domains, mix
from gridloom.llm.ngram_join import keep_first
from gridloom.llm.quality_rules import keep_quality
from gridloom.llm.util import drop, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, drop_emptied=True)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, label_domains(docs, _table(spark, sf_dir, "labels")), WEIGHTS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("copies", copies),
    ("benchmark", benchmark),
    ("mix", mixed),
]

#: The learned rules, the near-duplicate joins and the rates are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next.

    What a stage wrote on its way is deleted when its result is there, and so is the result before.
    """
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            done = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
