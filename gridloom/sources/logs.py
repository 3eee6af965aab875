"""Readers of size listings and job logs, writers of results and metrics: delimited text with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import parse_entropy_name
from gridloom.plans.experiment import exported


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """size, path from lines of size, tab, path."""
    return spark.read.csv(path, sep="\t", schema="size long, path string")


def read_joblog(spark: SparkSession, path: str) -> DataFrame:
    """runtime (seconds), exit, signal, command of a job log with a heading."""
    schema = "job long, host string, start double, runtime double, sent long, received long, exit int, signal int, command string"
    return spark.read.csv(path, sep="\t", header=True, schema=schema).select("job", "runtime", "exit", "signal", "command")


def write_results(results: DataFrame, folder: str, marker: str = "1518913830") -> None:
    """Result rows with the heading, in two folders: file names with the marker, and the others."""
    here = F.col("Name").contains(marker)
    out = exported(results)
    out.where(here).write.mode("overwrite").csv(f"{folder}/data_ska", header=True)
    out.where(~here).write.mode("overwrite").csv(f"{folder}/data_srtm", header=True)


def write_metric(metric: DataFrame, folder: str, name: str, curve: str, side: int) -> str:
    """A metric's histogram in order of its key, tab-separated with the metric's heading."""
    to = f"{folder}/mtrc_{name}_{curve}_{side}.dat"
    metric_lines(metric, name).write.mode("overwrite").csv(to, sep="\t", header=True)
    return to


#: The first heading of each metric's file.
METRIC_KEYS = {"clusters": "Clusters", "ratio": "Ratio", "bbox": "Area", "gridedges": "Distance"}


def metric_lines(metric: DataFrame, name: str) -> DataFrame:
    """A metric's histogram in order of its key under the headings of its file."""
    return metric.orderBy("key").select(F.col("key").alias(METRIC_KEYS[name]), F.col("regions").alias("Regions"), F.col("normalised").alias("Normalised"))


def entropy_lines(blocks: DataFrame, path: str = "path") -> DataFrame:
    """name, SFC, bittransposed, bwt, entropy_offsets, entropy_encoded of each file, from (path, offset, entropy)."""
    files = blocks.groupBy(path).agg(F.array_sort(F.collect_list(F.struct("offset", "entropy"))).alias("b"))
    told = parse_entropy_name(F.col(path))
    return files.select(told["name"].alias("name"), told["sfc"].alias("SFC"), told["bittransposed"].alias("bittransposed"), told["bwt"].alias("bwt"), F.col("b.offset").alias("entropy_offsets"), F.col("b.entropy").alias("entropy_encoded"))


def write_block_entropy(blocks: DataFrame, to: str, path: str = "path") -> None:
    """The files' block entropies with a heading; the arrays as JSON text, which CSV can hold."""
    lines = entropy_lines(blocks, path)
    lines.withColumns({c: F.to_json(c) for c in ("entropy_offsets", "entropy_encoded")}).write.mode("overwrite").csv(to, header=True)


def write_report(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").csv(path, sep=";", header=True)
