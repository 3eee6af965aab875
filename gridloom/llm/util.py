"""Session helpers shared by the operators: shared-folder tables, size-checked broadcasts, worker set-up."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join may be broadcast.
BROADCAST_BYTES = 32 << 20
#: The setting by which Spark deletes a statement's shuffle files at its end, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The setting by which Spark bounds what it hands to a Python worker at a time by bytes, besides by rows (10,000), and the bound.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: open: the tables written in each open `scratch` of a thread, the innermost last.
_SCRATCH = threading.local()


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package even if only the driver has it on its path."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(told)
    return told


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A block in which the session's setting has that value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """A block in which jobs hand BATCH_BYTES of rows to a Python worker at a time, or one longer row.

    10,000 texts at a time are tens of MB, which the JVM holds outside its heap and the worker holds several times over.
    """
    return _setting(spark, BATCH, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
    with _setting(spark, CLEAN_UP, "true"):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table._table_path = path
    if _open():
        _open()[-1].append(table)
    return table


def stacked(tables: list[DataFrame]) -> DataFrame:
    """One frame of the rows of tables that `materialize` returned, all of one schema."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t._table_path for t in tables))


def _open() -> list[list[DataFrame]]:
    if not hasattr(_SCRATCH, "open"):
        _SCRATCH.open = []
    return _SCRATCH.open


def drop(table: DataFrame) -> None:
    """Deletes the files of a table that `materialize` or `scratch` returned; other frames are left alone."""
    path = table.__dict__.get("_table_path")
    if path:
        at = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration())
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block at whose end the tables written in it are deleted, but for those written by the function that it gives."""
    made: list[DataFrame] = []
    _open().append(made)

    def keep(df: DataFrame, name: str = "table") -> DataFrame:
        table = materialize(df, name)
        made.pop()
        if len(_open()) > 1:
            _open()[-2].append(table)
        return table

    try:
        yield keep
    finally:
        _open().pop()
        for table in made:
            drop(table)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint for df only if its counted rows fit BROADCAST_BYTES; else df, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df



def release(spark: SparkSession) -> None:
    """Has the driver's collector run once, so that Spark's cleaner drops the shuffles, broadcasts and compiled plans of finished steps."""
    spark.sparkContext._jvm.java.lang.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with the column `row` that, with doc_id, tells rows apart: 0, or a number of its own where a doc_id repeats.

    Only rows of repeated ids are written down, so that their numbers stay; rows without doc_id have 0.
    """
    ids = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(row)).where(f"`{row}` > 1").select("doc_id"), "repeated-ids")
    n = ids.count()
    if not n:
        return docs.withColumn(row, F.lit(0).cast("long"))
    again = materialize(docs.join(small(ids, n, 16), "doc_id", "left_semi").withColumn(row, F.monotonically_increasing_id() + 1), "repeated-rows")
    return docs.join(small(ids, n, 16), "doc_id", "left_anti").withColumn(row, F.lit(0).cast("long")).unionByName(again)
