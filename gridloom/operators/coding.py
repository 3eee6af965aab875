"""Codecs over payload columns: one Arrow stage for whole payloads, or blocks that run in parallel and are joined again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.codecs import BLOCK, bzip_block, codec


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a few large files give fewer tasks than there are cores, and codecs cost far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def encode_column(df: DataFrame, payload: str, name: str, width: int = 2) -> DataFrame:
    """df with `encoded` (binary) and `used_bits` (null where the codec has no such field). Null payloads stay null."""
    chosen = codec(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(None, None) if b is None else chosen.encode(bytes(b), width) for b in batch[payload]]
            yield batch.assign(encoded=[x for x, _ in done], used_bits=pd.array([y for _, y in done], "Int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return spread(df).mapInPandas(run, f"{fields}, encoded binary, used_bits int")


def decode_column(df: DataFrame, name: str, width: int = 2, encoded: str = "encoded", bits: str = "used_bits") -> DataFrame:
    """df with `decoded`."""
    chosen = codec(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch[encoded], batch[bits], strict=True)
            yield batch.assign(decoded=[None if b is None else chosen.decode(bytes(b), width, None if pd.isna(p) else int(p)) for b, p in rows])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, decoded binary")


def round_trip(df: DataFrame, payload: str, name: str, width: int = 2) -> DataFrame:
    """df with n_bytes, n_encoded, and ok: the decoded payload has the digest of the payload."""
    both = decode_column(encode_column(df, payload, name, width), name, width)
    return both.select(*df.columns, F.length(payload).cast("long").alias("n_bytes"), F.length("encoded").cast("long").alias("n_encoded"), (F.sha2("decoded", 256) == F.sha2(payload, 256)).alias("ok"))


def encode_blocks(df: DataFrame, key: str, payload: str, post: str, size: int = BLOCK) -> DataFrame:
    """key, encoded: the block pipeline with every block its own row, so blocks of one large payload run in parallel."""
    pieces = df.select(key, F.posexplode(F.expr(f"transform(sequence(0, greatest(length({payload}) - 1, 0), {size}), i -> substring({payload}, i + 1, {size}))")).alias("block_no", "block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(block=[bzip_block(bytes(b), post) if len(b) else b"" for b in batch["block"]])

    done = pieces.repartition(key, "block_no").mapInPandas(run, pieces.schema)
    parts = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_no", F.hex("block").alias("h")))).alias("parts"))
    return parts.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")).alias("encoded"))
