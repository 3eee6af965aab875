"""Array files: a header of nine or ten bytes and a dense payload; scan, headers, compress and decompress pipelines."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import names
from gridloom.functions.codecs import CODECS, codec
from gridloom.functions.curves import ALIASES, CURVE_CODES
from gridloom.operators.arrays import planes_payload, reorder_payload

#: The file's first bytes, and the codecs whose header has a tenth byte (used bits of the last byte).
MAGIC = b"SFCC"
PADDED_CODES = (2, 5, 6, 8)
#: Curve names by header code, and extensions of coded files.
_CURVES = {0: "raster", 2: "morton", 3: "gray", 4: "hilbert"}
_EXTENSIONS = {"none": "", "rle": ".rle", "huffman": ".hff", "lz77": ".lz77", "lzw": ".lzw", "bzip_lz77": ".bwt.lz77", "bzip_lzw": ".bwt.lzw", "bwt": ".bwt"}


def pack_header(ndims: int, k: int, width: int, curve: int, transposed: bool, compression: int, used: int | None = None) -> bytes:
    head = MAGIC + bytes([ndims, k, width, curve | (0x80 if transposed else 0), compression])
    return head + (bytes([used or 0]) if compression in PADDED_CODES else b"")


def _byte(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """path, header fields and payload of each file under path; a file without the magic raises when it is read."""
    files = spark.read.format("binaryFile").load(path)
    return decode_headers(files.select("path", "content"))


def decode_headers(files: DataFrame) -> DataFrame:
    content = F.col("content")
    checked = files.withColumn("content", F.when(F.hex(F.substring(content, 1, 4)) == MAGIC.hex().upper(), content).otherwise(F.raise_error(F.concat(F.lit("no array file: "), F.col("path"))).cast("binary")))
    compression = _byte(content, 8)
    padded = compression.isin(*PADDED_CODES)
    curve_byte = _byte(content, 7)
    return checked.select("path", _byte(content, 4).alias("ndims"), _byte(content, 5).alias("k"), _byte(content, 6).alias("dtype_nbytes"), curve_byte.bitwiseAND(F.lit(127)).alias("sfctype"), (curve_byte.bitwiseAND(F.lit(128)) != 0).alias("bittransposed"), compression.alias("compression"), F.when(padded, _byte(content, 9)).alias("npaddingbits"), F.when(padded, F.substring(content, 11, 2147483647)).otherwise(F.substring(content, 10, 2147483647)).alias("payload"))


def header_info(arrays: DataFrame) -> DataFrame:
    """Labels, the size that the header promises for a plain payload, whether it holds, and 16 sample bytes in hex."""
    size = F.shiftleft(F.lit(1).cast("long"), 0) * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("ndims") * F.col("k")) * F.col("dtype_nbytes")
    at = F.floor(F.length("payload") * 2 / 5).cast("int")
    return arrays.select("path", "ndims", "k", "dtype_nbytes", names.curve_label(F.col("sfctype")).alias("sfc"), "bittransposed", names.compression_label(F.col("compression")).alias("compression"), "npaddingbits", F.length("payload").cast("long").alias("payload_bytes"), F.when(F.col("compression") == 0, F.length("payload") == size).alias("consistent"), F.hex(F.substring("payload", at + 1, F.lit(16))).alias("sample"))


_SCHEMA = "path string, ndims int, k int, dtype_nbytes int, sfctype int, bittransposed boolean, compression int, npaddingbits int, payload binary"


def compress(arrays: DataFrame, curve: str, codec_name: str, transposed: bool = False) -> DataFrame:
    """Re-order, bit planes, codec: one Arrow stage. Inputs must be plain and in raster order."""
    target = ALIASES.get(curve.lower(), curve.lower())
    code = CURVE_CODES[{"raster": "ROW_MAJOR", "morton": "MORTON", "gray": "GRAY_CODE", "hilbert": "HILBERT"}[target]]
    chosen = codec(codec_name)
    if chosen.code is None:
        raise ValueError(f"{codec_name} has no code in array files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, pads = [], []
            for row in batch.itertuples():
                if row.compression or row.sfctype:
                    raise ValueError(f"{row.path} is compressed or re-ordered already")
                body = reorder_payload(bytes(row.payload), row.dtype_nbytes, row.k, row.ndims, "raster", target)
                body = planes_payload(body, row.dtype_nbytes) if transposed else body
                done, used = chosen.encode(body, row.dtype_nbytes)
                out.append(done)
                pads.append(used)
            yield batch.assign(payload=out, npaddingbits=pd.array(pads, "Int32"), sfctype=code, bittransposed=transposed, compression=chosen.code)

    return arrays.mapInPandas(run, _SCHEMA)


def decompress(arrays: DataFrame) -> DataFrame:
    """The exact inverse, back to raster order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_code = {c.code: c for c in CODECS.values() if c.code is not None}
        for batch in batches:
            out = []
            for row in batch.itertuples():
                body = by_code[row.compression].decode(bytes(row.payload), row.dtype_nbytes, None if pd.isna(row.npaddingbits) else int(row.npaddingbits))
                body = planes_payload(body, row.dtype_nbytes, inverse=True) if row.bittransposed else body
                out.append(reorder_payload(body, row.dtype_nbytes, row.k, row.ndims, _CURVES[row.sfctype], "raster"))
            yield batch.assign(payload=out, npaddingbits=pd.array([None] * len(batch), "Int32"), sfctype=0, bittransposed=False, compression=0)

    return arrays.mapInPandas(run, _SCHEMA)


def coded_name(path: str, curve: str, transposed: bool, codec_name: str) -> str:
    return path + names.SFC_EXTENSIONS[ALIASES.get(curve.lower(), curve.lower())] + (".btr" if transposed else "") + _EXTENSIONS[codec_name]


def plain_name(path: str) -> str:
    """The path without the extensions that coding adds."""
    return re.sub(r"(?:\.(?:mrtn|gry|hbrt|btr|bwt|rle|hff|lz77|lzw|gz|bz2))+$", "", path)


def write_arrays(arrays: DataFrame, folder: str) -> DataFrame:
    """Writes each row as a file of its path's base name in a folder that all executors reach; gives path and bytes written.

    Tasks write their own rows through Arrow's file systems; only paths and sizes come back. A file is written under a
    name of its attempt and then renamed, so a task that runs again leaves whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + posixpath.abspath(folder))
        fs.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for row in batch.itertuples():
                used = None if pd.isna(row.npaddingbits) else int(row.npaddingbits)
                data = pack_header(row.ndims, row.k, row.dtype_nbytes, row.sfctype, row.bittransposed, row.compression, used) + bytes(row.payload)
                name = posixpath.basename(row.path)
                part = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, posixpath.join(root, name))
                done.append((posixpath.join(folder, name), len(data)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    # written now, once; the result holds the list only
    done = arrays.mapInPandas(run, "path string, bytes long").collect()
    return arrays.sparkSession.createDataFrame(done, "path string, bytes long")


def tiles(cells: DataFrame, axes: list[str], side: int) -> DataFrame:
    """cells with the tile (t_<axis>) and the place in the tile (o_<axis>) of each axis; no shuffle."""
    return cells.withColumns({f"t_{a}": F.expr(f"{a} div {side}") for a in axes} | {f"o_{a}": F.col(a) % side for a in axes})


def tile_list(spark: SparkSession, shape: tuple[int, ...] = (1024, 4096, 544), side: int = 128) -> DataFrame:
    """Corners of the tiles; as published, the last tile of each axis is left out (868 for the default shape)."""
    counts = [len(range(0, s - side, side)) for s in shape]
    total = 1
    for c in counts:
        total *= c
    rows, step = spark.range(total), 1
    for i, c in enumerate(counts):
        rows = rows.withColumn(f"c{i}", F.expr(f"(id div {step}) % {c} * {side}"))
        step *= c
    return rows.drop("id")
