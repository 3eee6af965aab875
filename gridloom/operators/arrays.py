"""Array transforms: re-ordering along a curve and bit planes; exploded (rows) and packed (Arrow over whole payloads)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import curves


def reorder_cells(df: DataFrame, position: str, source: str, target: str, k: int, n: int = 2) -> DataFrame:
    """Cells with the position they get when an array ordered by one curve is ordered by another; no shuffle."""
    if curves.curve(source) is curves.curve(target):
        return df
    coords = curves.curve(source).inverse(F.col(position), k, n)
    # coordinates first, so that each is computed once
    staged = df.select("*", *(c.alias(f"_c{i}") for i, c in enumerate(coords)))
    moved = staged.withColumn(position, curves.curve(target).forward([F.col(f"_c{i}") for i in range(n)], k))
    return moved.drop(*(f"_c{i}" for i in range(n)))


def curve_layout(df: DataFrame, name: str, coords: list[str], k: int, partitions: int | None = None) -> DataFrame:
    """df sorted by curve distance d across range partitions: written so, Parquet statistics prune boxes."""
    keyed = df.withColumn("d", curves.to_distance(name, [F.col(c) for c in coords], k))
    ranged = keyed.repartitionByRange(partitions, "d") if partitions else keyed.repartitionByRange("d")
    return ranged.sortWithinPartitions("d")


def bit_planes(df: DataFrame, value: str, position: str, width: int) -> DataFrame:
    """(plane, block, word): bit v of a word is bit `plane` of the block's v-th value; blocks hold `width` values.

    A block that is not full keeps its values elsewhere: rows at and after the last full block are left out, see
    `plane_tail`.
    """
    at = F.expr(f"cast({position} % {width} as int)")
    whole = df.select(F.col(value).cast("long").alias("v"), F.expr(f"{position} div {width}").alias("block"), at.alias("at"))
    # one group for each block gives all its planes: rows are summed where they are before anything is shuffled
    words = [F.sum(F.expr(f"shiftleft(shiftright(v, {b}) & 1L, at)")).alias(f"p{b}") for b in range(width)]
    full = whole.groupBy("block").agg(F.count("*").alias("c"), *words).where(F.col("c") == width)
    return full.select("block", F.posexplode(F.array(*(f"p{b}" for b in range(width)))).alias("plane", "word")).select("plane", "block", "word")


def plane_tail(df: DataFrame, position: str, width: int, total: int) -> DataFrame:
    """Rows beyond the last full block; they pass through unchanged."""
    return df.where(F.col(position) >= total - total % width)


def unplane(planes: DataFrame, width: int) -> DataFrame:
    """(pos, value): inverse of bit_planes."""
    values = [F.sum(F.expr(f"shiftleft(shiftright(word, {at}) & 1L, plane)")).alias(f"v{at}") for at in range(width)]
    full = planes.groupBy("block").agg(*values)
    return full.select("block", F.posexplode(F.array(*(f"v{at}" for at in range(width)))).alias("at", "value")).select((F.col("block") * width + F.col("at")).alias("pos"), "value")


# -- packed payloads -------------------------------------------------------------------------------------------------


def _np_interleave(coords: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(coords.shape[1], np.int64)
    for b in range(k):
        for i, c in enumerate(coords):
            out |= ((c >> b) & 1) << (b * len(coords) + i)
    return out


def _np_hilbert2(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    d, top = np.zeros_like(x), (1 << k) - 1
    for b in range(k - 1, -1, -1):
        rx, ry = (x >> b) & 1, (y >> b) & 1
        d += ((3 * rx) ^ ry) << (2 * b)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, top - x, x), np.where(flip, top - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
    return d


def _np_hilbert(coords: np.ndarray, k: int) -> np.ndarray:
    """Skilling's transform, the twin of the column expression."""
    v = coords.copy()
    n = len(v)
    for b in range(k - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            hit = (v[i] & q) != 0
            t = np.where(hit, 0, (v[0] ^ v[i]) & p)
            v[0] = np.where(hit, v[0] ^ p, v[0] ^ t)
            if i:
                v[i] ^= t
    for i in range(1, n):
        v[i] ^= v[i - 1]
    t = np.zeros_like(v[0])
    for b in range(k - 1, 0, -1):
        t = np.where((v[-1] >> b) & 1 == 1, t ^ ((1 << b) - 1), t)
    return _np_interleave((v ^ t)[::-1], k)


def distances(name: str, coords: np.ndarray, k: int) -> np.ndarray:
    """Curve distances of coordinates, one row for each axis."""
    n, key = len(coords), curves.ALIASES.get(name.lower(), name.lower())
    if key == "raster":
        return sum(c << (k * i) for i, c in enumerate(coords))
    if key == "hilbert":
        return _np_hilbert2(coords[0], coords[1], k) if n == 2 else _np_hilbert(coords, k)
    m = _np_interleave(coords, k)
    if key == "gray":
        return m ^ (m >> 1)
    if key == "gray_canonical":
        for s in (32, 16, 8, 4, 2, 1):
            m = m ^ (m >> s)
    elif key != "morton":
        raise ValueError(f"unsupported curve: {name}")
    return m


def _np_hilbert2_inverse(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros_like(d), np.zeros_like(d)
    for b in range(k):
        pair, side = (d >> (2 * b)) & 3, np.int64(1 << b)
        rx = pair >> 1
        ry = (pair & 1) ^ rx
        turned = (ry == 0) & (rx == 1)
        x, y = np.where(turned, side - 1 - x, x), np.where(turned, side - 1 - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
        x, y = x + side * rx, y + side * ry
    return x, y


@lru_cache(maxsize=32)
def permutation(name: str, k: int, n: int) -> np.ndarray:
    """Curve distance of each cell in raster order."""
    side = 1 << k
    ids = np.arange(side**n, dtype=np.int64)
    coords = np.stack([(ids // side**i) % side for i in range(n)])
    return distances(name, coords, k)


def reorder_payload(payload: bytes, width: int, k: int, n: int, source: str, target: str) -> bytes:
    """A whole array's words moved from one curve's order to another's."""
    if width not in (1, 2, 4, 8):
        raise ValueError("words have 1, 2, 4 or 8 bytes")
    if n not in (2, 3):
        raise ValueError("arrays have 2 or 3 dimensions")
    words = np.frombuffer(payload, f"<u{width}")
    if words.size != 1 << (n * k):
        raise ValueError("payload does not fill the grid")
    out = np.empty_like(words)
    out[permutation(target, k, n)] = words[permutation(source, k, n)]
    return out.tobytes()


def planes_payload(payload: bytes, width: int, inverse: bool = False) -> bytes:
    """Bit planes of words of `width` bytes, lowest plane first; what does not fill a block stays as it is at the end."""
    bits = 8 * width
    words = np.frombuffer(payload[: len(payload) // width * width], f"<u{width}")
    blocks = words.size // bits
    body, tail = words[: blocks * bits], payload[blocks * bits * width :]
    if inverse:
        planes = np.unpackbits(body.view(np.uint8).reshape(bits, blocks, width), axis=2, bitorder="little") if blocks else np.empty((bits, 0, bits), np.uint8)
        out = np.packbits(planes.transpose(1, 2, 0), axis=2, bitorder="little")
    else:
        values = np.unpackbits(body.view(np.uint8).reshape(blocks, bits, width), axis=2, bitorder="little") if blocks else np.empty((0, bits, bits), np.uint8)
        out = np.packbits(values.transpose(2, 0, 1), axis=2, bitorder="little")
    return out.tobytes() + tail


def with_distance(df: DataFrame, name: str, coords: list[str], k: int, out: str = "d") -> DataFrame:
    """df with the curve distance. Hilbert keys are computed by numpy in Arrow batches, which is faster than the interpreted
    expression; the expression (curves.to_distance) stays for plans that filter on the key."""
    if curves.ALIASES.get(name.lower(), name.lower()) != "hilbert":
        return df.withColumn(out, curves.curve(name).forward([F.col(c) for c in coords], k))

    @F.pandas_udf("long")
    def distance(*axes: pd.Series) -> pd.Series:
        at = np.stack([a.to_numpy(np.int64) for a in axes])
        return pd.Series(_np_hilbert2(at[0], at[1], k) if len(at) == 2 else _np_hilbert(at, k))

    return df.withColumn(out, distance(*coords))


def with_coords(df: DataFrame, name: str, distance: str, axes: list[str], k: int) -> DataFrame:
    """df with the coordinates of a curve distance; the 2-D Hilbert curve by numpy in Arrow batches, others as expressions."""
    if curves.ALIASES.get(name.lower(), name.lower()) != "hilbert" or len(axes) != 2:
        back = curves.curve(name).inverse(F.col(distance), k, len(axes))
        return df.select("*", *(c.alias(a) for a, c in zip(axes, back, strict=True)))

    @F.pandas_udf("x long, y long")
    def coords(d: pd.Series) -> pd.DataFrame:
        x, y = _np_hilbert2_inverse(d.to_numpy(np.int64), k)
        return pd.DataFrame({"x": x, "y": y})

    return df.withColumn("_at", coords(distance)).select(*df.columns, *(F.col(f"_at.{c}").alias(a) for c, a in zip("xy", axes, strict=True)))


def map_payload(df: DataFrame, column: str, change) -> DataFrame:
    """df with a payload column changed by bytes -> bytes, in Arrow batches; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: [None if b is None else change(bytes(b)) for b in batch[column]]})

    return df.mapInPandas(run, df.schema)
