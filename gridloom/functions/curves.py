"""Space-filling curves as column expressions: coordinates to curve distance and back.

Distances are LONG, so N dimensions of k bits need N * k <= 62. Every mapping is made of built-in expressions, hence
visible to Catalyst; in strict mode a coordinate or distance off the grid raises, else it gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_MAJOR, SNAKE_SCAN, MORTON, GRAY_CODE, HILBERT = range(5)
#: Curve names and their codes in array files.
CURVE_CODES = {"ROW_MAJOR": 0, "SNAKE_SCAN": 1, "MORTON": 2, "GRAY_CODE": 3, "HILBERT": 4}


def _check_bits(n: int, k: int) -> None:
    if n < 1 or k < 0 or n * k > 62:
        raise ValueError(f"{n} dimensions of {k} bits do not fit a signed 64-bit distance")


def interleave_mask(n: int, bits: int = 64) -> int:
    """Bits 0, n, 2n, ... below `bits`."""
    return sum(1 << b for b in range(0, bits, n))


def max_interleave_length(distance_bits: int, coordinate_bits: int, n: int) -> int:
    """Largest coordinate that an interleaved distance of so many bits can hold."""
    return (1 << min(coordinate_bits, distance_bits // n)) - 1


def in_bounds(coords: Sequence[Column], side: int) -> Column:
    """All coordinates lie on the grid."""
    out = F.lit(True)
    for c in coords:
        out = out & (c >= 0) & (c < side)
    return out


def guarded(value: Column, ok: Column, strict: bool, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("long")) if strict else F.when(ok, value)


def raster_forward(coords: Sequence[Column], side: int) -> Column:
    """The first coordinate varies fastest; any side."""
    out = coords[0].cast("long")
    for i, c in enumerate(coords[1:], 1):
        out = out + c * F.lit(side**i).cast("long")
    return out


def raster_inverse(d: Column, side: int, n: int) -> list[Column]:
    long = d.cast("long")
    return [F.pmod(_div(long, side**i), F.lit(side).cast("long")) for i in range(n)]


def _div(value: Column, by: int) -> Column:
    """Whole division of a non-negative LONG; a shift for powers of two."""
    if by & (by - 1) == 0:
        return F.shiftrightunsigned(value, by.bit_length() - 1)
    return F.call_function("div", value, F.lit(by).cast("long"))


def _bit(v: Column, b: int, to: int) -> Column:
    """Bit b of v, moved to bit `to`."""
    kept = v.bitwiseAND(F.lit(1 << b).cast("long"))
    return F.shiftleft(kept, to - b) if to > b else F.shiftrightunsigned(kept, b - to) if to < b else kept


def _parity(v: Column, b: int, to: int) -> Column:
    """Exclusive-or of the bits of v from b up, as bit `to`."""
    one = F.bit_count(F.shiftrightunsigned(v, b) if b else v).cast("long").bitwiseAND(F.lit(1).cast("long"))
    return F.shiftleft(one, to) if to else one


def _joined(parts: Sequence[Column], by: str = "bitwiseOR") -> Column:
    out = F.lit(0).cast("long")
    for p in parts:
        out = getattr(out, by)(p)
    return out


# The expressions below name each input once for each bit, so their size is linear and they stay in generated code.


def morton_forward(coords: Sequence[Column], k: int) -> Column:
    """Bit b of coordinate i to bit n * b + i."""
    n = len(coords)
    _check_bits(n, k)
    return _joined([_bit(c.cast("long"), b, n * b + i) for b in range(k) for i, c in enumerate(coords)])


def morton_inverse(d: Column, k: int, n: int) -> list[Column]:
    _check_bits(n, k)
    return [_joined([_bit(d.cast("long"), n * b + i, b) for b in range(k)]) for i in range(n)]


def gray_encode(v: Column) -> Column:
    return v.bitwiseXOR(F.shiftrightunsigned(v, 1))


def gray_decode(v: Column, bits: int = 62) -> Column:
    return _joined([_parity(v, b, b) for b in range(bits)])


def gray_forward(coords: Sequence[Column], k: int) -> Column:
    """Gray code of the Morton code, which is the published order; gray_canonical_forward is the textbook's."""
    return gray_encode(morton_forward(coords, k))


def gray_inverse(d: Column, k: int, n: int) -> list[Column]:
    _check_bits(n, k)
    return [_joined([_parity(d.cast("long"), n * b + i, b) for b in range(k)]) for i in range(n)]


def gray_canonical_forward(coords: Sequence[Column], k: int) -> Column:
    """Position of the Morton code in the reflected Gray sequence: each bit is the parity of the Morton bits above."""
    n = len(coords)
    _check_bits(n, k)
    bits = [_joined([_parity(c.cast("long"), b + (j < i), n * b + i) for j, c in enumerate(coords)], "bitwiseXOR") for b in range(k) for i in range(n)]
    return _joined(bits)


def gray_canonical_inverse(d: Column, k: int, n: int) -> list[Column]:
    return morton_inverse(gray_encode(d.cast("long")), k, n)


def _hilbert2_forward(x: Column, y: Column, k: int) -> Column:
    top = F.lit((1 << k) - 1).cast("long")

    def step(a: Column, b: Column) -> Column:
        bit = lambda v: F.call_function("shiftright", v, b).bitwiseAND(F.lit(1).cast("long"))
        ax, ay = a["x"], a["y"]
        rx, ry = bit(ax), bit(ay)
        turn, flip = ry == 0, rx == 1
        quadrant = (rx * 3).bitwiseXOR(ry)
        return F.struct(
            F.when(turn, F.when(flip, top - ay).otherwise(ay)).otherwise(ax).alias("x"),
            F.when(turn, F.when(flip, top - ax).otherwise(ax)).otherwise(ay).alias("y"),
            (a["d"] + F.call_function("shiftleft", quadrant, b * 2)).alias("d"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    levels = F.array(*(F.lit(b) for b in range(k - 1, -1, -1))) if k else F.array().cast("array<int>")
    return F.aggregate(levels, start, step, lambda a: a["d"])


def _hilbert2_inverse(d: Column, k: int) -> list[Column]:
    def step(a: Column, b: Column) -> Column:
        pair = F.call_function("shiftright", d.cast("long"), b * 2)
        rx = F.shiftright(pair, 1).bitwiseAND(F.lit(1).cast("long"))
        ry = pair.bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        side = F.call_function("shiftleft", F.lit(1).cast("long"), b)
        turn, flip = ry == 0, rx == 1
        x = F.when(turn, F.when(flip, side - 1 - a["y"]).otherwise(a["y"])).otherwise(a["x"])
        y = F.when(turn, F.when(flip, side - 1 - a["x"]).otherwise(a["x"])).otherwise(a["y"])
        return F.struct((x + side * rx).alias("x"), (y + side * ry).alias("y"))

    zero = F.lit(0).cast("long")
    levels = F.array(*(F.lit(b) for b in range(k))) if k else F.array().cast("array<int>")
    state = F.aggregate(levels, F.struct(zero.alias("x"), zero.alias("y")), step)
    return [state["x"], state["y"]]


def _turned(v: Column, levels: Sequence[int], axes: Sequence[int]) -> Column:
    """The exchange steps of Skilling's transform over levels and axes, on an array of coordinates."""

    def level(state: Column, b: Column) -> Column:
        q = F.call_function("shiftleft", F.lit(1).cast("long"), b)

        def axis(v: Column, i: Column) -> Column:
            low = F.get(v, 0).bitwiseXOR(F.get(v, i)).bitwiseAND(q - 1)
            set_ = F.get(v, i).bitwiseAND(q) != 0
            return F.transform(v, lambda e, j: F.when(set_, F.when(j == 0, e.bitwiseXOR(q - 1)).otherwise(e)).otherwise(F.when((j == 0) | (j == i), e.bitwiseXOR(low)).otherwise(e)))

        return F.aggregate(F.array(*map(F.lit, axes)), state, axis)

    return F.aggregate(F.array(*map(F.lit, levels)), v, level) if levels else v


def _hilbert_nd_forward(coords: Sequence[Column], k: int) -> Column:
    n = len(coords)
    v = _turned(F.array(*(c.cast("long") for c in coords)), range(k - 1, 0, -1), range(n))
    zero = F.lit(0).cast("long")
    # running exclusive-or over the axes
    grayed = F.transform(v, lambda e, i: F.aggregate(F.slice(v, 1, i + 1), zero, lambda s, x: s.bitwiseXOR(x)))

    def spread(g: Column) -> Column:
        last = F.get(g, n - 1)
        t = F.aggregate(F.array(*map(F.lit, range(k - 1, 0, -1))), zero, lambda s, b: F.when(F.call_function("shiftright", last, b).bitwiseAND(F.lit(1).cast("long")) == 1, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)).otherwise(s)) if k > 1 else zero
        return morton_forward([F.get(g, i).bitwiseXOR(t) for i in range(n - 1, -1, -1)], k)

    return F.get(F.transform(F.array(grayed), spread), 0)


def _hilbert_nd_inverse(d: Column, k: int, n: int) -> list[Column]:
    transposed = F.array(*reversed(morton_inverse(d, k, n)))

    def whole(x: Column) -> Column:
        t = F.shiftrightunsigned(F.get(x, n - 1), 1)
        return F.transform(x, lambda e, i: F.when(i == 0, e.bitwiseXOR(t)).otherwise(e.bitwiseXOR(F.get(x, F.when(i == 0, F.lit(0)).otherwise(i - 1)))))

    v = F.get(F.transform(F.array(transposed), lambda x: _turned(whole(x), range(1, k), range(n - 1, -1, -1))), 0)
    return [F.get(v, i) for i in range(n)]


def hilbert_forward(coords: Sequence[Column], k: int) -> Column:
    """2-D: the common quadrant form; other dimensions: Skilling's transform (first coordinate most significant)."""
    _check_bits(len(coords), k)
    return _hilbert2_forward(*coords, k) if len(coords) == 2 else _hilbert_nd_forward(coords, k)


def hilbert_inverse(d: Column, k: int, n: int) -> list[Column]:
    _check_bits(n, k)
    return _hilbert2_inverse(d, k) if n == 2 else _hilbert_nd_inverse(d, k, n)


@dataclass(frozen=True)
class Curve:
    """A curve: builders of its two mappings. New curves go into CURVES under a name."""

    forward: Callable[[Sequence[Column], int], Column]
    inverse: Callable[[Column, int, int], list[Column]]


CURVES = {
    "raster": Curve(lambda c, k: raster_forward(c, 1 << k), lambda d, k, n: raster_inverse(d, 1 << k, n)),
    "morton": Curve(morton_forward, morton_inverse),
    "gray": Curve(gray_forward, gray_inverse),
    "gray_canonical": Curve(gray_canonical_forward, gray_canonical_inverse),
    "hilbert": Curve(hilbert_forward, hilbert_inverse),
}
#: Other names that callers may use.
ALIASES = {"row_major": "raster", "rstr": "raster", "zorder": "morton", "z-order": "morton", "mrtn": "morton", "gray_code": "gray", "gry": "gray", "hbrt": "hilbert"}


def curve(name: str) -> Curve:
    """The curve of a name or alias; the snake scan has a code but no mapping."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in CURVES:
        raise ValueError(f"unsupported curve: {name}")
    return CURVES[key]


def to_distance(name: str, coords: Sequence[Column], k: int, strict: bool = False) -> Column:
    """Curve distance of coordinates on a grid of side 2**k; off the grid null, or an error if strict."""
    return guarded(curve(name).forward(coords, k), in_bounds(coords, 1 << k), strict, "coordinate off the grid")


def to_coords(name: str, d: Column, k: int, n: int, strict: bool = False) -> list[Column]:
    ok = (d >= 0) & (d < F.lit(1 << (n * k)).cast("long"))
    return [guarded(c, ok, strict, "distance off the curve") for c in curve(name).inverse(d, k, n)]


def walk(spark: SparkSession, name: str, k: int, n: int = 2, begin: int = 0, end: int | None = None) -> DataFrame:
    """(d, x, y[, z]) along the curve from begin to before end, made in parallel."""
    _check_bits(n, k)
    axes = ["x", "y", "z"] if n <= 3 else [f"c{i}" for i in range(n)]
    rows = spark.range(begin, (1 << (n * k)) if end is None else end)
    return rows.select(F.col("id").alias("d"), *(c.alias(a) for a, c in zip(axes, curve(name).inverse(F.col("id"), k, n), strict=False)))
