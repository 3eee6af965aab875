"""Coordinates, boxes and small integer functions as column expressions; coordinates are lists of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Coords = Sequence[Column]


def abs_diff(a: Column, b: Column) -> Column:
    return F.greatest(a, b) - F.least(a, b)


def manhattan(a: Coords, b: Coords) -> Column:
    return reduce(lambda x, y: x + y, (abs_diff(p, q) for p, q in zip(a, b, strict=True)))


def euclidean(a: Coords, b: Coords) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, ((p - q) * (p - q) for p, q in zip(a, b, strict=True))).cast("double"))


def chebyshev(a: Coords, b: Coords) -> Column:
    """Largest difference of one coordinate."""
    diffs = [abs_diff(p, q) for p, q in zip(a, b, strict=True)]
    return diffs[0] if len(diffs) == 1 else F.greatest(*diffs)


def distance(a: Coords, b: Coords, norm: str, whole: bool = False) -> Column:
    """Norm "l1", "l2" or "linf"; whole cuts l2 to an integer, as a distance of the coordinates' own type."""
    if norm == "l1":
        return manhattan(a, b)
    if norm == "linf":
        return chebyshev(a, b)
    if norm == "l2":
        return F.floor(euclidean(a, b)).cast("long") if whole else euclidean(a, b)
    raise ValueError(f"unknown norm: {norm}")


def compare_all(a: Coords, b: Coords, op: str) -> Column:
    """All components satisfy <, <=, > or >=."""
    ops = {"<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
    return reduce(lambda x, y: x & y, (ops[op](p, q) for p, q in zip(a, b, strict=True)))


def add(a: Coords, b: Coords) -> list[Column]:
    return [p + q for p, q in zip(a, b, strict=True)]


def subtract(a: Coords, b: Coords) -> list[Column]:
    return [p - q for p, q in zip(a, b, strict=True)]


def unit(i: int, n: int) -> list[Column]:
    return [F.lit(int(i == j)).cast("long") for j in range(n)]


def box(a: Coords, b: Coords) -> tuple[list[Column], list[Column]]:
    """Lower and upper corner of the closed box that two points span."""
    return [F.least(p, q) for p, q in zip(a, b, strict=True)], [F.greatest(p, q) for p, q in zip(a, b, strict=True)]


def box_contains(low: Coords, high: Coords, point: Coords) -> Column:
    return reduce(lambda x, y: x & y, (c.between(p, q) for p, q, c in zip(low, high, point, strict=True)))


def box_expand(low: Coords, high: Coords, point: Coords) -> tuple[list[Column], list[Column]]:
    return [F.least(p, c) for p, c in zip(low, point, strict=True)], [F.greatest(q, c) for q, c in zip(high, point, strict=True)]


def box_area(low: Coords, high: Coords) -> Column:
    return reduce(lambda x, y: x * y, (q - p + 1 for p, q in zip(low, high, strict=True)))


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def bit_length(v: Column) -> Column:
    """Bits of a number of 0 or more; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def ilog2(v: Column, strict: bool = True) -> Column:
    """Logarithm of a power of two; of anything else an error, or null if not strict."""
    other = F.raise_error(F.lit("not a power of two")).cast("int") if strict else F.lit(None).cast("int")
    return F.when(is_power_of_two(v), bit_length(v) - 1).otherwise(other)


def power_of_two(exponent: int) -> Column:
    """2 to the exponent, as a constant."""
    return F.lit(1 << exponent).cast("long")


#: Bits of the integer types.
TYPE_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "float": 32, "double": 64}


def sizeof_bits(type_name: str) -> int:
    return TYPE_BITS[type_name]


def compare_words(a: Column, b: Column) -> Column:
    """-1, 0 or 1: the order of two binary or array columns, element by element, a prefix first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def each_combination(items: Column, f) -> Column:
    """f(a, b) of each pair of elements of an array, a before b, in order; no join and no shuffle."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda b: f(a, b))))


def int_power(base: Column, exponent: int) -> Column:
    """Whole power by squaring; 0 to the 0 is 1, overflow raises (ANSI mode)."""
    out = F.lit(1).cast("long")
    for digit in bin(exponent)[2:]:
        out = out * out
        if digit == "1":
            out = out * base.cast("long")
    return out


def next_power_of_two(v: Column) -> Column:
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(v - 1))))


def is_multiple_of(v: Column, of: Column | int) -> Column:
    return v % of == 0
