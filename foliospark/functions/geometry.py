"""Planar geometry as column expressions.

A matrix is a struct of doubles a, b, c, d, e, f that maps (x, y) to (a*x + c*y + e, b*x + d*y + f). A box is a struct of
doubles x0, y0, x1, y1. A null box is the whole plane where boxes are intersected and nothing where they are united.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIGNED_WITHIN = 1e-6


MATRIX = ("a", "b", "c", "d", "e", "f")
BOX = ("x0", "y0", "x1", "y1")


def fields(of: Column | str, names: tuple[str, ...], prefix: str | None = None) -> list[Column]:
    """A struct's fields as columns prefix_name; the prefix of a named column is its name."""
    whole, prefix = (F.col(of), prefix or of) if isinstance(of, str) else (of, prefix)
    return [whole[n].alias(f"{prefix}_{n}") for n in names]


def columns(prefix: str, names: tuple[str, ...]) -> list[Column]:
    """The columns that `fields` made."""
    return [F.col(f"{prefix}_{n}") for n in names]


def matrix(a, b, c, d, e, f) -> Column:
    return F.struct(*[_double(v).alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[_double(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def _double(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("double")


def product(m: Column, n: Column) -> Column:
    """The matrix that applies m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def mapped(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Where the matrix maps a point."""
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def is_aligned(m: Column) -> Column:
    """Whether the matrix keeps axes on axes without a quarter turn."""
    return (F.abs(m["b"]) < ALIGNED_WITHIN) & (F.abs(m["c"]) < ALIGNED_WITHIN)


def footprint(m: Column) -> Column:
    """The box around the image of the unit square."""
    xs = (m["e"], m["a"] + m["e"], m["c"] + m["e"], m["a"] + m["c"] + m["e"])
    ys = (m["f"], m["b"] + m["f"], m["d"] + m["f"], m["b"] + m["d"] + m["f"])
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def intersection(p: Column, q: Column) -> Column:
    """The common part; an empty one is the box of zeros; null if both are unbounded."""
    x0, y0 = F.greatest(p["x0"], q["x0"]), F.greatest(p["y0"], q["y0"])
    x1, y1 = F.least(p["x1"], q["x1"]), F.least(p["y1"], q["y1"])
    both = F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1)).otherwise(box(0.0, 0.0, 0.0, 0.0))
    return F.when(p.isNull() & q.isNull(), None).otherwise(both)


def hull(p: Column, q: Column) -> Column:
    """The box around both; null if both are nothing."""
    sides = box(F.least(p["x0"], q["x0"]), F.least(p["y0"], q["y0"]), F.greatest(p["x1"], q["x1"]), F.greatest(p["y1"], q["y1"]))
    return F.when(p.isNull() & q.isNull(), None).otherwise(sides)


def restoring_matrix(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """What puts a picture cut to (u0, v0, u1, v1) of its unit square back in its place; six decimals, as written to files."""
    return matrix(F.bround(u1 - u0, 6), 0.0, 0.0, F.bround(v1 - v0, 6), F.bround(u0, 6), F.bround(v0, 6))
