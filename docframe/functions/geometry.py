"""Affine matrices (row vectors), rectangles and Bézier curves as struct and column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "abcdef"
A4 = (0.0, 0.0, 595.0, 842.0)


def matrix(*values: Column | float) -> dict[str, Column]:
    return {f: v if isinstance(v, Column) else F.lit(float(v)) for f, v in zip(FIELDS, values)}


IDENTITY = (1, 0, 0, 1, 0, 0)


def multiply(m: dict[str, Column], n: dict[str, Column]) -> dict[str, Column]:
    """m, then n."""
    return {
        "a": m["a"] * n["a"] + m["b"] * n["c"],
        "b": m["a"] * n["b"] + m["b"] * n["d"],
        "c": m["c"] * n["a"] + m["d"] * n["c"],
        "d": m["c"] * n["b"] + m["d"] * n["d"],
        "e": m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        "f": m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    }


def translate(x: Column, y: Column, m: dict[str, Column]) -> dict[str, Column]:
    return multiply(matrix(1, 0, 0, 1, x, y), m)


def scale(x: Column, y: Column, m: dict[str, Column]) -> dict[str, Column]:
    return multiply(matrix(x, 0, 0, y, 0, 0), m)


def rotate(angle: Column, m: dict[str, Column]) -> dict[str, Column]:
    return multiply(matrix(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle), 0, 0), m)


def apply(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return x * m["a"] + y * m["c"] + m["e"], x * m["b"] + y * m["d"] + m["f"]


def determinant(m: dict[str, Column]) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def invert(m: dict[str, Column]) -> dict[str, Column]:
    """Null where the matrix has no inverse."""
    det = F.nullif(determinant(m), F.lit(0.0))
    return {
        "a": m["d"] / det,
        "b": -m["b"] / det,
        "c": -m["c"] / det,
        "d": m["a"] / det,
        "e": (m["c"] * m["f"] - m["d"] * m["e"]) / det,
        "f": (m["b"] * m["e"] - m["a"] * m["f"]) / det,
    }


def nearly_equal(m: dict[str, Column], n: dict[str, Column], delta: float) -> Column:
    out = F.lit(True)
    for f in FIELDS:
        out = out & (F.abs(m[f] - n[f]) < delta)
    return out


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    return {"x1": F.least(x1, x2), "y1": F.least(y1, y2), "x2": F.greatest(x1, x2), "y2": F.greatest(y1, y2)}


def intersect(r: dict[str, Column], s: dict[str, Column]) -> dict[str, Column]:
    """The common part; where there is none, an empty rectangle at the larger of the low corners."""
    x1, y1 = F.greatest(r["x1"], s["x1"]), F.greatest(r["y1"], s["y1"])
    return {"x1": x1, "y1": y1, "x2": F.greatest(x1, F.least(r["x2"], s["x2"])), "y2": F.greatest(y1, F.least(r["y2"], s["y2"]))}


def contains(r: dict[str, Column], x: Column, y: Column) -> Column:
    return (x >= r["x1"]) & (x <= r["x2"]) & (y >= r["y1"]) & (y <= r["y2"])


def bounds(m: dict[str, Column], r: dict[str, Column]) -> dict[str, Column]:
    """Bounding rectangle of a transformed rectangle: least and greatest of its four corners."""
    corners = [apply(m, r[x], r[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = zip(*corners)
    return {"x1": F.least(*xs), "y1": F.least(*ys), "x2": F.greatest(*xs), "y2": F.greatest(*ys)}


def place(box: dict[str, Column], rect: dict[str, Column]) -> dict[str, Column]:
    """The matrix that maps a box onto a rectangle (annotation appearances)."""
    ratio = lambda a, b, c, d: F.when(b == a, 1.0).otherwise((d - c) / F.nullif(b - a, F.lit(0.0)))
    sx, sy = ratio(box["x1"], box["x2"], rect["x1"], rect["x2"]), ratio(box["y1"], box["y2"], rect["y1"], rect["y2"])
    return matrix(sx, 0, 0, sy, rect["x1"] - box["x1"] * sx, rect["y1"] - box["y1"] * sy)


def bezier(points: Sequence[Column], t: Column) -> Column:
    """One coordinate of a cubic curve."""
    p0, p1, p2, p3 = points
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3


def bezier_bounds(points: Sequence[Column]) -> tuple[Column, Column]:
    """Least and greatest value of one coordinate for t in 0..1: the ends, and the roots of the derivative between them."""
    p0, p1, p2, p3 = points
    a, b, c = -p0 + 3 * p1 - 3 * p2 + p3, 2 * p0 - 4 * p1 + 2 * p2, p1 - p0
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    two = F.nullif(2 * a, F.lit(0.0))
    found = [F.when(b * b - 4 * a * c >= 0, F.coalesce((-b + s * root) / two, -c / F.nullif(b, F.lit(0.0)))) for s in (1, -1)]
    at = [F.when((t > 0) & (t < 1), bezier(points, t)) for t in found]
    return F.least(p0, p3, *at), F.greatest(p0, p3, *at)
