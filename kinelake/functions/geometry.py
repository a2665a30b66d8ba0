"""Plane and space geometry on landmark columns; NULL stands for every missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions of the used landmarks in a frame's landmark list.
NOSE = 0
SHOULDERS, ELBOWS, WRISTS = (11, 12), (13, 14), (15, 16)
HIPS, KNEES, ANKLES = (23, 24), (25, 26), (27, 28)
LANDMARKS = 33


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(value), F.lit(default))


def point(landmarks: Column, index: int) -> Column:
    """landmark as struct (x, y, z), NULL if it is missing or any part isn't a finite number."""
    mark = F.get(landmarks, F.lit(index))
    x, y, z = (finite(mark[c]) for c in ("x", "y", "z"))
    return F.when((x + y + z).isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def mid(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(*[((a[c] + b[c]) / 2.0).alias(c) for c in "xyz"]))


def distance(a: Column, b: Column, parts: str = "xyz") -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in parts), F.lit(0.0)))


def angle_between(u: tuple[Column, ...], v: tuple[Column, ...]) -> Column:
    """degrees between two vectors, NULL if either has no length."""
    dot = sum((p * q for p, q in zip(u, v, strict=True)), F.lit(0.0))
    lengths = F.sqrt(sum((p * p for p in u), F.lit(0.0))) * F.sqrt(sum((q * q for q in v), F.lit(0.0)))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.when(lengths > 1e-12, lengths)))
    return F.degrees(F.acos(cosine))


def vertex_angle(a: Column, vertex: Column, b: Column) -> Column:
    return angle_between(tuple(a[c] - vertex[c] for c in "xyz"), tuple(b[c] - vertex[c] for c in "xyz"))


def heading(a: Column, b: Column, null_if_same: bool = False) -> Column:
    """degrees of the line from a to b in the image plane."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    line = F.degrees(F.atan2(dy, dx))
    return F.when((dx != 0) | (dy != 0), line) if null_if_same else line


def wrapped(difference: Column) -> Column:
    """difference of degrees in [-180, 180)."""
    return F.pmod(difference + 180.0, F.lit(360.0)) - 180.0


def circular_mean(degrees: Column) -> Column:
    """A4: aggregate; 0 without values or when both means are exactly 0."""
    return F.coalesce(F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))), F.lit(0.0))
