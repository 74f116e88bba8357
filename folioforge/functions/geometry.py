"""Rectangles as structs (x0, y0, x1, y1), and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def clip(a: Column, b: Column) -> Column:
    """The common part; empty (see is_empty) if there is none."""
    return rect(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def is_empty(a: Column) -> Column:
    return (a.x0 >= a.x1) | (a.y0 >= a.y1)


def area(a: Column) -> Column:
    return F.when(is_empty(a), F.lit(0.0)).otherwise((a.x1 - a.x0) * (a.y1 - a.y0))


def contains_point(a: Column, x: Column, y: Column) -> Column:
    """Right and bottom edges are outside."""
    return ~is_empty(a) & (a.x0 <= x) & (x < a.x1) & (a.y0 <= y) & (y < a.y1)


def intersects(a: Column, b: Column) -> Column:
    return ~is_empty(a) & ~is_empty(b) & ~is_empty(clip(a, b))


def centre_x(a: Column) -> Column:
    return (a.x0 + a.x1) / 2


def centre_y(a: Column) -> Column:
    return (a.y0 + a.y1) / 2


def grow(a: Column, margin: float) -> Column:
    return rect(a.x0 - margin, a.y0 - margin, a.x1 + margin, a.y1 + margin)
