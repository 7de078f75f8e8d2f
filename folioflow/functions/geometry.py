"""Rectangles as four columns with a common prefix: ``<p>x0, <p>y0, <p>x1, <p>y1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(r) -> Column:
    return (r[2] - r[0]) * (r[3] - r[1])


def intersection_area(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_ratio(a, b) -> Column:
    """Of the first rectangle's area."""
    return F.when(area(a) == 0, 0.0).otherwise(intersection_area(a, b) / F.when(area(a) == 0, 1.0).otherwise(area(a)))


def x_overlap_ratio(a, b) -> Column:
    """Of the first rectangle's width, which counts as 1 at least."""
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) / F.greatest(a[2] - a[0], F.lit(1.0))


def center_inside(a, b) -> Column:
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def expanded(r, page, margin: float = 4.0):
    return F.greatest(r[0] - margin, page[0]), F.greatest(r[1] - margin, page[1]), F.least(r[2] + margin, page[2]), F.least(r[3] + margin, page[3])
