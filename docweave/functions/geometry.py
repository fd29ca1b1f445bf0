"""Boxes: structs of x0, y0, x1, y1 within 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, Column) else v.cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def valid(b: Column) -> Column:
    return (b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= 1) & (b["y1"] <= 1) & (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def centre(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the boxes don't truly overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    union = area(a) + area(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(0.0)


def normalise(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixels to shares of the page, clamped; a page without extent raises."""
    checked = lambda v, name: F.when(v > 0, v).otherwise(F.raise_error(F.lit(f"page {name} must be positive")).cast("double"))
    w, h = checked(width, "width"), checked(height, "height")
    share = lambda v, by: F.least(F.greatest(v / by, F.lit(0.0)), F.lit(1.0))
    return box(share(x0, w), share(y0, h), share(x1, w), share(y1, h))
