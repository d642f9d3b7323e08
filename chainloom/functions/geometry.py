"""Rectangles as structs of x, y, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<x:double,y:double,width:double,height:double>"
# The crawler's viewport.
VIEW_WIDTH, VIEW_HEIGHT = 1664.0, 919.0


def rect(x, y, width, height) -> Column:
    value = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(value(x).cast("double").alias("x"), value(y).cast("double").alias("y"), value(width).cast("double").alias("width"), value(height).cast("double").alias("height"))


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle; its width and height are 0 where there is none."""
    left, top = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    right, bottom = F.least(a["x"] + a["width"], b["x"] + b["width"]), F.least(a["y"] + a["height"], b["y"] + b["height"])
    return rect(left, top, F.greatest(right - left, F.lit(0.0)), F.greatest(bottom - top, F.lit(0.0)))


def covers_view(r: Column, ratio: float = 0.4) -> Column:
    """Whether a rectangle covers at least this share of the viewport."""
    common = intersection(rect(0, 0, VIEW_WIDTH, VIEW_HEIGHT), r)
    return common["width"] * common["height"] >= ratio * VIEW_WIDTH * VIEW_HEIGHT


def area_rect(shape: Column, coords: Column, image: Column) -> Column:
    """The absolute rectangle of an image map's area: a rect, or the square around a circle; null for other shapes."""
    n = F.transform(F.split(coords, r"\s*,\s*"), lambda c: c.try_cast("double"))
    at = lambda i: F.try_element_at(n, F.lit(i))
    box = rect(image["x"] + at(1), image["y"] + at(2), at(3) - at(1), at(4) - at(2))
    circle = rect(image["x"] + at(1) - at(3), image["y"] + at(2) - at(3), 2 * at(3), 2 * at(3))
    kind = F.lower(shape)
    return F.when(kind == "rect", box).when(kind == "circle", circle)
