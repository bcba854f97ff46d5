"""Box arithmetic; a box is a struct of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    to = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(*(to(c).alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))))


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def clamp_box(b: Column, width: int, height: int) -> Column:
    x0, y0 = clamp(b["x0"], 0, width - 1), clamp(b["y0"], 0, height - 1)
    x1, y1 = clamp(b["x1"], 1, width), clamp(b["y1"], 1, height)
    x1, y1 = F.when(x1 <= x0, F.least(F.lit(width), x0 + 1)).otherwise(x1), F.when(y1 <= y0, F.least(F.lit(height), y0 + 1)).otherwise(y1)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def pad(b: Column, by: int, width: int, height: int) -> Column:
    return clamp_box(box(b["x0"] - by, b["y0"] - by, b["x1"] + by, b["y1"] + by), width, height)


def expand(b: Column, scale: float, width: int, height: int) -> Column:
    cx, cy = center_x(b), center_y(b)
    hw, hh = (b["x1"] - b["x0"]) * (scale / 2), (b["y1"] - b["y0"]) * (scale / 2)
    return clamp_box(box(*((c + s).cast("int") for c, s in ((cx, -hw), (cy, -hh), (cx, hw), (cy, hh)))), width, height)


def width(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    either = area(a) + area(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def contains_ratio(outer: Column, inner: Column) -> Column:
    return F.when(area(inner) > 0, intersection(outer, inner) / area(inner)).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    return (b["x0"] < a["x1"]) & (b["x1"] > a["x0"]) & (b["y0"] < a["y1"]) & (b["y1"] > a["y0"])


def polygon_box(points: Column) -> Column:
    """The box around an array of [x, y] points, cut to whole numbers."""
    at = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    return box(*(f(at(i)).cast("int") for f, i in ((F.array_min, 0), (F.array_min, 1), (F.array_max, 0), (F.array_max, 1))))


def covered(new: Column, old: Column) -> Column:
    """The share of a new box that an old one covers."""
    return F.when(area(new) > 0, intersection(new, old) / area(new)).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    dx, dy = center_x(a) - center_x(b), center_y(a) - center_y(b)
    return F.sqrt(dx * dx + dy * dy)


def canonical_key(b: Column) -> Column:
    return F.struct(F.floor(center_y(b).cast("int") / 50).alias("row"), center_x(b).cast("int").alias("col"))


def pair_score(pic: Column, text: Column, farthest: float = 300.0, direction: str = "below") -> Column:
    """Cost of a picture and a text: distance, wrong-side penalty, alignment bonus; null beyond reach."""
    d = distance(pic, text)
    sides = {"below": center_y(text) < center_y(pic), "above": center_y(text) > center_y(pic), "left": center_x(text) > center_x(pic), "right": center_x(text) < center_x(pic)}
    penalty = F.when(sides[direction], 200.0).otherwise(0.0) if direction in sides else F.lit(0.0)
    if direction == "below":
        penalty = penalty - F.when(F.abs(center_x(text) - center_x(pic)) < 0.5 * width(pic), 50.0).otherwise(0.0)
    across = F.least(pic["x1"], text["x1"]) - F.greatest(pic["x0"], text["x0"])
    bonus = F.when(across > 0, -30.0 * across / F.greatest(F.lit(1), F.least(width(pic), width(text)))).otherwise(0.0)
    return F.when(d <= farthest, F.greatest(F.lit(0.0), d + penalty + bonus))


def text_region(b: Column, ratio: float, position: Column) -> Column:
    """The part of a block that holds its text; an unknown position is the bottom."""
    w, h = ((b["x1"] - b["x0"]) * ratio).cast("int"), ((b["y1"] - b["y0"]) * ratio).cast("int")
    return (
        F.when(position == "top", box(b["x0"], b["y0"], b["x1"], b["y0"] + h))
        .when(position == "right", box(b["x1"] - w, b["y0"], b["x1"], b["y1"]))
        .when(position == "left", box(b["x0"], b["y0"], b["x0"] + w, b["y1"]))
        .otherwise(box(b["x0"], b["y1"] - h, b["x1"], b["y1"]))
    )


def window_below(b: Column, page_width: int, page_height: int) -> Column:
    side = F.floor((b["x1"] - b["x0"]) / 4).cast("int")
    return box(F.greatest(F.lit(0), b["x0"] - side), F.least(F.lit(page_height), b["y1"] + 5), F.least(F.lit(page_width), b["x1"] + side), F.least(F.lit(page_height), b["y1"] + 200))


def window_above(b: Column, page_width: int) -> Column:
    side = F.floor((b["x1"] - b["x0"]) / 2).cast("int")
    return box(F.greatest(F.lit(0), b["x0"] - side), F.greatest(F.lit(0), b["y0"] - 300), F.least(F.lit(page_width), b["x1"] + side), b["y0"])


def signature(b: Column) -> Column:
    return F.concat_ws(",", b["x0"], b["y0"], b["x1"], b["y1"])
