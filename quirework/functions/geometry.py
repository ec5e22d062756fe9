"""Rectangles as structs of ``x0, y0, x1, y1`` (float), with y growing downwards, and what pages are made of."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<x0: float, y0: float, x1: float, y1: float>"
ITALIC, FIXED, SERIF, SYMBOLIC, BOLD = 1, 2, 4, 8, 256


def rect(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The rectangle with these opposite corners."""
    corners = (F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by))
    return F.struct(*(c.cast("float").alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1"), strict=True)))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def center_x(r: Column) -> Column:
    return (r["x0"] + r["x1"]) * F.lit(0.5).cast("float")


def center_y(r: Column) -> Column:
    return (r["y0"] + r["y1"]) * F.lit(0.5).cast("float")


def is_empty(r: Column) -> Column:
    return (width(r) <= 0) | (height(r) <= 0)


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def hull(r: Column) -> Column:
    """Aggregate: the rectangle around all."""
    return F.struct(F.min(r["x0"]).alias("x0"), F.min(r["y0"]).alias("y0"), F.max(r["x1"]).alias("x1"), F.max(r["y1"]).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def x_overlap(a: Column, b: Column) -> Column:
    """Length that both share, negative for a gap."""
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def y_overlap(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def near(a: Column, b: Column, gap: float = 24.0) -> Column:
    return (x_overlap(a, b) >= -gap) & (y_overlap(a, b) >= -gap)


def overlap_fraction(a: Column, b: Column) -> Column:
    """Shared width of the narrower."""
    return x_overlap(a, b) / F.greatest(F.least(width(a), width(b)), F.lit(1.0))


def aligned(a: Column, b: Column) -> Column:
    """Rules of one table: much of the narrower is shared, and it isn't far narrower."""
    narrow, wide = F.least(width(a), width(b)), F.greatest(width(a), width(b))
    return (overlap_fraction(a, b) >= 0.6) & (narrow >= wide * 0.25)


def distance(x: Column, lo: Column, hi: Column) -> Column:
    """From a point to an interval."""
    return F.greatest(lo - x, x - hi, F.lit(0.0))


def affine(matrix: Column, x: Column, y: Column) -> Column:
    """A point under a matrix of six numbers ``[a, b, c, d, e, f]``."""
    return F.struct((matrix[0] * x + matrix[2] * y + matrix[4]).cast("float").alias("x"), (matrix[1] * x + matrix[3] * y + matrix[5]).cast("float").alias("y"))


def affine_rect(matrix: Column, r: Column) -> Column:
    a, b = affine(matrix, r["x0"], r["y0"]), affine(matrix, r["x1"], r["y1"])
    return rect(a["x"], a["y"], b["x"], b["y"])


def affine_angle(matrix: Column, angle: Column) -> Column:
    """The direction of a baseline under a matrix, in radians; 0 where it vanishes."""
    dx, dy = matrix[0] * F.cos(angle) + matrix[2] * F.sin(angle), matrix[1] * F.cos(angle) + matrix[3] * F.sin(angle)
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(F.atan2(dy, dx)).cast("float")


def is_horizontal(angle: Column) -> Column:
    """Within five degrees of the reading direction, angles in radians."""
    turn = F.pmod(F.abs(F.degrees(angle)), F.lit(360.0))
    return ~F.isnan(angle) & (F.abs(angle) != math.inf) & (F.least(turn, 360.0 - turn) <= 5.0)


def clip(r: Column, page_width: Column, page_height: Column) -> Column:
    """The part of a rectangle on its page; null if there is none or it isn't finite."""
    out = F.struct(F.greatest(r["x0"], F.lit(0.0)).cast("float").alias("x0"), F.greatest(r["y0"], F.lit(0.0)).cast("float").alias("y0"), F.least(r["x1"], page_width).cast("float").alias("x1"), F.least(r["y1"], page_height).cast("float").alias("y1"))
    finite = F.lit(True)
    for side in ("x0", "y0", "x1", "y1"):
        finite = finite & ~F.isnan(r[side]) & (F.abs(r[side]) != math.inf)
    return F.when(finite & ~is_empty(out), out)


def path_kind(r: Column) -> Column:
    """``hrule``, ``vrule`` or ``other`` by thinness."""
    w, h = width(r), height(r)
    return F.when((h <= 3) & (w >= 3 * h), "hrule").when((w <= 3) & (h >= 3 * w), "vrule").otherwise("other")


def path_thickness(r: Column) -> Column:
    return F.when(path_kind(r) == "hrule", height(r)).when(path_kind(r) == "vrule", width(r)).otherwise(F.least(width(r), height(r)))


def inflate(r: Column, line_width: Column) -> Column:
    """A path's box with its stroke: half the width all round, a hairline of 0.1 at least."""
    by = F.greatest(line_width, F.lit(0.1)) / 2
    return F.struct((r["x0"] - by).cast("float").alias("x0"), (r["y0"] - by).cast("float").alias("y0"), (r["x1"] + by).cast("float").alias("x1"), (r["y1"] + by).cast("float").alias("y1"))


def glyph_size(reported: Column, r: Column, angle: Column) -> Column:
    """The reported size if it is one, else what the ink suggests, else 1."""
    turn = F.pmod(F.abs(F.degrees(angle)), F.lit(180.0))
    ink = F.when((turn > 45) & (turn < 135), width(r)).otherwise(height(r)) / 0.7
    good = lambda x: ~F.isnan(x) & (x > 0) & (x < math.inf)
    return F.when(good(reported), reported).when(good(ink), ink).otherwise(F.lit(1.0)).cast("float")


def channel(value: Column) -> Column:
    """0..1 as 0..255."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("long")


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.shiftleft(channel(r), 24).bitwiseOR(F.shiftleft(channel(g), 16)).bitwiseOR(F.shiftleft(channel(b), 8)).bitwiseOR(channel(a))


def unpack_rgba(color: Column) -> Column:
    return F.struct(*(F.shiftright(color, s).bitwiseAND(F.lit(255)).alias(n) for n, s in (("r", 24), ("g", 16), ("b", 8), ("a", 0))))


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def with_flag(flags: Column, bit: int, on: bool = True) -> Column:
    return flags.bitwiseOR(F.lit(bit)) if on else flags.bitwiseAND(F.lit(~bit))


def bounds_of(points: Column) -> Column:
    """The box of an array of structs ``x, y``."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def upper_median(x: Column) -> Column:
    """Aggregate: of n sorted values the one at n div 2, counted from 0; null for none."""
    ordered = F.sort_array(F.collect_list(x))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))
