"""Column functions on boxes: columns x0, y0, x1, y1 in points, or structs with these fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLEARANCE = 0.25


def box(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap_x(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def intersection(a: Column, b: Column) -> Column:
    return overlap_x(a, b) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def overlaps(a: Column, b: Column, clearance: float = 0.0) -> Column:
    """Whether the insides meet, the second box widened by a clearance."""
    return (a["x0"] < b["x1"] + clearance) & (a["x1"] > b["x0"] - clearance) & (a["y0"] < b["y1"] + clearance) & (a["y1"] > b["y0"] - clearance)


def inside(a: Column, b: Column) -> Column:
    return (a["x0"] >= b["x0"]) & (a["y0"] >= b["y0"]) & (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"])


def near(a: Column, b: Column, dx: float, dy: float) -> Column:
    """Whether the gaps between two boxes are at most dx and dy."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), a[lo] - b[hi], b[lo] - a[hi])
    return (gap("x0", "x1") <= dx) & (gap("y0", "y1") <= dy)


def subtract(a: Column, b: Column, sliver: float = 0.25) -> Column:
    """The up to four parts of a that b leaves, as an array: above, below, left, right; slivers go."""
    top, bottom = F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"])
    part = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    parts = F.array(part(a["x0"], a["y0"], a["x1"], top), part(a["x0"], bottom, a["x1"], a["y1"]), part(a["x0"], top, F.greatest(a["x0"], b["x0"]), bottom), part(F.least(a["x1"], b["x1"]), top, a["x1"], bottom))
    left = F.filter(parts, lambda p: (p["x1"] - p["x0"] > sliver) & (p["y1"] - p["y0"] > sliver))
    return F.when(overlaps(a, b), left).otherwise(F.array(a))


def cut_out(source: Column, blockers: Column) -> Column:
    """What blockers leave of a box: a fold over the blockers."""
    return F.aggregate(blockers, F.array(source), lambda acc, b: F.flatten(F.transform(acc, lambda a: subtract(a, b))))


def cut_outs(source: Column, blockers: Column) -> Column:
    """How many blockers take something away from what the ones before them left."""

    def step(acc: Column, b: Column) -> Column:
        pieces = F.flatten(F.transform(acc["pieces"], lambda a: subtract(a, b)))
        return F.struct(pieces.alias("pieces"), (acc["n"] + F.when(pieces == acc["pieces"], 0).otherwise(1)).alias("n"))

    return F.aggregate(blockers, F.struct(F.array(source).alias("pieces"), F.lit(0).alias("n")), step, lambda a: a["n"])


def rounded_box(values: Column) -> Column:
    """A box of an array as reports hold it: four finite numbers, to three places; null if it isn't one."""
    fine = (F.size(values) == 4) & ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(fine, F.transform(values, lambda v: F.round(v, 3)))


def line_box(x0: Column, x1: Column, baseline: Column, size: Column) -> Column:
    """The box that a line of text takes up."""
    return F.struct(x0.alias("x0"), (baseline - 0.95 * size).alias("y0"), x1.alias("x1"), (baseline + 0.15 * size).alias("y1"))
