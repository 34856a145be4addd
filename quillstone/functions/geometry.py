"""Boxes as structs of page fractions, regions and affine transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULTS, Params

SIDES = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(SIDES, (x1, y1, x2, y2), strict=True)])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def is_valid(b: Column, params: Params = DEFAULTS) -> Column:
    """Within the page, not degenerate, and of a least area. Null for a null box."""
    inside = F.lit(True)
    for n in SIDES:
        inside = inside & b[n].between(0.0, 1.0)
    return inside & (b["x1"] < b["x2"]) & (b["y1"] < b["y2"]) & (area(b) >= params.min_area)


def valid_or_null(b: Column, params: Params = DEFAULTS) -> Column:
    return F.when(is_valid(b, params), b)


def require_valid(b: Column, params: Params = DEFAULTS) -> Column:
    return F.when(is_valid(b, params), b).otherwise(F.raise_error(F.concat(F.lit("invalid box "), F.to_json(b))))


def normalize(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, params: Params = DEFAULTS) -> Column:
    """Page units to fractions: inverted corners swapped, clamped, null where the page or box is not sound."""

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    b = box(
        clamp(F.least(x1, x2) / width), clamp(F.least(y1, y2) / height), clamp(F.greatest(x1, x2) / width), clamp(F.greatest(y1, y2) / height)
    )
    return F.when((width > 0) & (height > 0), valid_or_null(b, params))


def denormalize(b: Column, width: Column, height: Column) -> Column:
    return F.array(b["x1"] * width, b["y1"] * height, b["x2"] * width, b["y2"] * height)


def to_list(b: Column) -> Column:
    return F.array(*[b[n] for n in SIDES])


def x_y_w_h(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def union_agg(b: Column) -> Column:
    """Aggregate: the smallest box around all."""
    return box(F.min(b["x1"]), F.min(b["y1"]), F.max(b["x2"]), F.max(b["y2"]))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    both = w * h
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def crop(b: Column, width: Column, height: Column, padding: float = 0.0) -> Column:
    """Whole pixels around a box widened by ``padding`` of the page, within the image."""

    def pixel(v: Column, size: Column) -> Column:
        return F.least(F.greatest(F.floor(v * size), F.lit(0)), size).cast("int")

    return F.struct(
        pixel(b["x1"] - padding, width).alias("left"),
        pixel(b["y1"] - padding, height).alias("top"),
        pixel(b["x2"] + padding, width).alias("right"),
        pixel(b["y2"] + padding, height).alias("bottom"),
    )


def script_score(script: Column) -> Column:
    return F.when(script == "handwritten", 1.0).when(script == "printed", 0.0).otherwise(0.5)


def base64_size(data: Column) -> Column:
    return F.length(F.base64(data))


def affine(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return F.struct(*[x.cast("double").alias(n) for n, x in zip("abcdef", (a, b, c, d, e, f), strict=True)])


def scale(sx: float, sy: float) -> Column:
    return affine(*map(F.lit, (sx, 0.0, 0.0, sy, 0.0, 0.0)))


def translate(tx: float, ty: float) -> Column:
    return affine(*map(F.lit, (1.0, 0.0, 0.0, 1.0, tx, ty)))


def then(first: Column, second: Column) -> Column:
    """``first`` followed by ``second``."""
    p, q = first, second
    return affine(
        q["a"] * p["a"] + q["c"] * p["b"],
        q["b"] * p["a"] + q["d"] * p["b"],
        q["a"] * p["c"] + q["c"] * p["d"],
        q["b"] * p["c"] + q["d"] * p["d"],
        q["a"] * p["e"] + q["c"] * p["f"] + q["e"],
        q["b"] * p["e"] + q["d"] * p["f"] + q["f"],
    )


def apply(t: Column, x: Column, y: Column) -> Column:
    return F.struct((t["a"] * x + t["c"] * y + t["e"]).alias("x"), (t["b"] * x + t["d"] * y + t["f"]).alias("y"))


def invert(t: Column) -> Column:
    """Null where the determinant is under 1e-12."""
    det = t["a"] * t["d"] - t["b"] * t["c"]
    back = affine(
        t["d"] / det,
        -t["b"] / det,
        -t["c"] / det,
        t["a"] / det,
        (t["c"] * t["f"] - t["d"] * t["e"]) / det,
        (t["b"] * t["e"] - t["a"] * t["f"]) / det,
    )
    return F.when(F.abs(det) >= 1e-12, back)


def chain(steps: Column) -> Column:
    """An array of transforms as one, in order."""
    return F.aggregate(steps, affine(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))), lambda acc, t: then(acc, t))


def map_box(t: Column, b: Column) -> Column:
    """The box around the four mapped corners."""
    corners = [apply(t, b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
