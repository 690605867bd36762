"""Rectangles, points, colours and easing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CANVAS_W, CANVAS_H = 1920, 1080
MARGIN, GAP = 60, 40
PANEL_COLOURS = ["blue", "orange", "red", "green", "purple"]


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def intersection(a: Column, b: Column) -> Column:
    """Area of what two rectangles share."""
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, the union 1 at least."""
    inter = intersection(a, b)
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Half-open containment."""
    return (x >= r["x"]) & (x < r["x"] + r["w"]) & (y >= r["y"]) & (y < r["y"] + r["h"])


def inset(r: Column, by: int = 14) -> Column:
    return F.struct((r["x"] + by).alias("x"), (r["y"] + by).alias("y"), (r["w"] - 2 * by).alias("w"), (r["h"] - 2 * by).alias("h"))


def centre(r: Column, w: Column, h: Column) -> Column:
    """Where a ``w`` by ``h`` object stands in the middle of ``r``."""
    return F.struct((r["x"] + F.floor((r["w"] - w) / 2)).alias("x"), (r["y"] + F.floor((r["h"] - h) / 2)).alias("y"))


def hex_to_bgr(colour: Column) -> Column:
    part = lambda i: F.conv(F.substring(F.ltrim(colour, F.lit("#")), i, 2), 16, 10).cast("int")
    return F.array(part(5), part(3), part(1))


def l1(a: list[Column], b: list[Column]) -> Column:
    """Sum of channel differences."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.abs(x.cast("int") - y.cast("int"))
    return total


def ease(t: Column) -> Column:
    """Cosine ease in and out over 0 to 1."""
    return 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def follow(now: Column, target: Column, factor: Column) -> Column:
    """One step toward ``target``, the factor held to 0.08 to 1."""
    return now + (target - now) * F.least(F.lit(1.0), F.greatest(F.lit(0.08), factor))


def grid(n: Column) -> Column:
    """Array of panels (no, x, y, w, h, color) for ``n`` elements: whole, halves, one over two, else two columns."""
    inner_w, inner_h = CANVAS_W - 2 * MARGIN, CANVAS_H - 2 * MARGIN
    half_w, half_h = (inner_w - GAP) // 2, (inner_h - GAP) // 2
    panel = lambda no, x, y, w, h: F.struct(
        F.lit(no).alias("no") if isinstance(no, int) else no.alias("no"),
        *[(F.lit(v) if isinstance(v, int) else v).cast("int").alias(k) for k, v in (("x", x), ("y", y), ("w", w), ("h", h))],
        F.element_at(F.array(*map(F.lit, PANEL_COLOURS)), ((F.lit(no) if isinstance(no, int) else no) - 1) % len(PANEL_COLOURS) + 1).alias("color"))
    one = F.array(panel(1, MARGIN, MARGIN, inner_w, inner_h))
    two = F.array(panel(1, MARGIN, MARGIN, half_w, inner_h), panel(2, MARGIN + half_w + GAP, MARGIN, half_w, inner_h))
    low = MARGIN + half_h + GAP
    three = F.array(panel(1, MARGIN, MARGIN, inner_w, half_h), panel(2, MARGIN, low, half_w, half_h), panel(3, MARGIN + half_w + GAP, low, half_w, half_h))
    rows = F.floor((n + 1) / 2).cast("int")
    h = F.floor((F.lit(inner_h) - (rows - 1) * GAP) / rows).cast("int")
    many = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: panel(
        i, F.lit(MARGIN) + ((i - 1) % 2) * (half_w + GAP), F.lit(MARGIN) + F.floor((i - 1) / 2) * (h + GAP), F.lit(half_w), h))
    return F.when(n <= 1, one).when(n == 2, two).when(n == 3, three).otherwise(many)
