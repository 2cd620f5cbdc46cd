"""Column expressions over boxes: structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def number(v: Column | float) -> Column:
    """A size given as a number or as a column."""
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def box(x, y, w, h) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, Column) else v.cast("double").alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)))


def area(a: Column) -> Column:
    return a["w"] * a["h"]


def intersection(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union <= 0, 0.0).otherwise(intersection(a, b) / union)


def overlap(a: Column, b: Column) -> Column:
    """The greater of IoU and the share of the smaller box that the other covers."""
    return F.greatest(iou(a, b), intersection(a, b) / F.greatest(F.least(area(a), area(b)), F.lit(EPS)))


def union_box(boxes: Column) -> Column:
    """The least box around an array of boxes; an empty one at 1, 1 for none."""
    low = lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))
    high = lambda k, s: F.array_max(F.transform(boxes, lambda b: b[k] + b[s]))
    return F.when(F.size(boxes) > 0, box(low("x"), low("y"), high("x", "w") - low("x"), high("y", "h") - low("y"))).otherwise(box(1, 1, 0, 0))


def expand(a: Column, across: float, down: float, width: int, height: int) -> Column:
    """A box grown about its centre, cut at the image."""
    x1 = F.greatest(F.lit(1.0), F.floor(a["x"] + a["w"] / 2 - a["w"] * across / 2))
    y1 = F.greatest(F.lit(1.0), F.floor(a["y"] + a["h"] / 2 - a["h"] * down / 2))
    x2 = F.least(F.lit(float(width)), F.ceil(a["x"] + a["w"] / 2 + a["w"] * across / 2))
    y2 = F.least(F.lit(float(height)), F.ceil(a["y"] + a["h"] / 2 + a["h"] * down / 2))
    return box(x1, y1, F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1))


def to_original(a: Column, scale: Column, width: int, height: int) -> Column:
    """A box of a scaled image in the image's own pixels; null for scale 0."""
    low = lambda v: F.greatest(F.lit(1.0), F.floor(v / scale))
    x, y = low(a["x"]), low(a["y"])
    side = lambda v, at, n: F.when(at + F.greatest(F.lit(1.0), F.ceil(v / scale)) > n, F.greatest(F.lit(1.0), F.lit(float(n)) - at)).otherwise(F.greatest(F.lit(1.0), F.ceil(v / scale)))
    return F.when(scale != 0, box(x, y, side(a["w"], x, width), side(a["h"], y, height)))


def fit(v: Column, target: float, low: float, high: float) -> Column:
    """Of a measure: 1 at its target, at least .35 within its limits, falling off from .30 beyond them."""
    inside = F.greatest(F.lit(0.35), 1 - 0.9 * F.abs(v - target) / (high - low))
    below, above = F.greatest(F.lit(0.0), 0.30 - (low - v) / abs(low)), F.greatest(F.lit(0.0), 0.30 - (v - high) / abs(high))
    return F.when(v < low, below).when(v > high, above).otherwise(inside)


def pad(a: Column, left: float, right: float, down: float, width: Column | float, height: Column | float) -> Column:
    """A box with margins, as shares of its sides, cut at the image."""
    x1, y1 = F.greatest(F.lit(1.0), F.floor(a["x"] - a["w"] * left)), F.greatest(F.lit(1.0), F.floor(a["y"] - a["h"] * down))
    x2 = F.least(number(width), F.ceil(a["x"] + a["w"] + a["w"] * right))
    y2 = F.least(number(height), F.ceil(a["y"] + a["h"] + a["h"] * down))
    return box(x1, y1, F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1))


def at_least_high(a: Column, least: int, height: Column | float) -> Column:
    """A box that is at least so high, grown above and below as far as the image goes."""
    more = least - a["h"]
    y1 = F.greatest(F.lit(1.0), a["y"] - F.floor(more / 2))
    y2 = F.least(number(height), a["y"] + a["h"] - 1 + F.ceil(more / 2))
    return F.when(a["h"] < least, box(a["x"], y1, a["w"], F.greatest(F.lit(1.0), y2 - y1 + 1))).otherwise(a)


def region_box(region: tuple[float, float, float, float], width: Column, height: Column) -> Column:
    """A region given by shares of an image (left, top, right, bottom) in its pixels."""
    x1, y1 = F.greatest(F.lit(1.0), F.floor(region[0] * width)), F.greatest(F.lit(1.0), F.floor(region[1] * height))
    x2, y2 = F.least(width.cast("double"), F.ceil(region[2] * width)), F.least(height.cast("double"), F.ceil(region[3] * height))
    return box(x1, y1, F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1))


def expand_for_branch(a: Column, branch: Column, factors: dict[str, tuple[float, float]], width: int, height: int) -> Column:
    """A box grown by its branch's factors (across, down); as it is for another branch."""
    out = a
    for name, (across, down) in factors.items():
        out = F.when(branch == name, expand(a, across, down, width, height)).otherwise(out)
    return out


def threshold_score(v: Column, low: float, high: float) -> Column:
    """1 between low and high, falling off to 0 at 0 and at 1."""
    return F.when(v <= low, F.greatest(F.lit(0.0), v / low)).when(v >= high, F.greatest(F.lit(0.0), 1 - (v - high) / (1 - high))).otherwise(1.0)


# What a detector branch counts.
BRANCH_SCORES = {"edge_priority": 0.95, "text_priority": 1.00, "text_dark_priority": 1.02, "dark_priority": 0.93, "mser_text": 0.98}


def branch_score(branch: Column, scale: Column) -> Column:
    base = F.lit(0.86)
    for name, x in BRANCH_SCORES.items():
        base = F.when(branch == name, x).otherwise(base)
    return F.greatest(F.lit(0.70), base - 0.10 * F.abs(scale - 1.0))


def component_count_score(n: Column, two_row: Column) -> Column:
    low, high = F.when(two_row, 4).otherwise(5), F.when(two_row, 9).otherwise(8)
    off = F.when(n < low, low - n).when(n > high, n - high).otherwise(0)
    return F.when(off == 0, 1.0).when(off == 1, 0.58).when(off == 2, 0.28).otherwise(0.10)


def axis_score(v: Column, target: float, low: float, high: float) -> Column:
    return F.when((v < low) | (v > high), 0.0).otherwise(F.greatest(F.lit(0.15), 1 - F.abs(v - target) / (high - low)))


def coverage_score(first: Column, last: Column, width: Column) -> Column:
    """Of a mask whose text goes from column first to last (null: none): how much of its width that takes."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((last - first + 1) / F.greatest(width, F.lit(1)) - 0.25) / 0.55)), F.lit(0.0))


def split_penalty(areas: Column, two_row: Column) -> Column:
    """How much of a mask lies outside its largest component. areas: of all components."""
    s = F.sort_array(areas, asc=False)
    total = F.aggregate(areas, F.lit(0.0), lambda a, v: a + v)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * (1 - F.get(s, F.lit(0)) / total) + 0.3 * (F.get(s, F.lit(1)) / total)))
    return F.when((F.size(areas) <= 1) | (total <= 0), 0.0).when(two_row, 0.40 * p).otherwise(p)


def boundary_penalty(a: Column, width: int, height: int) -> Column:
    """How near a box comes to the image's edges; above and below count .7."""
    across, down = max(8, int(0.02 * width + 0.5)), max(8, int(0.02 * height + 0.5))
    part = lambda margin, limit: F.greatest(F.lit(0.0), (limit - F.greatest(F.lit(0.0), margin)) / limit)
    sides = [part(a["x"] - 1, across), part(width - (a["x"] + a["w"]), across), 0.7 * part(a["y"] - 1, down), 0.7 * part(height - (a["y"] + a["h"]), down)]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), *sides))


def layout_match_score(layout: Column, rows: Column, two_row: Column) -> Column:
    match = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.72 * F.when(layout == "two_row", 1.0).otherwise(0.0) + 0.28 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), rows - 1.0))))
    return F.when(two_row, match).when((layout == "two_row") | (rows >= 2), 0.30).otherwise(1.0)


def area_threshold(width: Column, height: Column, factor: float, pixels: float = 30.0, ratio: float = 0.00008) -> Column:
    """Pixels that a component of a mask must have."""
    return F.greatest(F.lit(2.0), F.round(F.greatest(F.lit(pixels * factor * 0.35), width * height * ratio * factor)))


def band_margins(mask: Column) -> Column:
    """struct(left, right, span) of an array of flags by column: shares of the width before the first, behind the last, between."""
    n = F.greatest(F.size(mask), F.lit(1))
    first, last = F.array_position(mask, True), F.size(mask) - F.array_position(F.reverse(mask), True) + 1
    some = lambda v: F.when(first > 0, v / n).otherwise(0.0)
    return F.struct(some(first - 1).alias("left"), some(F.size(mask) - last).alias("right"), some(last - first + 1).alias("span"))
