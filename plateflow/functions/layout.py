"""Column expressions over the boxes of one plate (arrays of structs x, y, w, h): rows, gaps and how well they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plateflow.functions.geometry import EPS, box, pad, union_box
from plateflow.functions.text import clamp, let

# Least and most of a character's box, relative to its plate (share of the area, height, width) and width by height.
CHARACTER = {"area": (0.0007, 0.20), "height": (0.08, 0.95), "width": (0.008, 0.28), "aspect": (0.05, 1.80)}
#: The same in a rectified plate.
RECTIFIED = {"area": (0.0012, 0.20), "height": (0.08, 0.95), "width": (0.008, 0.32), "aspect": (0.05, 1.80)}
# Characters that a plate of one row has, and one of two.
ONE_ROW, TWO_ROW = (3, 8), (4, 9)


def mean(values: list[Column]) -> Column:
    total = values[0]
    for v in values[1:]:
        total = total + v
    return total / len(values)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def average(x: Column) -> Column:
    return _sum(x) / F.size(x)


def spread(x: Column) -> Column:
    """Standard deviation of a sample; 0 for one value."""
    squares = let(average(x), lambda m: _sum(F.transform(x, lambda v: (v - m) * (v - m))))
    return F.when(F.size(x) < 2, 0.0).otherwise(F.sqrt(squares / F.greatest(F.size(x) - 1, F.lit(1))))


def character_boxes(boxes: Column, area: str, width: float, height: float, limits: dict = CHARACTER) -> Column:
    """The boxes that may be characters of a plate of that size. area: the field with the pixels of the box's component."""
    ratio = {"area": lambda b: b[area] / (width * height), "height": lambda b: b["h"] / height, "width": lambda b: b["w"] / width, "aspect": lambda b: b["w"] / F.greatest(b["h"], F.lit(EPS))}

    def within(b: Column) -> Column:
        out = F.lit(True)
        for k, (low, high) in limits.items():
            out = out & ratio[k](b).between(low, high)
        return out

    return F.filter(boxes, within)


def expected_count(n: Column, target: tuple[int, int]) -> Column:
    far = F.least(F.abs(n - target[0]), F.abs(n - target[1]))
    return F.when(n.between(*target), 1.0).when(n <= 1, 0.0).otherwise(F.greatest(F.lit(0.15), 0.85 - 0.12 * far))


def middles(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: b["y"] + b["h"] / 2)


def heights(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: b["h"])


def gap_consistency(boxes: Column) -> Column:
    """How alike the gaps between neighbours are; overlaps do not count."""

    def of(s: Column) -> Column:
        gaps = F.filter(F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, i: b["x"] - (F.get(s, i)["x"] + F.get(s, i)["w"])), lambda g: g >= 0)
        even = let(gaps, lambda g: F.when(F.size(g) == 0, 0.25).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - spread(g) / (average(g) + 1)))))
        return F.when(F.size(s) <= 2, 0.75).otherwise(even)

    return let(F.sort_array(F.transform(boxes, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["w"].alias("w")))), of)


def _even(values: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - spread(values) / F.greatest(limit, F.lit(EPS)))


def row_compactness(boxes: Column, height: float) -> Column:
    return clamp(mean([_even(middles(boxes), F.lit(0.10 * height)), _even(heights(boxes), average(heights(boxes))), gap_consistency(boxes)]))


def single_row_score(boxes: Column, height: float, slack: float = 0.16) -> Column:
    """How well boxes stand in one row; 0 for none. slack: of the height, the spread of middles at which nothing is left."""
    parts = [expected_count(F.size(boxes), ONE_ROW), _even(middles(boxes), F.lit(slack * height)), _even(heights(boxes), average(heights(boxes))), gap_consistency(boxes)]
    return F.when(F.size(boxes) == 0, 0.0).otherwise(clamp(mean(parts)))


def split_rows(boxes: Column, height: float, least: float = 0.08) -> Column:
    """struct(top, bottom, gap, two): boxes cut at the widest gap between middles (the first of equals), if it is at least .45 of
    the mean height and least of the plate's height, and leaves two boxes on each side."""

    def of(s: Column) -> Column:
        steps = F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, i: F.struct((b["cy"] - F.get(s, i)["cy"]).alias("gap"), (-(i + 1)).alias("order")))

        def cut(m: Column) -> Column:
            at, plain = -m["order"], F.transform(s, lambda b: box(b["x"], b["y"], b["w"], b["h"]))
            two = (F.size(s) >= 4) & (m["gap"] >= F.greatest(0.45 * average(heights(plain)), F.lit(least * height))) & (at >= 2) & (F.size(s) - at >= 2)
            two = F.coalesce(two, F.lit(False))
            top = F.when(two, F.slice(plain, F.lit(1), F.coalesce(at, F.lit(0)))).otherwise(plain)
            bottom = F.when(two, F.slice(plain, F.coalesce(at, F.lit(0)) + 1, F.size(s))).otherwise(F.slice(plain, 1, 0))
            return F.struct(top.alias("top"), bottom.alias("bottom"), F.when(two, m["gap"]).otherwise(0.0).alias("gap"), two.alias("two"))

        return let(F.array_max(steps), cut)

    return let(F.sort_array(F.transform(boxes, lambda b, i: F.struct((b["y"] + b["h"] / 2).alias("cy"), i.alias("i"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))), of)


def horizontal_consistency(top: Column, bottom: Column, every: Column) -> Column:
    def of(u: Column) -> Column:
        a, b, c = u["a"], u["b"], u["c"]
        common = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
        overlap = common / F.greatest(F.least(a["w"], b["w"]), F.lit(EPS))
        offset = F.greatest(F.lit(0.0), 1 - F.abs((a["x"] + a["w"] / 2) - (b["x"] + b["w"] / 2)) / F.greatest(0.22 * c["w"], F.lit(EPS)))
        balance = F.greatest(F.lit(0.0), 1 - F.abs(a["w"] - b["w"]) / F.greatest(F.greatest(a["w"], b["w"]), F.lit(EPS)))
        part = lambda x: x["w"] / F.greatest(0.42 * c["w"], F.lit(EPS))
        return clamp(mean([overlap, offset, balance, F.least(F.lit(1.0), part(a), part(b))]))

    return let(F.struct(union_box(top).alias("a"), union_box(bottom).alias("b"), union_box(every).alias("c")), of)


def _two_rows(top: Column, bottom: Column, every: Column, height: float) -> dict[str, Column]:
    n, hs = F.size(every), average(heights(every))
    return {
        "count": expected_count(n, TWO_ROW),
        "balance": F.greatest(F.lit(0.0), 1 - F.abs(F.size(top) - F.size(bottom)) / F.greatest(n, F.lit(1))),
        "top": row_compactness(top, height),
        "bottom": row_compactness(bottom, height),
        "heights": F.greatest(F.lit(0.0), 1 - F.abs(average(heights(top)) - average(heights(bottom))) / F.greatest(hs, F.lit(EPS))),
        "horizontal": horizontal_consistency(top, bottom, every),
    }


def two_row_score(top: Column, bottom: Column, every: Column, height: float, gap: Column) -> Column:
    """How well boxes stand in two rows, as the detector sees it."""
    p = _two_rows(top, bottom, every, height)
    apart = F.least(F.lit(1.0), gap / F.greatest(0.55 * average(heights(every)), F.lit(EPS)))
    return clamp(mean([p["count"], p["balance"], mean([p["top"], p["bottom"]]), p["heights"], apart, p["horizontal"]]))


def two_row_mask_score(top: Column, bottom: Column, every: Column, height: float) -> Column:
    """The same in a rectified plate: rows count one by one, the gap does not."""
    return clamp(mean(list(_two_rows(top, bottom, every, height).values())))


def layout_evidence(boxes: Column, height: float) -> Column:
    """struct(count, single, two, rows, layout, alignment, density) of a plate's character boxes."""

    def of(r: Column) -> Column:
        n = F.size(boxes)
        two = F.when(r["two"], two_row_score(r["top"], r["bottom"], boxes, height, r["gap"])).otherwise(0.08 * expected_count(n, TWO_ROW))

        def judged(x: Column) -> Column:
            is_two = r["two"] & (x["two"] >= 0.56) & (x["two"] > x["single"] + 0.10)
            some = lambda v: F.when(n == 0, 0.0).otherwise(clamp(v))
            return F.struct(
                n.alias("count"),
                some(x["single"]).alias("single"),
                some(x["two"]).alias("two"),
                F.when(n == 0, 0).when(r["two"], 2).otherwise(1).alias("rows"),
                F.when(n == 0, "unknown").when(is_two, "two_row").otherwise("single_line").alias("layout"),
                some(F.when(is_two, x["two"]).otherwise(x["single"])).alias("alignment"),
                some(F.when(is_two, expected_count(n, TWO_ROW)).otherwise(expected_count(n, ONE_ROW))).alias("density"),
            )

        return let(F.struct(single_row_score(boxes, height).alias("single"), two.alias("two")), judged)

    return let(split_rows(boxes, height), of)


def coverage_score(boxes: Column, width: float, height: float) -> Column:
    """How much of a rectified plate its text takes, against .68 of the width and .42 of the height."""
    u = whole_union(boxes)
    return clamp(mean([F.greatest(F.lit(0.0), 1 - F.abs(u["w"] / width - 0.68) / 0.42), F.greatest(F.lit(0.0), 1 - F.abs(u["h"] / height - 0.42) / 0.28)]))


def whole_union(boxes: Column) -> Column:
    """The least box of whole pixels around boxes."""
    low = lambda k: F.floor(F.array_min(F.transform(boxes, lambda b: b[k]))).cast("double")
    high = lambda k, s: F.ceil(F.array_max(F.transform(boxes, lambda b: b[k] + b[s]))).cast("double")
    return box(low("x"), low("y"), F.greatest(F.lit(1.0), high("x", "w") - low("x")), F.greatest(F.lit(1.0), high("y", "h") - low("y")))


def cluster_score(boxes: Column, width: float, height: float, two_rows: Column) -> Column:
    """How much a cluster of boxes looks like the text of a plate of two rows."""
    u = whole_union(boxes)
    filled = F.least(F.lit(1.0), _sum(F.transform(boxes, lambda b: b["w"] * b["h"])) / F.greatest(u["w"] * u["h"], F.lit(1.0)))
    near = lambda v, target, slack: F.greatest(F.lit(0.0), 1 - F.abs(v - target) / slack)
    centre = near(u["x"] + u["w"] / 2, width / 2, F.greatest(F.lit(0.55) * width, F.lit(1.0)))
    return 0.28 * F.least(F.lit(1.0), F.size(boxes) / 6) + 0.24 * filled + 0.20 * near(u["w"] / width, 0.30, 0.32) + 0.14 * near(u["h"] / height, 0.48, 0.40) + 0.08 * centre + 0.06 * F.when(two_rows, 1.0).otherwise(0.28)


def row_boxes(rows: list[Column], width: int, height: int, padding: float = 0.06) -> Column:
    """A box with margins around each of a plate's rows of boxes."""
    return F.array(*(pad(whole_union(r), *(0.04 + 0.5 * padding,) * 3, width, height) for r in rows))


def text_evidence(bright: Column, dark: Column, variance: Column, gradient: Column) -> Column:
    """struct(texture, contrast, alignment, count, empty, layout, rows, single, two): what a picture shows of text, by the evidence
    (of layout_evidence, and contrast) of its bright or of its dark mask, whichever is stronger (bright of equals). variance: the
    mean of the local deviations; gradient: the mean step from column to column."""
    strength = lambda e: 0.58 * e["alignment"] + 0.42 * e["contrast"]

    def of(e: Column) -> Column:
        texture = clamp(mean([F.least(F.lit(1.0), variance / 0.10), F.least(F.lit(1.0), gradient / 0.12), e["density"]]))
        return let(texture, lambda t: F.struct(t.alias("texture"), e["contrast"].alias("contrast"), e["alignment"].alias("alignment"), e["count"].alias("count"), clamp(1 - mean([t, e["contrast"], e["alignment"]])).alias("empty"), e["layout"].alias("layout"), e["rows"].alias("rows"), e["single"].alias("single"), e["two"].alias("two")))

    return let(F.when(strength(bright) >= strength(dark), bright).otherwise(dark), of)
