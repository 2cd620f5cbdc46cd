"""Column expressions that read the layout of a rectified plate from its text mask and the boxes of the mask's components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow.functions import layout as l
from plateflow.functions.arrays import active, runs, smoothed, widest_two
from plateflow.functions.geometry import box, number, pad
from plateflow.functions.masks import crop, row_profile, width
from plateflow.functions.text import clamp, let
from plateflow.settings import DEFAULTS

#: Share of the mean of a smoothed profile that rows of text reach: where rows divide boxes, where a second row is expected, where not.
DIVIDES, EXPECTED, UNEXPECTED = 0.48, 0.44, 0.50
#: Score from which two rows are taken for two rows.
TWO_ROWS = 0.50


def expected_two_row(layout: Column, profile: Column) -> Column:
    """Whether either of the hints says that a plate has two rows."""
    return F.coalesce(layout == "two_row", F.lit(False)) | F.coalesce(profile == "two_row", F.lit(False))


def projected(mask: Column, u: Column, share: float | Column) -> Column:
    """struct(height, a, b, balance, apart): the two tallest bands of text rows in a part u of a mask; null if there are none."""

    def of(p: Column) -> Column:
        found = let(smoothed(p), lambda s: let(active(s, 0.02, share), lambda a: widest_two(runs(a))))
        enough = F.size(F.filter(p, lambda v: v > 0)) >= 2
        return let(found, lambda w: F.when(enough & w.isNotNull(), F.struct(F.size(p).alias("height"), w["a"].alias("a"), w["b"].alias("b"), w["balance"].alias("balance"), w["apart"].alias("apart"))))

    return let(row_profile(crop(mask, u)), of)


def _split(top: Column, bottom: Column, two: Column) -> Column:
    return F.struct(top.alias("top"), bottom.alias("bottom"), two.alias("two"))


def projection_split(boxes: Column, mask: Column, expected: Column) -> Column:
    """struct(top, bottom, two): boxes divided between the two tallest bands of rows. Two boxes on each side are asked for where two
    rows are not expected."""
    plain = F.transform(boxes, lambda b: box(b["x"], b["y"], b["w"], b["h"]))

    def at(u: Column) -> Column:
        def of(p: Column) -> Column:
            row = F.floor((p["a"]["last"] + p["b"]["first"]) / 2) + u["y"] - 1
            middle = lambda b: b["y"] + b["h"] / 2
            halves = F.struct(F.filter(plain, lambda b: middle(b) <= row).alias("top"), F.filter(plain, lambda b: middle(b) > row).alias("bottom"))

            def judged(h: Column) -> Column:
                two = (F.size(h["top"]) >= F.when(expected, 1).otherwise(2)) & (F.size(h["bottom"]) >= F.when(expected, 1).otherwise(2))
                return F.when(p.isNotNull() & two, _split(h["top"], h["bottom"], F.lit(True))).otherwise(_split(plain, F.slice(plain, 1, 0), F.lit(False)))

            return let(halves, judged)

        return let(projected(mask, u, DIVIDES), of)

    able = (F.size(boxes) > 0) & (expected | (F.size(boxes) >= 4))
    return F.when(able, let(l.whole_union(boxes), at)).otherwise(_split(plain, F.slice(plain, 1, 0), F.lit(False)))


def rows_of(boxes: Column, mask: Column, expected: Column, least: float = DEFAULTS["rectification"]["row_gap"]) -> Column:
    """struct(top, bottom, two): boxes divided at their widest gap, or, where that does not make two rows, by projection."""
    direct = l.split_rows(boxes, F.size(mask).cast("double"), least)
    return let(direct, lambda r: F.when(r["two"], _split(r["top"], r["bottom"], r["two"])).otherwise(projection_split(boxes, mask, expected)))


def projection_rows(boxes: Column, mask: Column, expected: Column, padding: float = DEFAULTS["rectification"]["padding"]) -> Column:
    """struct(rows, score): a box around each of the two tallest bands of rows, and how much they look like two rows of text; no rows
    and 0 if there are not two."""

    def at(u: Column) -> Column:
        def of(p: Column) -> Column:
            n = p["height"].cast("double")
            margin, tall = F.greatest(F.lit(1.0), F.round(padding * n)), F.greatest(F.lit(8.0), F.round(0.24 * u["h"]))
            centre = F.floor((p["a"]["last"] + p["b"]["first"]) / 2)

            def above(t: Column) -> Column:
                y2 = F.greatest(t + tall - 1, centre)

                def below(e: Column) -> Column:
                    first = F.least(n, F.greatest(e["y2"] + 1, centre + 1 - margin))
                    last = F.least(n, F.greatest(first + tall - 1, p["b"]["last"] + margin))
                    late = F.least(n - 1, F.greatest(e["y2"] + 1, p["b"]["first"].cast("double")))
                    again = F.least(n, F.greatest(late + 1, p["b"]["last"] + margin))
                    flat = last <= first
                    return let(F.struct(F.when(flat, late).otherwise(first).alias("y1"), F.when(flat, again).otherwise(last).alias("y2")), lambda b: F.array(_row(u, e["y1"], e["y2"]), _row(u, b["y1"], b["y2"])))

                return let(F.struct(t.alias("y1"), y2.alias("y2")), below)

            made = let(F.greatest(F.lit(1.0), p["a"]["first"] - margin), above)
            apart = F.least(F.lit(1.0), p["apart"] / F.greatest(0.08 * n, F.lit(1.0)))
            covered = F.least(F.lit(1.0), u["w"] / F.greatest(0.10 * width(mask), F.lit(1.0)))
            none = F.slice(F.array(u), 1, 0)
            return F.struct(F.when(p.isNotNull(), made).otherwise(none).alias("rows"), F.when(p.isNotNull(), clamp(l.mean([p["balance"], apart, covered]))).otherwise(0.0).alias("score"))

        return let(projected(mask, u, F.when(expected, EXPECTED).otherwise(UNEXPECTED)), of)

    nothing = F.struct(F.transform(F.slice(boxes, 1, 0), lambda b: box(b["x"], b["y"], b["w"], b["h"])).alias("rows"), F.lit(0.0).alias("score"))
    return F.when(F.size(boxes) > 0, let(l.whole_union(boxes), at)).otherwise(nothing)


def _row(u: Column, y1: Column, y2: Column) -> Column:
    return box(F.greatest(F.lit(1.0), u["x"]), F.greatest(F.lit(1.0), u["y"] + y1 - 1), u["w"], F.greatest(F.lit(2.0), y2 - y1 + 1))


def clusters(boxes: Column) -> Column:
    """array<array<box>>: boxes in order of x, a new cluster where the gap to all before is over max(4, .85 of the median width)."""
    order = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))))
    half = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2

    def of(e: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            at = F.when(acc["n"] == 0, 1).when(b["x"] - acc["end"] > e["limit"], acc["n"] + 1).otherwise(acc["n"])
            return F.struct(F.greatest(acc["end"], b["x"] + b["w"]).alias("end"), at.alias("n"), F.concat(acc["of"], F.array(at)).alias("of"))

        # The end of a cluster lies behind those of all before it, so one running end does for all.
        start = F.struct(F.lit(float("-inf")).alias("end"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))
        placed = F.aggregate(e["s"], start, step)
        mine = lambda p, k: F.transform(F.filter(e["s"], lambda b, i: F.get(p["of"], i) == k), lambda b: box(b["x"], b["y"], b["w"], b["h"]))
        return let(placed, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(p["n"], F.lit(1))), lambda k: mine(p, k)))

    return let(let(order, lambda s: F.struct(s.alias("s"), F.greatest(F.lit(4.0), 0.85 * half(F.sort_array(F.transform(s, lambda b: b["w"])))).alias("limit"))), of)


def best_cluster(boxes: Column, mask: Column, expected: Column) -> Column:
    """Of a plate that should have two rows the boxes of the cluster that looks most like its text (the leftmost of equals), rows by
    projection; all boxes if there are fewer than three or two rows are not expected."""
    plain = F.transform(boxes, lambda b: box(b["x"], b["y"], b["w"], b["h"]))

    def best(cs: Column) -> Column:
        def rated(c: Column, i: Column) -> Column:
            two = projection_split(c, mask, F.lit(True))["two"]
            return F.struct(l.cluster_score(c, width(mask).cast("double"), F.size(mask).cast("double"), two).alias("score"), (-i).alias("order"), c.alias("c"))

        return F.when(F.size(cs) <= 1, plain).otherwise(F.array_max(F.transform(cs, rated))["c"])

    return F.when(expected & (F.size(boxes) >= 3), let(clusters(boxes), best)).otherwise(plain)


BOX = "struct<x:double,y:double,w:double,h:double>"


def with_description(plates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """Adds description, struct(score, layout, text_box, rows, count): what a text mask shows. Two rows of boxes are tried first, then
    two bands of the projection; the first of them that reaches TWO_ROWS counts, else it is one row. plates: mask, boxes (those that
    may be characters), expected (two rows) and contrast (between the mask's pixels and the others). Without boxes the layout is
    unknown and the score 0. Its steps are columns one after another: nothing is shuffled."""
    r = settings["rectification"]
    mask, b, g = F.col("mask"), F.col("_b"), F.col("_g")
    w, h = width(mask).cast("double"), F.size(mask).cast("double")
    x = plates.withColumn("_b", best_cluster(F.col("boxes"), mask, F.col("expected")))
    x = x.withColumn("_g", rows_of(b, mask, F.col("expected"), r["row_gap"]))
    x = x.withColumn("_d", F.when(g["two"], l.two_row_mask_score(g["top"], g["bottom"], b, h)))
    direct = F.coalesce(F.col("_d") >= TWO_ROWS, F.lit(False))
    x = x.withColumn("_p", F.when(~direct, projection_rows(b, mask, F.col("expected"), r["padding"])))
    bands = (F.size("_p.rows") >= 2) & (F.col("_p.score") >= TWO_ROWS)
    kind = lambda score, layout, rows, n: F.struct(score.alias("score"), F.lit(layout).alias("layout"), rows.alias("rows"), F.lit(n).alias("count"))
    one = kind(l.single_row_score(b, h, 0.14), "single_line", _bounds([b], w, h, r["padding"]), 1)
    x = x.withColumn("_k", F.when(direct, kind(F.col("_d"), "two_row", _bounds([g["top"], g["bottom"]], w, h, r["padding"]), 2)).when(bands, kind(F.col("_p.score"), "two_row", F.col("_p.rows"), 2)).otherwise(one))
    text = pad(l.whole_union(b), r["left"], r["right"], r["vertical"], w, h)
    score = clamp(l.mean([F.col("_k.score"), l.coverage_score(b, w, h), F.col("contrast")]))
    made = F.struct(score.alias("score"), F.col("_k.layout").alias("layout"), text.alias("text_box"), F.col("_k.rows").alias("rows"), F.col("_k.count").alias("count"))
    none = F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("layout"), F.lit(None).cast(BOX).alias("text_box"), F.array().cast(f"array<{BOX}>").alias("rows"), F.lit(0).alias("count"))
    return x.withColumn("description", F.when(F.size("boxes") > 0, made).otherwise(none)).drop("_b", "_g", "_d", "_p", "_k")


def _bounds(groups: list[Column], w: Column, h: Column, padding: float) -> Column:
    return F.array(*(pad(l.whole_union(g), *(0.04 + 0.5 * padding,) * 3, w, h) for g in groups))


def text_region(bright: Column, dark: Column, size: tuple[Column | float, Column | float]) -> Column:
    """Of the descriptions of a plate's bright and dark masks the one of greater score (bright of equals), with polarity; the whole
    plate (width, height) if neither shows text."""
    b = F.when(bright["score"] >= dark["score"], F.struct(bright.alias("d"), F.lit("bright").alias("polarity"))).otherwise(F.struct(dark.alias("d"), F.lit("dark").alias("polarity")))

    def of(x: Column) -> Column:
        text = F.coalesce(x["d"]["text_box"], box(F.lit(1.0), F.lit(1.0), number(size[0]), number(size[1])))
        return F.struct(x["d"]["layout"].alias("layout"), text.alias("text_box"), x["d"]["rows"].alias("rows"), x["d"]["count"].alias("count"), x["d"]["score"].alias("score"), x["polarity"].alias("polarity"))

    return let(b, of)
