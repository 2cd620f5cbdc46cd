"""Column expressions over the mask of a plate (an array of rows of flags), its profiles, and the bands of text in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plateflow.functions.arrays import active, length, merge_runs, runs, widest_two
from plateflow.functions.geometry import band_margins, box
from plateflow.functions.layout import mean
from plateflow.functions.text import clamp, let

NO_MASK = "array<array<boolean>>"


def width(mask: Column) -> Column:
    return F.greatest(F.size(F.get(mask, F.lit(0))), F.lit(0))


def share(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda v: v)) / F.greatest(F.size(flags), F.lit(1))


def row_profile(mask: Column) -> Column:
    """Of each row the share that is on."""
    return F.transform(mask, share)


def _columns(mask: Column, each) -> Column:
    n = width(mask)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), each)).otherwise(F.transform(F.slice(F.sequence(F.lit(0), F.lit(0)), 1, 0), each))


def column_profile(mask: Column) -> Column:
    """Of each column the share that is on."""
    return _columns(mask, lambda x: F.size(F.filter(mask, lambda r: F.get(r, x))) / F.greatest(F.size(mask), F.lit(1)))


def column_flags(mask: Column) -> Column:
    """Of each column whether anything is on."""
    return _columns(mask, lambda x: F.exists(mask, lambda r: F.get(r, x)))


def some(mask: Column) -> Column:
    return F.exists(F.coalesce(mask, F.array().cast(NO_MASK)), lambda r: F.exists(r, lambda v: v))


def rows(mask: Column, run: Column) -> Column:
    return F.slice(mask, run["first"], length(run))


def crop(mask: Column, b: Column) -> Column:
    """The part of a mask that a box takes, both ends included, cut at the mask's edges."""

    def of(e: Column) -> Column:
        inside = F.transform(F.slice(mask, e["y1"], F.greatest(e["y2"] - e["y1"] + 1, F.lit(0))), lambda r: F.slice(r, e["x1"], F.greatest(e["x2"] - e["x1"] + 1, F.lit(0))))
        return F.when((e["y2"] >= e["y1"]) & (e["x2"] >= e["x1"]), inside).otherwise(F.slice(mask, 1, 0))

    low = lambda v: F.greatest(F.lit(1), F.round(v).cast("int"))
    high = lambda v, n: F.least(n, F.round(v).cast("int"))
    return let(F.struct(low(b["x"]).alias("x1"), low(b["y"]).alias("y1"), high(b["x"] + b["w"], width(mask)).alias("x2"), high(b["y"] + b["h"], F.size(mask)).alias("y2")), of)


def _near(v: Column, target: float, slack: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(v - target) / slack)


def _upto(v: Column, limit: float) -> Column:
    return F.least(F.lit(1.0), v / limit)


def _short(v: Column, limit: float) -> Column:
    return F.greatest(F.lit(0.0), (limit - v) / limit)


def _band(profile: Column) -> Column:
    """Margins and span of the columns of a band that hold text; null if none does."""
    return let(active(F.coalesce(profile, F.array().cast("array<double>")), 0.03, 0.45), lambda a: F.when(F.exists(a, lambda v: v), band_margins(a)))


def _two_bands(mask: Column) -> Column:
    """struct(some, any, two, top, bottom, balance, apart): the two widest bands of rows with text and their margins."""

    def of(p: Column) -> Column:
        def cut(w: Column) -> Column:
            margins = lambda k: F.when(w.isNotNull(), band_margins(column_flags(rows(mask, w[k]))))
            return F.struct(F.exists(p["v"], lambda v: v > 0).alias("some"), F.exists(p["a"], lambda v: v).alias("any"), w.isNotNull().alias("two"), margins("a").alias("top"), margins("b").alias("bottom"), w["balance"].alias("balance"), w["apart"].alias("apart"))

        return let(widest_two(runs(p["a"])), cut)

    whole = F.coalesce(mask, F.array().cast(NO_MASK))
    return let(let(row_profile(whole), lambda v: F.struct(v.alias("v"), active(v, 0.02, 0.55).alias("a"))), of)


def single_band(profile: Column) -> Column:
    """struct(score, clip): how complete a row of text looks in its band, and how much it is cut off. profile: by column."""

    def of(b: Column) -> Column:
        margin = 0.5 * _upto(b["left"], 0.05) + 0.5 * _upto(b["right"], 0.05)
        score = clamp(0.40 * margin + 0.25 * _near(b["left"] - b["right"], 0.0, 0.18) + 0.35 * _near(b["span"], 0.62, 0.24))
        clip = clamp(0.30 * _short(b["left"], 0.025) + 0.50 * _short(b["right"], 0.025) + 0.20 * F.greatest(F.lit(0.0), (b["span"] - 0.82) / 0.18))
        return F.struct(F.when(b.isNotNull(), score).otherwise(0.30).alias("score"), F.when(b.isNotNull(), clip).otherwise(0.0).alias("clip"))

    return let(_band(profile), of)


def _sides(b: Column, f, limit: float) -> Column:
    return mean([f(b[k][side], limit) for k in ("top", "bottom") for side in ("left", "right")])


def two_row_band(mask: Column, profile: Column) -> Column:
    """The same for two rows of text; of a mask with one band only, what single_band says of the profile, at .65."""

    def of(b: Column) -> Column:
        apart = F.least(F.lit(1.0), b["apart"] / F.greatest(0.10 * F.size(mask), F.lit(1.0)))
        span = mean([_near(b[k]["span"], 0.58, 0.32) for k in ("top", "bottom")])
        two = F.struct(clamp(mean([b["balance"], apart, span, _sides(b, _upto, 0.03)])).alias("score"), clamp(_sides(b, _short, 0.015)).alias("clip"))
        none = F.struct(F.lit(0.22).alias("score"), F.lit(0.0).alias("clip"))
        one = let(single_band(profile), lambda s: F.struct((0.65 * s["score"]).alias("score"), s["clip"].alias("clip")))
        return F.when(b["two"], two).when(~b["any"], none).otherwise(one)

    return let(_two_bands(mask), of)


def _frame(score: Column, label: str, left: Column, right: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), F.lit(label).alias("label"), left.cast("double").alias("left"), right.cast("double").alias("right"))


def _single_frame(profile: Column, label: str, factor: float) -> Column:
    nothing = _frame(F.lit(0.30 * factor), "no_text_band" if factor == 1 else label, F.lit(0), F.lit(0))

    def of(b: Column) -> Column:
        edge = _upto(b["left"], 0.025) * _upto(b["right"], 0.025)
        score = clamp(0.45 * edge + 0.30 * _near(b["left"] - b["right"], 0.0, 0.12) + 0.25 * _near(b["span"], 0.62, 0.28))
        return F.when(b.isNull(), nothing).otherwise(_frame(factor * score, label, b["left"], b["right"]))

    return let(_band(profile), of)


def framing(text: Column, layout: Column, mask: Column, profile: Column) -> Column:
    """struct(score, label, left, right): how well a plate frames its text, as reranking sees it. mask: of the whole plate; profile:
    of the columns of its middle band; both null for no picture."""

    def two(b: Column) -> Column:
        apart = F.least(F.lit(1.0), b["apart"] / F.greatest(0.08 * F.size(mask), F.lit(1.0)))
        span = mean([_near(b[k]["span"], 0.56, 0.34) for k in ("top", "bottom")])
        score = clamp(mean([_sides(b, _upto, 0.02), span, apart, b["balance"]]))
        of = _frame(score, "two_row_band", mean([b["top"]["left"], b["bottom"]["left"]]), mean([b["top"]["right"], b["bottom"]["right"]]))
        none = _frame(F.lit(0.25), "two_row_no_band", F.lit(0), F.lit(0))
        return F.when(b["two"], of).when(~b["some"], none).otherwise(_single_frame(profile, "fallback_single_band", 0.65))

    seen = (F.coalesce(text, F.lit("")) != "") & (mask.isNotNull() | profile.isNotNull())
    return F.when(~seen, _frame(F.lit(0.30), "unknown", F.lit(0), F.lit(0))).when(layout == "two_row", let(_two_bands(mask), two)).otherwise(_single_frame(profile, "text_band", 1.0))


def best_crop(mask: Column, boxes: Column) -> Column:
    """The box of a row of text within its mask: of the runs of columns with text, near ones merged, the one that looks most like a
    row (the first of equals), with margins; null if there is none. boxes: of the mask's components."""
    n, high = width(mask), F.size(mask)

    def rated(run: Column) -> Column:
        part = F.transform(mask, lambda r: F.slice(r, run["first"], length(run)))

        def of(x: Column) -> Column:
            within = runs(active(x["v"], 0.02, 0.35))

            def score(y: Column) -> Column:
                wide, tall = length(run), length(y)
                filled = F.aggregate(F.slice(x["m"], y["first"], tall), F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda v: v)))
                count = F.size(F.filter(boxes, lambda b: (b["x"] + b["w"] / 2).between(run["first"], run["last"])))
                edge = F.when((run["first"] == 1) | (run["last"] == n), 0.10).otherwise(0.0)
                total = 0.34 * F.least(F.lit(1.0), count / 4) + 0.24 * _near(wide / F.greatest(n, F.lit(1)), 0.55, 0.45) + 0.20 * _near(tall / F.greatest(high, F.lit(1)), 0.58, 0.40) + 0.22 * _upto(filled / F.greatest(wide * tall, F.lit(1)), 0.42) - edge
                return F.struct(total.alias("score"), (-run["first"]).alias("order"), box(run["first"], y["first"], wide, tall).alias("b"))

            whole = let(within, lambda w: F.struct(F.get(w, F.lit(0))["first"].alias("first"), F.try_element_at(w, F.lit(-1))["last"].alias("last"), F.size(w).alias("n")))
            return let(whole, lambda y: F.when(y["n"] > 0, score(y)))

        return let(let(part, lambda m: F.struct(m.alias("m"), row_profile(m).alias("v"))), of)

    def padded(b: Column) -> Column:
        across, down = F.greatest(F.lit(1.0), F.round(0.04 * n)), F.greatest(F.lit(1.0), F.round(0.08 * high))
        x1, y1 = F.greatest(F.lit(1.0), b["x"] - across), F.greatest(F.lit(1.0), b["y"] - down)
        x2, y2 = F.least(n.cast("double"), b["x"] + b["w"] - 1 + across), F.least(high.cast("double"), b["y"] + b["h"] - 1 + down)
        return F.when(b.isNotNull(), box(x1, y1, F.greatest(F.lit(2.0), x2 - x1 + 1), F.greatest(F.lit(2.0), y2 - y1 + 1)))

    near = F.greatest(F.lit(2), F.round(0.08 * n).cast("int"))
    merged = let(active(column_profile(mask), 0.02, 0.40), lambda a: merge_runs(runs(a), near))
    best = let(F.filter(merged, lambda r: length(r) >= 3), lambda rs: F.array_max(F.filter(F.transform(rs, rated), lambda x: x.isNotNull())))
    return F.when(some(mask), let(best["b"], padded))
