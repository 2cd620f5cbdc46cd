"""Detection as relations: candidates are rows of scalars and a box, keyed by image and sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.functions import geometry as g
from plateflow.functions.geometry import fit, iou
from plateflow.functions.layout import mean
from plateflow.functions.text import clamp
from plateflow.plans.dims import MEASURES, PROFILES
from plateflow.settings import DEFAULTS

KEEP, TOP, SAME = DEFAULTS["detection"]["keep"], DEFAULTS["reranking"]["evaluate"], DEFAULTS["detection"]["same"]


def valid(candidates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """The candidates whose measures lie within the settings' limits (an area, a width and a height within both, extent and solidity
    from the least on)."""
    out = candidates
    for name, (low, high) in settings["detection"]["valid"].items():
        out = out.where(F.col(name).between(low, high))
    for name, low in settings["detection"]["least"].items():
        out = out.where(F.col(name) >= low)
    return out


def mser_regions(regions: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """The regions (with a box) whose width by height fits a character."""
    low, high = settings["detection"]["mser_aspect"]
    return regions.where((F.col("box.w") / F.greatest(F.col("box.h"), F.lit(g.EPS))).between(low, high))


def united(*streams: DataFrame) -> DataFrame:
    """The candidates of several branches as one table: candidates that come in order of branch keep it by their seq."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def _profile_score(k: int, settings: dict) -> dict:
    """The score of a candidate under the k-th profile, with its parts."""
    name, *limits = PROFILES[k]
    c, two, d = F.col, F.lit(name == "two_row"), settings["detection"]
    fits = [fit(c(m), *limits[i]) for i, m in enumerate(MEASURES)]
    alignment = F.greatest(clamp(c("two_alignment" if name == "two_row" else "single_alignment")), 0.70 * c("alignment"))
    parts = {
        "geometry": mean(fits),
        "shape": mean([g.threshold_score(c("extent"), 0.22, 0.78), g.threshold_score(c("solidity"), 0.18, 0.85)]),
        "texture": mean([g.threshold_score(c("edge_density"), 0.04, 0.32), F.least(c("contrast"), F.lit(1.0)), c("character_texture")]),
        "branch": g.branch_score(c("branch"), c("scale")),
        "evidence": mean([c("character_texture"), c("plate_contrast"), alignment]),
        "count": g.component_count_score(c("text_count"), two),
        "coverage": c("coverage"),
        "position": mean([g.axis_score(c("centre_x"), *d["centre"]["horizontal"]), g.axis_score(c("centre_y"), *d["centre"]["vertical"])]),
        "span": mean([fits[1], fits[2], fits[0]]),
        "band": c("two_band" if name == "two_row" else "single_band"),
        "layout": g.layout_match_score(c("layout"), c("rows"), two),
    }
    split = F.when(two | (c("layout") == "two_row"), 0.40 * c("split")).otherwise(c("split"))
    taken = {"empty": c("empty"), "split": split, "clip": c("two_clip" if name == "two_row" else "single_clip"), "boundary": c("boundary")}
    final = F.lit(0.0)
    for key, x in parts.items():
        final = final + d["weights"][key] * x
    for key, x in taken.items():
        final = final - d["penalties"][key] * x
    return {"final": final, **parts}


def scored(candidates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """Adds profile, score and breakdown (the parts of the score) of the profile that gives the greatest score; the earlier one of
    equals. Three profiles are three expressions of one row. candidates: measures, centre_x and centre_y, boundary, branch, scale,
    layout, rows, and what the pixels gave: extent, solidity, edge_density, contrast, character_texture, plate_contrast, alignment,
    single_alignment, two_alignment, text_count, coverage, split, empty, and band and clip under both layouts."""
    rows = []
    for k, p in enumerate(PROFILES):
        x = _profile_score(k, settings)
        rows.append(F.struct(x["final"].alias("score"), F.lit(-k).alias("seq"), F.lit(p[0]).alias("profile"), F.struct(*(v.alias(n) for n, v in x.items() if n != "final")).alias("breakdown")))
    best = candidates.withColumn("_best", F.greatest(*rows))
    return best.withColumns({"profile": F.col("_best.profile"), "score": F.col("_best.score"), "breakdown": F.col("_best.breakdown")}).drop("_best")


def with_profile(candidates: DataFrame) -> DataFrame:
    """Adds profile and geometry: the profile whose mean fit is greatest (the earlier one of equals). Three profiles are three
    expressions of one row, so nothing is joined or sorted."""
    scored = [F.struct((F.round(sum((fit(F.col(m), *p[i + 1]) for i, m in enumerate(MEASURES)), F.lit(0.0)) / 4, 6)).alias("geometry"), F.lit(-k).alias("seq"), F.lit(p[0]).alias("profile")) for k, p in enumerate(PROFILES)]
    return candidates.withColumn("_best", F.greatest(*scored)).withColumns({"profile": F.col("_best.profile"), "geometry": F.col("_best.geometry")}).drop("_best")


def nms(candidates: DataFrame, same: float = SAME, keep: int = KEEP) -> DataFrame:
    """image, kept: greedy non-maximum suppression by score (of equals the earlier one); kept holds the whole records in order of
    score. An image's candidates (a few dozen) are one fold, so nothing is joined back."""
    rest = [c for c in candidates.columns if c not in ("image", "seq", "box", "score")]
    entry = F.struct((-F.col("score")).alias("order"), "seq", "box", "score", *rest)

    def add(acc, e):
        near = F.exists(acc, lambda a: iou(a["box"], e["box"]) >= same)
        return F.when((F.size(acc) >= keep) | near, acc).otherwise(F.concat(acc, F.array(e)))

    ordered = candidates.groupBy("image").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return ordered.select("image", F.aggregate("c", F.slice("c", 1, 0), add).alias("kept"))


def detected(candidates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """The best candidates of each image with their rank and all their columns: validity, scores, suppression and choice in one
    grouping by image. candidates: of all branches (see `united`), with the measures that `valid` and `scored` need; seq orders
    candidates as their branches come. image, seq, box and score lead over to `recognition.results`."""
    d, top = settings["detection"], settings["reranking"]["evaluate"]
    kept = nms(scored(valid(candidates, settings), settings), d["same"], d["keep"])
    best = kept.select("image", F.posexplode(F.slice("kept", 1, max(1, round(top)))).alias("rank", "e"))
    names = [f for f in kept.schema["kept"].dataType.elementType.names if f != "order"]
    return best.select("image", *(F.col(f"e.{n}").alias(n) for n in names), (F.col("rank") + 1).alias("rank"))


def top_k(candidates: DataFrame, k: int = TOP) -> DataFrame:
    """The k best candidates of each image, with their rank."""
    by = Window.partitionBy("image").orderBy(F.desc("score"), "seq")
    return candidates.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def horizontal_clusters(boxes: DataFrame, key: str) -> DataFrame:
    """Adds cluster: boxes in order of x, a new cluster where the gap to all before is over max(4, .85 of the median width)."""
    by = Window.partitionBy(key).orderBy("x", "seq")
    ends = F.max(F.col("x") + F.col("w")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    limit = F.greatest(F.lit(4.0), 0.85 * F.median("w").over(Window.partitionBy(key)))
    gap = boxes.withColumn("_limit", limit).withColumn("_new", F.when(F.col("x") - ends > F.col("_limit"), 1).otherwise(0))
    return gap.withColumn("cluster", (1 + F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).cast("int")).drop("_new", "_limit")


def summary(candidates: DataFrame) -> DataFrame:
    """image, best and n: the score of each image's best candidate, and how many it has."""
    return candidates.groupBy("image").agg(F.max("score").alias("best"), F.count("*").alias("n"))


# The report's columns, and those that they come from.
REPORT = {"Rank": "rank", "Score": "score", "Branch": "branch", "Profile": "profile", "Layout": "layout", "Rows": "rows", "Aspect": "aspect", "AreaRatio": "area_ratio", "WidthRatio": "width_ratio", "HeightRatio": "height_ratio", "EdgeDensity": "edge_density", "Contrast": "contrast", "CharTexture": "character_texture", "PlateContrast": "plate_contrast", "Alignment": "alignment", "EmptyPenalty": "empty", "TextCount": "text_count"}


def report(candidates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """The report on each image's best candidates."""
    best = top_k(candidates, max(1, round(settings["report"]["detection"])))
    return best.select("image", *(F.col(v).alias(k) for k, v in REPORT.items()))


def gap_split(boxes: DataFrame, key: str, height: int, least: float = 0.08) -> DataFrame:
    """key, n_top, gap of each image whose boxes fall into two rows: the widest gap between centres (the first of equals) is at
    least .45 of the mean height and `least` of the image's height, and leaves two boxes on each side."""
    by = Window.partitionBy(key).orderBy("_cy", "seq")
    placed = boxes.withColumn("_cy", F.col("y") + F.col("h") / 2).withColumn("_n", F.row_number().over(by) - 1).withColumn("_gap", F.col("_cy") - F.lag("_cy").over(by))
    widest = placed.groupBy(key).agg(F.count("*").alias("_all"), F.avg("h").alias("_h"), F.max(F.when(F.col("_gap").isNotNull(), F.struct("_gap", (-F.col("_n")).alias("_order")))).alias("_x"))
    n_top, gap = -F.col("_x._order"), F.col("_x._gap")
    two = (F.col("_all") >= 4) & (gap >= F.greatest(0.45 * F.col("_h"), F.lit(least * height))) & (n_top >= 2) & (F.col("_all") - n_top >= 2)
    return widest.where(two).select(key, n_top.cast("int").alias("n_top"), F.round(gap, 6).alias("gap"))


def skew(lines: DataFrame, key: str, settings: dict = DEFAULTS) -> DataFrame:
    """key, angle, confidence: the mean angle of each image's lines, weighted by their length, and the share of length within 2.5
    degrees of it. lines: angle and length; too short and too steep ones don't count. Two folds of an image's own lines, one shuffle."""
    r = settings["rectification"]
    turned = (F.pmod(F.col("angle") + 90, F.lit(180.0)) - 90).alias("angle")
    used = lines.select(key, turned, "length").where((F.col("length") >= r["min_length"]) & (F.abs("angle") <= r["max_degrees"]))
    found = used.groupBy(key).agg((F.sum(F.col("angle") * F.col("length")) / F.sum("length")).alias("angle"), F.sum("length").alias("_total"), F.collect_list(F.struct("angle", "length")).alias("_l"))
    near = F.aggregate(F.filter("_l", lambda e: F.abs(e["angle"] - F.col("angle")) <= 2.5), F.lit(0.0), lambda acc, e: acc + e["length"])
    return found.select(key, F.round("angle", 6).alias("angle"), F.round(near / F.col("_total"), 6).alias("confidence"))
