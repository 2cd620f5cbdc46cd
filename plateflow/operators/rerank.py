"""Reranking: pairwise overlap within an image and the ordered adjustments that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.functions import masks
from plateflow.functions import text as texts
from plateflow.functions.geometry import EPS, area, overlap
from plateflow.functions.layout import mean
from plateflow.operators.attempts import recognition_score
from plateflow.settings import DEFAULTS

OVERLAP = DEFAULTS["reranking"]["overlap"]
recognition = recognition_score


def overlap_pairs(candidates: DataFrame, least: float = OVERLAP) -> DataFrame:
    """image, a, b, overlap for a < b that overlap. An image has at most as many candidates as non-maximum suppression keeps."""
    left = candidates.select("image", F.col("seq").alias("a"), F.col("box").alias("_a"))
    right = candidates.select("image", F.col("seq").alias("b"), F.col("box").alias("_b"))
    pairs = left.join(right, "image").where("a < b").withColumn("overlap", overlap(F.col("_a"), F.col("_b")))
    return pairs.where(F.col("overlap") >= least).drop("_a", "_b")


def adjusted(candidates: DataFrame, settings: dict = DEFAULTS, score: str = "score", reason: str = "reason", clean: bool = False) -> DataFrame:
    """All columns of the candidates, their score and reason after adjustments, pairs of an image in order of score (then of seq). Of
    an overlapping pair where one text holds the other, the longer gains and the contained one loses; where plates have no letter at
    their end and the longer one is the other with letters behind, it is the other way round. Each step stays within 0 and 1.
    candidates: image, seq, box, text, score; clean: texts are normalised already. One shuffle: beside each candidate lies what the pairs need of its image's candidates (a
    few dozen at most, as suppression keeps them), so nothing is joined, and its other columns stay columns: one that nobody reads
    later, the reason above all, is neither made nor carried."""
    r, suffix = settings["reranking"], settings["classification"]["suffix_letter"]
    if reason not in candidates.columns:
        candidates = candidates.withColumn(reason, F.lit(""))
    rest = [c for c in candidates.columns if c not in ("image", score, reason)]
    # What the pairs need lies flat and ready in an entry, since folds run node by node.
    t, b = F.coalesce("text", F.lit("")) if clean else texts.norm(F.col("text")), F.col("box")
    sides = {"x": b["x"], "y": b["y"], "x2": b["x"] + b["w"], "y2": b["y"] + b["h"], "area": area(b)}
    entry = F.struct((-F.col(score)).alias("order"), "seq", t.alias("t"), F.length(t).alias("n"), *(v.alias(k) for k, v in sides.items()))
    beside = candidates.withColumn("_a", entry).withColumn("_c", F.collect_list("_a").over(Window.partitionBy("image")))

    def texted(b: Column) -> Column:
        """Whether one of the texts is longer and holds the other."""
        holds = lambda x, y, n: (n > 0) & x.contains(y)
        return F.when(F.col("_n") > b["n"], holds(F.col("_t"), b["t"], b["n"])).otherwise((F.col("_n") < b["n"]) & holds(b["t"], F.col("_t"), F.col("_n")))

    def pair(a: Column, b: Column) -> Column:
        """What a gains and why, if it overlaps b, one of the texts holding the other."""
        gain = lambda v, why: F.struct(F.lit(float(v)).alias("d"), F.lit(f", Adj={why}({v:.2f})").alias("why"))
        fuller, part = gain(r["fuller_bonus"], "overlap_fuller_text_bonus"), gain(-r["substring_penalty"], "overlap_substring_penalty")
        if suffix:
            longer, shorter = fuller, part
        else:
            bad = lambda x, y: x.startswith(y) & x.rlike("^[A-Z]*[0-9]*[A-Z]+$") & y.rlike("^[A-Z]{1,4}[0-9]{1,4}$")
            longer = F.when(bad(a["t"], b["t"]), gain(-r["overlap_suffix_penalty"], "overlap_forbidden_suffix_penalty")).otherwise(fuller)
            shorter = F.when(bad(b["t"], a["t"]), gain(r["overlap_base_bonus"], "overlap_exact_base_bonus")).otherwise(part)
        side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
        common, least = side("x", "x2") * side("y", "y2"), F.lit(r["overlap"])
        union = a["area"] + b["area"] - common
        # As geometry.overlap, the share of the smaller box first: hardly ever is the other the greater one.
        near = (common / F.greatest(F.least(a["area"], b["area"]), F.lit(EPS)) >= least) | (F.when(union <= 0, 0.0).otherwise(common / union) >= least)
        return F.when(near, F.when(a["n"] > b["n"], longer).otherwise(shorter))

    # Each pair moves both by fixed steps, so a candidate's own steps in order are all that its score needs. Few pairs move at all,
    # so that only those are put in order: texts are compared first, and where all of an image are of one length, none moves.
    beside = beside.withColumns({"_t": F.col("_a.t"), "_n": F.col("_a.n")})
    moves = F.transform(F.filter("_c", texted), lambda b: F.struct(b["order"].alias("order"), b["seq"].alias("seq"), pair(F.col("_a"), b).alias("x")))
    steps = F.transform(F.sort_array(F.filter(moves, lambda m: m["x"].isNotNull())), lambda m: m["x"])
    made = beside.withColumn("_x", F.when(F.array_max("_c.n") > F.array_min("_c.n"), steps))
    still = F.coalesce(F.size("_x"), F.lit(0)) <= 0
    after = F.aggregate("_x", F.col(score), lambda acc, x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc + x["d"])))
    why = F.when(still, F.col(reason)).otherwise(F.concat(F.col(reason), F.array_join("_x.why", "")))
    return made.select("image", *rest, F.when(still, F.col(score)).otherwise(after).alias(score), why.alias(reason))


def selected(scored: DataFrame) -> DataFrame:
    """image, seq, score of each image's best candidate; the earlier one of equals."""
    best = scored.groupBy("image").agg(F.max(F.struct("score", (-F.col("seq")).alias("order"))).alias("x"))
    return best.select("image", (-F.col("x.order")).alias("seq"), F.col("x.score").alias("score"))


def with_final_score(candidates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """Adds final_score, scores (its parts) and reason. candidates: text (normalised), detector, evidence, recognition, and either
    frame_mask and frame_profile (the plate's mask and the columns of its middle band; framing, left_margin, right_margin and
    frame_label follow from them) or framing and left_margin as they are. What the text says counts by how far its reading is trusted; bonuses and penalties go by the scores as they are. One
    projection."""
    r, suffix = settings["reranking"], settings["classification"]["suffix_letter"]
    if {"frame_mask", "frame_profile"} <= set(candidates.columns):
        seen = masks.framing(F.col("text"), F.col("layout"), F.col("frame_mask"), F.col("frame_profile"))
        framed = candidates.withColumn("_f", seen)
        candidates = framed.withColumns({"framing": F.col("_f.score"), "left_margin": F.col("_f.left"), "right_margin": F.col("_f.right"), "frame_label": F.col("_f.label")}).drop("_f")
    label = F.col("frame_label") if "frame_label" in candidates.columns else F.when(F.col("text") != "", "text_band").otherwise("unknown")
    t, c = F.col("text"), lambda k: F.col(f"_{k}")
    # Each step's columns are made once for a row, in generated code (see `texts.apart`), and a part that nobody reads (the reason
    # above all) is not made.
    steps = [{"rec": texts.apart(texts.clamp(F.col("recognition")), t), "det": texts.clamp(F.col("detector")), "ev": texts.clamp(F.col("evidence")), "rule": texts.rule_number(t), **texts.shape_parts(t)}]
    form = {k: c(k) for k in ("p", "d", "s", "ordered")}
    steps.append({"letters": F.when(c("ordered"), c("p") + c("s")).otherwise(texts.letters(t)), "regex": texts.regex_score(t, form)})
    steps.append({"comp": texts.composition_score(t, c("letters")), "len": texts.length_score(t), "struct": texts.structure_score(t, form), "prefix": texts.prefix_plausibility(t, c("rule")), "weak": texts.apart(texts.clamp((r["weak_ocr"] - c("rec")) / r["weak_ocr"]), t)})
    w = lambda cond, v: F.when(cond, v).otherwise(0.0)
    some, p, d = t != "", c("p"), c("d")
    trust = F.greatest(F.lit(0.12), F.least(F.lit(1.0), F.greatest(F.lit(0.18), F.least(F.lit(1.0), 0.20 + 0.80 * c("rec"))) * (0.30 + 0.70 * c("prefix")) * (1 - 0.55 * c("weak"))))
    steps.append({"trust": texts.apart(trust, t), "state": F.when(c("prefix") == 1.0, 1.0).when(some, 0.20).otherwise(0.0)})
    mixed = lambda v: F.least(F.lit(1.0), c("trust") * (0.85 * v + 0.15 * c("rec")))
    plain = lambda v: F.least(F.lit(1.0), c("trust") * v)
    parts = {"detector": c("det"), "evidence": c("ev"), "recognition": c("rec"), "regex": mixed(c("regex")), "state": mixed(c("state")), "composition": plain(c("comp")), "length": plain(c("len")), "structure": plain(c("struct")), "framing": F.col("framing")}
    base = sum((r["weights"][k] * v for k, v in parts.items()), F.lit(0.0))
    bonus = F.when(c("regex") == 1.0, r["exact_bonus"]).when(c("regex") == 0.6, r["partial_bonus"]).otherwise(0.0) + w(c("comp") >= 0.85, r["mixed_bonus"]) + texts.apart(c("weak"), t) * (r["weak_detector_bonus"] * c("det") + r["weak_evidence_bonus"] * c("ev"))
    penalty = w(~some, r["empty"]) + w(c("ev") < 0.25, r["weak_texture"]) + F.when(c("comp") < 0.25, r["no_digit"]).when(c("comp") < 0.55, r["weak_composition"]).otherwise(0.0) + w(some & (c("letters") == 0), r["no_letter"]) + w(some & (c("len") < 0.35), r["bad_length"])
    penalty = penalty + w((p <= 1) & (d >= 3) & (F.col("left_margin") < 0.02), r["truncated"]) + w(some & d.between(1, 2), r["short_read"]) + w(some & (F.col("framing") < 0.35), r["weak_framing"]) + w(some & (c("prefix") < 0.20), r["bad_prefix"])
    if not suffix:
        penalty = penalty + r["forbidden_suffix"] * F.least(c("s"), F.lit(2))
    # The regex, composition and structure scores as they are (not by trust) stand in the report.
    kept = {**parts, "composition": c("comp"), "length": c("len"), "structure": c("struct")}
    shown = lambda v: F.format_string("%.2f", v)
    labels = {"Detector": shown(c("det")), "Plate": shown(c("ev")), "OCR": shown(c("rec")), "Regex": texts.regex_label(t, c("regex")), "Struct": texts.structure_label(t, form), "Frame": label, "Length": texts.length_label(t), "State": texts.state_name(c("rule")), "Text": t}
    reason = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v) for k, v in labels.items()))
    made = candidates
    for step in steps:
        made = made.withColumns({f"_{k}": v for k, v in step.items()})
    made = made.withColumns({"final_score": texts.clamp(base + bonus - penalty), "scores": F.struct(*(v.alias(k) for k, v in kept.items())), "reason": reason})
    return made.drop(*(f"_{k}" for step in steps for k in step))


def evidence(candidates: DataFrame) -> Column:
    """How much a candidate looks like a plate; measures that it lacks count 0, a missing empty_region 1."""
    has = lambda k, other: texts.clamp(F.coalesce(F.col(k), F.lit(other))) if k in candidates.columns else F.lit(other)
    parts = mean([has("character_texture", 0.0), has("plate_contrast", 0.0), has("alignment", 0.0)])
    return texts.clamp(parts - 0.35 * has("empty", 1.0))


def layout_of(recognised: Column, rectified: Column, detected: Column, profile: Column) -> Column:
    """The first of three layouts that is known; else two_row by the profile, else unknown."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(some(recognised), some(rectified), some(detected), F.when(profile == "two_row", "two_row"), F.lit("unknown"))


#: What a candidate has where it says nothing else.
BLANK = {"score": 0.0, "branch": "unknown", "profile": "unknown", "layout": "unknown", "scale": 1.0, "character_texture": 0.0, "plate_contrast": 0.0, "alignment": 0.0, "text_count": 0, "rows": 0, "empty": 1.0}


def normalised(candidates: DataFrame) -> DataFrame:
    """Adds the columns that candidates lack, with what stands for nothing."""
    return candidates.withColumns({k: F.lit(v) for k, v in BLANK.items() if k not in candidates.columns})


# The report's columns, and those that they come from.
REPORT = {"Rank": "rank", "FinalScore": "final_score", "Detector": "scores.detector", "PlateEvidence": "scores.evidence", "Recognition": "scores.recognition", "Regex": "scores.regex", "State": "scores.state", "Composition": "scores.composition", "LengthScore": "scores.length", "Structure": "scores.structure", "Framing": "scores.framing", "TextLength": "text_length", "Path": "path", "Profile": "profile", "Layout": "layout", "Branch": "branch", "RecognizedText": "text", "StateName": "state"}


def report(scored: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """The report on each image's best evaluated candidates."""
    t = F.col("text")
    full = normalised(scored).withColumns({"text_length": F.length(t), "path": F.lit("ocr"), "state": texts.identify_state(t)["name"]})
    by = Window.partitionBy("image").orderBy(F.desc("final_score"), "seq")
    ranked = full.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(1, round(settings["report"]["evaluated"])))
    return ranked.select("image", *(F.col(v).alias(k) for k, v in REPORT.items()))
