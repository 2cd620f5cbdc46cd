"""End to end: candidates and OCR attempts of images to one result an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateflow.functions import geometry
from plateflow.operators import attempts as tries
from plateflow.operators import detect, evaluate, rerank
from plateflow.settings import DEFAULTS
from plateflow.sources import ocr

#: Width and height of an image where none are given: boxes are cut at no edge.
ENDLESS = (float("inf"), float("inf"))
#: How a text was found, and what a result says of its way.
PATH, DONE, NO_TEXT, NO_PLATE = "ocr", "recognised", "a plate was found, but no text on it", "no candidate has passed"

#: Columns of the candidates that the scores need.
SCORED = ("box", "score", "profile", "layout", "framing", "left_margin", "frame_mask", "frame_profile", "frame_label", "character_texture", "plate_contrast", "alignment", "empty")


def padded(box: Column, size: tuple, settings: dict = DEFAULTS) -> Column:
    """A candidate's box with the margins that its text is read with, and the least height that reading needs."""
    d, r = settings["detection"], settings["rectification"]
    return geometry.at_least_high(geometry.pad(box, *(d["padding"],) * 3, *size), r["min_crop_height"], size[1])


def evaluated(candidates: DataFrame, attempts: DataFrame, hints: DataFrame | None, settings: dict = DEFAULTS, size: tuple = ENDLESS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The best candidates of each image with their readings and scores: image, seq, candidate (its place by detector score), box (with
    margins), raw_box, what the candidates hold, detector, evidence, text, confidence, recognition, characters, success, variant,
    layout, pattern, repaired, scores, before (the score before adjustments), final_score (after the adjustments between overlapping
    candidates) and reason.

    candidates: image, seq, box, score, and what else the detector knows of them, framing and left_margin or frame_mask and
    frame_profile among it; attempts and hints as in `attempts.gathered`, keyed by image and seq (hints None: none are known). A candidate without attempts has no
    text. size: width and height of the images, numbers or columns of the candidates. keep: columns of the candidates that are read
    later, besides those that the scores need; all, if not given.

    All that belongs to an image is dealt by it once and stays there: the three tables come together in one grouping without a join,
    and a candidate's record goes whole through repair and adjustment."""
    full = rerank.normalised(candidates)
    kept = [c for c in full.columns if c not in ("image", "seq") and (keep is None or c in (*keep, *SCORED))]
    own = full.select("image", "seq", "score", F.struct(*kept, padded(F.col("box"), size, settings).alias("_padded")).alias("_c"))
    # The best are chosen before their attempts lie beside them, while rows are small.
    best = detect.top_k(own, settings["reranking"]["evaluate"]).select("image", "seq", F.struct("rank", "_c").alias("_c"))
    whole = tries.gathered(attempts, hints, "image", "seq", candidates=best, settings=settings).withColumns({"candidate": F.col("_c.rank"), "_c": F.col("_c._c")})
    read = tries.finished(tries.read(whole, settings), ("image", "seq"), settings, "_c", "candidate")
    taken = {"box", "layout"} | set(read.columns)
    rest = [k for k in own.schema["_c"].dataType.names if k not in taken and k != "_padded"]
    ready = read.select("image", "seq", "candidate", F.col("_c._padded").alias("box"), F.col("_c.box").alias("raw_box"), *(F.col(f"_c.{k}").alias(k) for k in rest), F.col("_c.score").alias("detector"), "text", "confidence", "recognition", "characters", "success", "variant", "pattern", "repaired", rerank.layout_of(F.col("layout"), F.lit(None).cast("string"), F.col("_c.layout"), F.col("_c.profile")).alias("layout"))
    scored = rerank.with_final_score(ready.withColumn("evidence", rerank.evidence(ready)), settings)
    # Of equal scores the better candidate by its detector comes first.
    placed = scored.withColumns({"before": F.col("final_score"), "_seq": F.col("seq"), "seq": F.col("candidate")})
    return rerank.adjusted(placed, settings, "final_score", clean=True).withColumn("seq", F.col("_seq")).drop("_seq")


def results(images: DataFrame, candidates: DataFrame, attempts: DataFrame, hints: DataFrame | None, settings: dict = DEFAULTS, size: tuple = ENDLESS) -> DataFrame:
    """imagePath, status, plateText, stateName, confidence, profile, layout, variant, box (as detected), score (the detector's), way,
    messages, many (how many candidates were evaluated) and evaluated (all of them, best first; made only if it is read) of each image: its candidate of the greatest final score, of equals
    the one of greater score before adjustments, then of greater detector score. One image's error does not touch the others."""
    x = evaluated(candidates, attempts, hints, settings, size, ("branch", "scale"))
    record = F.struct("candidate", "seq", "box", "raw_box", "branch", "profile", "layout", "scale", "detector", "evidence", "text", "pattern", "characters", "recognition", "confidence", "success", "variant", "scores", "before", "final_score", "reason")
    order = (-F.col("final_score")).alias("a"), (-F.col("before")).alias("b"), F.col("candidate")
    first = F.min(F.struct(*order, "text", F.col("final_score").alias("score"), "success", "profile", "layout", "variant", F.col("raw_box").alias("box"), F.col("detector").alias("_detector")))
    every = F.array_sort(F.collect_list(F.struct(*order, record.alias("r"))))
    best = x.groupBy("image").agg(first.alias("x"), F.count("*").cast("int").alias("many"), F.transform(every, lambda e: e["r"]).alias("evaluated"))
    chosen = best.select("image", "x.text", "x.score", "x.success", "x.profile", "x.layout", "x.variant", "x.box", "x._detector", F.lit(PATH).alias("way"), "x.candidate", "many", "evaluated")
    out = evaluate.results(images, chosen, "profile", "layout", "variant", "box", "_detector", "way", "candidate", "many", "evaluated", keep=("error",) if "error" in images.columns else ())
    selected = F.format_string("candidate %d was chosen by its text", F.col("candidate"))
    said = F.when(F.col("status") == evaluate.OK, F.array(F.lit(DONE), selected)).when(F.col("status") == evaluate.NO_TEXT, F.array(F.lit(NO_TEXT), selected)).when(F.col("status") == evaluate.NO_PLATE, F.array(F.lit(NO_PLATE)))
    error = F.array_compact(F.array(F.col("error") if "error" in out.columns else F.lit(None).cast("string")))
    return out.withColumns({"messages": F.coalesce(said, error), "score": F.coalesce("_detector", F.lit(0.0))}).drop("_detector", "candidate", "error")


def from_pictures(images: DataFrame, candidates: DataFrame, plates: DataFrame, hints: DataFrame, reader: ocr.Reader, settings: dict = DEFAULTS, size: tuple = ENDLESS) -> DataFrame:
    """results, with the attempts made by a user's reader. images: as `sources.images.read_pictures` gives them, with image; candidates:
    as `detect.detected` gives them; plates: image, seq, attempt, name, source, layout (see `plans.variants.plate_variants`) and
    content, the picture that is read. A picture that the reader fails on is an attempt without success."""
    return results(images, candidates, ocr.attempts_from(plates, reader), hints, settings, size)
