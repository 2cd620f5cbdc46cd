"""Labelled evaluation: annotations of images, the result of each image, and recognised against expected texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.functions.text import identify_state, norm

OK, NO_PLATE, NO_TEXT, ERROR = "ok", "plate_not_found", "ocr_failed", "error"


def first_annotation(images: DataFrame, annotations: DataFrame, key: str, order: str) -> DataFrame:
    """images left-joined with the first annotation of each key (by order): one aggregation in place of a sort."""
    rest = [c for c in annotations.columns if c != key]
    first = annotations.groupBy(key).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("_a"))
    return images.join(first, key, "left").select(*images.columns, *(F.col(f"_a.{c}").alias(c) for c in rest)).drop("_a")


def matched(results: DataFrame, expected: str, recognised: str) -> DataFrame:
    """Adds matched: whether both texts are equal once normalised, and not empty."""
    return results.withColumn("matched", (norm(F.col(expected)) == norm(F.col(recognised))) & (norm(F.col(expected)) != ""))


def results(images: DataFrame, selected: DataFrame, *more: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """imagePath, status, plateText, stateName, confidence and more columns of selected (and those of images to keep) of every image, one without a candidate too. images: image, path and, if
    reading it failed, error; selected: image, text, score and success of its best candidate. An image's error is its own row's
    status; the others go on."""
    s = selected.select("image", F.col("text").alias("_t"), F.col("score").alias("_s"), F.col("success").alias("_ok"), *more)
    x = images.join(s, "image", "left")
    failed = F.col("error").isNotNull() if "error" in images.columns else F.lit(False)
    found = F.col("_t").isNotNull() & ~failed
    text = F.when(found, F.col("_t")).otherwise("")
    status = F.when(failed, ERROR).when(~found, NO_PLATE).when((text != "") & F.coalesce("_ok", F.lit(True)), OK).otherwise(NO_TEXT)
    return x.select(F.col("path").alias("imagePath"), status.alias("status"), text.alias("plateText"), identify_state(text)["name"].alias("stateName"), F.when(found, F.col("_s")).otherwise(0.0).alias("confidence"), *(F.when(found, F.col(k)).alias(k) for k in more), *keep)


def evaluation(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """ImagePath, ExpectedText, RecognizedText, Status, DetectedProfile, DetectedLayout, SelectedVariant, Confidence, Matched of each
    row of the manifest. found: imagePath, status, plateText, confidence, profile, layout, variant of the images."""
    x = manifest.join(found, manifest["image_path"] == found["imagePath"], "left")
    expected, text = norm(F.col("expected_text")), norm(F.col("plateText"))
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    return x.select(F.col("image_path").alias("ImagePath"), expected.alias("ExpectedText"), text.alias("RecognizedText"), F.coalesce("status", F.lit(NO_PLATE)).alias("Status"), known("profile").alias("DetectedProfile"), known("layout").alias("DetectedLayout"), known("variant").alias("SelectedVariant"), F.coalesce("confidence", F.lit(0.0)).alias("Confidence"), (expected == text).alias("Matched"))
