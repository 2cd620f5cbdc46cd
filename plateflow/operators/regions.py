"""Regions of masks: runs of pixels in rows that touch are one component; its measures are aggregates over its runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.functions import geometry
from plateflow.functions.arrays import runs
from plateflow.settings import DEFAULTS


def mask_runs(masks: DataFrame, key: str, mask: str = "mask") -> DataFrame:
    """key, y, first, last (from 1): the runs of each row of each mask (an array of rows of flags). A narrow expansion."""
    rows = masks.select(key, F.posexplode(mask).alias("y", "_r"))
    return rows.select(key, (F.col("y") + 1).alias("y"), F.explode(runs(F.col("_r"))).alias("r")).select(key, "y", "r.first", "r.last")


def labels_of(y: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The component of each run of a mask, numbered from 1 by its first run; runs in order of y, then of first. Runs of neighbouring
    rows belong together where they touch, at corners too."""
    up = list(range(len(y)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    begins = np.searchsorted(y, y - 1), np.searchsorted(y, y)
    for i in range(len(y)):
        # Of the row above, the runs from the first that does not end before this one begins.
        j = int(begins[0][i] + np.searchsorted(last[begins[0][i] : begins[1][i]], first[i] - 1))
        while j < begins[1][i] and first[j] <= last[i] + 1:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
            j += 1
    return np.unique([root(i) for i in range(len(y))], return_inverse=True)[1] + 1 if len(y) else np.zeros(0, int)


def labelled(found: DataFrame, key: str) -> DataFrame:
    """key, y, first, last, region of runs. A mask's runs (fewer than its pixels) meet in one task, in one shuffle; components have
    no bound on their length, so that built-in functions would need a pass for each step of the longest."""
    names = (key, "y", "first", "last")

    def one(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(group).sort_by([("y", "ascending"), ("first", "ascending")]).combine_chunks()
        y, first, last = (t.column(k).to_numpy() for k in names[1:])
        yield from t.select(names).append_column("region", pa.array(labels_of(y, first, last), pa.int32())).to_batches()

    kind = found.schema[key].dataType.simpleString()
    dealt = found.select(key, F.col("y").cast("int"), F.col("first").cast("int"), F.col("last").cast("int"))
    return dealt.groupBy(key).applyInArrow(lambda t: pa.Table.from_batches(list(one(t.to_batches())), schema=pa.schema([*(t.schema.field(k) for k in names), pa.field("region", pa.int32())])), f"`{key}` {kind}, y int, first int, last int, region int")


def regions(found: DataFrame, key: str) -> DataFrame:
    """key, region, area, box (edges at half pixels), extent of each component of the runs of masks."""
    n = F.col("last") - F.col("first") + 1
    whole = labelled(found, key).groupBy(key, "region").agg(F.sum(n).alias("area"), F.min("first").alias("_x1"), F.max("last").alias("_x2"), F.min("y").alias("_y1"), F.max("y").alias("_y2"))
    w, h = F.col("_x2") - F.col("_x1") + 1, F.col("_y2") - F.col("_y1") + 1
    return whole.select(key, "region", "area", geometry.box(F.col("_x1") - F.lit(0.5), F.col("_y1") - F.lit(0.5), w, h).alias("box"), (F.col("area") / (w * h)).alias("extent"))


def candidate_boxes(found: DataFrame, size: tuple[int, int], settings: dict = DEFAULTS) -> DataFrame:
    """The regions that are large enough, with box in the image's own pixels and grown as their branch asks for. found: regions with
    branch and scale; size: width and height of the images."""
    d = settings["detection"]
    large = found.where(F.col("area") >= d["min_area_pixels"])
    own = geometry.to_original(F.col("box"), F.col("scale"), *size)
    return large.withColumn("box", own).where("box IS NOT NULL").withColumn("box", geometry.expand_for_branch(F.col("box"), F.col("branch"), d["expand"], *size))
