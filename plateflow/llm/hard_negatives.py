"""Operator 11: hard negatives of embeddings by a distributed radix selection.

Scores are whole numbers, so the k-th best score of a window is found digit by digit: every task counts the scores that it sees in
the window by their leading DIGIT bits (an integer histogram, cut behind the bucket in which the task's own k-th score lies, as
nothing below it can matter), the histograms are added up on the cluster, the bucket that holds the k-th score becomes the window,
and the next pass counts the next digit. Once the k-th score itself is known, a last pass gathers the rows from it on, and no other
ones. The same selection finds an anchor's positives (a window over all scores of its label) and the negatives of each pair of
anchor and positive (a window over part of the scores of the other labels).

A pass deals the rows out in groups of at most GROUP_BYTES; anchors come past each group in blocks of BLOCK anchors, so a task holds
one group and one block, whatever the size of the table. No pair of rows is ever a Spark row.

Rows without a vec_id, a label or a vector take no part, nor do those with a component that is null, NaN or infinite, nor those
whose squared length (of whole numbers) is over 2^60, as their scores would not fit a long. Vectors of unequal length are compared on
the components that both have. Rows that share a vec_id are rows of their own, but never one another's positive or negative; anchors
that are equal in all columns count once. Ties go to the smaller vec_id, then to the row read as such (equal in what is returned). A
vector without components scores 0 with all. Any other columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.llm.arrow import Batches, slices
from plateflow.llm.common import freed, table, written

#: Bits of a digit; bytes of a group of rows (as 32-bit numbers); anchors of a block; rows that are scored at once.
DIGIT, GROUP_BYTES, BLOCK, ROWS = 10, 32_000_000, 256, 4096
#: A row's squared length at most, so that every score fits a long.
LONGEST = 1 << 60
#: Integers below these are exact in a product of floats, and of doubles.
EXACT32, EXACT64 = 1 << 24, 1 << 53

COUNTED = "anchor long, positive int, bucket int, n long"
GATHERED = "anchor long, positive int, id long, score long"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (as the damage leaves it), v (components as whole numbers), size (squared length) of the rows that take part."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("e"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = x.select("vec_id", label.alias("label"), F.transform("e", lambda c: 256 * c).alias("e"))
    size = F.aggregate("e", F.lit(0.0), lambda a, c: a + F.floor(c).cast("double") * F.floor(c).cast("double"))
    kept = scaled.withColumn("size", size).where(F.col("size") <= float(LONGEST))
    return kept.select("vec_id", "label", F.transform("e", lambda c: F.floor(c).cast("long")).alias("v"), "size")


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """A list array as rows of one width: short ones are filled with 0, as components that only one of two has don't count."""
    offsets, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    out = np.zeros((len(n), width), np.int64)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], n)
    out[np.repeat(np.arange(len(n)), n), at] = values[offsets[0] : offsets[-1]]
    return out


def _scores(a: np.ndarray, b: np.ndarray, a_size: float, b_size: float) -> np.ndarray:
    """Exact inner products as longs. By Cauchy and Schwarz no partial sum is over the product of both lengths."""
    width = min(a.shape[1], b.shape[1])
    a, b, most = a[:, :width], b[:, :width], math.sqrt(a_size) * math.sqrt(b_size) * (1 + 1e-9)
    if most < EXACT32:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < EXACT64:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _shift(low: int, high: int) -> int:
    """Bits to the right of the first digit of the numbers from low to high."""
    return max(0, (high - low).bit_length() - DIGIT)


class _Group:
    """The rows of one group, in the order in which they came."""

    def __init__(self) -> None:
        self.ids, self.labels, self.parts, self.size = [], [], [], 0.0

    def add(self, b: pa.RecordBatch) -> None:
        self.ids.append(b.column("id").to_numpy())
        self.labels.append(b.column("label").to_numpy())
        v = b.column("v")
        width = int(np.diff(v.offsets.to_numpy()).max(initial=0))
        m = _matrix(v, width)
        self.parts.append(m.astype(np.int32) if np.abs(m).max(initial=0) < 1 << 31 else m)
        self.size = max(self.size, float(b.column("size").to_numpy().max(initial=0)))

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for ids, labels, m in zip(self.ids, self.labels, self.parts, strict=True):
            for i in range(0, len(ids), ROWS):
                yield ids[i : i + ROWS], labels[i : i + ROWS], m[i : i + ROWS].astype(np.int64)


class _Block:
    """A block of anchors with their windows: of the i-th window the anchor, its positive, k, low and high."""

    def __init__(self, b: dict, same: bool) -> None:
        f = lambda k, kind=np.int64: np.frombuffer(b[k], kind)
        self.same, self.size, self.keys, self.ids, self.labels = same, b["size"], f("keys"), f("ids"), f("labels")
        self.m = f("v").reshape(len(self.ids), -1)
        self.of, self.positive, self.k, self.low, self.high = f("of", np.int32), f("positive", np.int32), f("k", np.int32), f("low"), f("high")

    def seen(self, group: _Group, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """window, id and score of the group's rows within the windows, chunk by chunk. least: of each window, the score from which
        a row still matters; the caller raises it."""
        for ids, labels, m in group.chunks():
            s = _scores(self.m, m, self.size, group.size)
            alike = self.labels[:, None] == labels[None, :]
            able = (alike if self.same else ~alike) & (self.ids[:, None] != ids[None, :])
            floor = np.full(len(self.ids), np.iinfo(np.int64).max)
            np.minimum.at(floor, self.of, least)
            a, r = np.nonzero(able & (s >= floor[:, None]))
            hit = s[a, r]
            # Each anchor's windows stand together: its hits are compared with each of them.
            first, n = np.searchsorted(self.of, np.arange(len(self.ids))), np.bincount(self.of, minlength=len(self.ids))
            rep = n[a]
            w = np.repeat(first[a], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
            x, j = np.repeat(hit, rep), np.repeat(r, rep)
            fit = (x >= least[w]) & (x <= self.high[w])
            yield w[fit], ids[j[fit]], x[fit]

    def counted(self, group: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """window, bucket and count of the histograms of a digit, down to the bucket with the group's own k-th row of the window."""
        shift = np.array([_shift(int(a), int(b)) for a, b in zip(self.low, self.high, strict=True)], np.int64)
        counts, least = np.zeros((len(self.of), 1 << DIGIT), np.int64), self.low.copy()
        for w, _, x in self.seen(group, least):
            np.add.at(counts, (w, (x - self.low[w]) >> shift[w]), 1)
            least[:] = self.low + (self._last(counts) << shift)
        kept = counts * (np.arange(1 << DIGIT) >= self._last(counts)[:, None])
        w, b = np.nonzero(kept)
        return w, b, kept[w, b]

    def _last(self, counts: np.ndarray) -> np.ndarray:
        """Of each window the bucket with its k-th row from above; the first bucket if there are fewer."""
        above = np.cumsum(counts[:, ::-1], axis=1)
        enough = above >= self.k[:, None]
        return np.where(enough.any(1), (1 << DIGIT) - 1 - enough.argmax(1), 0)

    def gathered(self, group: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """window, id and score of the group's rows from each window's least score on, the k best of each window."""
        best = [np.zeros(0, np.int64)] * 3
        for new in self.seen(group, self.low):
            w, i, x = (np.concatenate(p) for p in zip(best, new, strict=True))
            order = np.lexsort((i, -x, w))
            w, i, x = w[order], i[order], x[order]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            keep = place < self.k[w]
            best = [w[keep], i[keep], x[keep]]
        return tuple(best)


BLOCKED = pa.schema([("size", pa.float64()), *((k, pa.binary()) for k in ("keys", "ids", "labels", "v", "of", "positive", "k", "low", "high"))])
BLOCKED_SQL = "size double, keys binary, ids binary, labels binary, v binary, of binary, positive binary, k binary, low binary, high binary"


def _blocks(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Anchors with their windows (an array of struct) as packed blocks."""
    for b in slices(batches, BLOCK):
        ws = b.column("ws")
        n = np.diff(ws.offsets.to_numpy())
        if not b.num_rows or not n.sum():
            continue
        lists = b.column("v")
        m = _matrix(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
        flat = ws.flatten()
        field = lambda k, kind: flat.field(k).to_numpy(zero_copy_only=False).astype(kind).tobytes()  # noqa: E731, B023
        row = {"size": float(b.column("size").to_numpy().max()), "keys": b.column("anchor").to_numpy().tobytes(), "ids": b.column("vec_id").to_numpy().tobytes(), "labels": b.column("label").to_numpy().tobytes(), "v": m.tobytes(), "of": np.repeat(np.arange(len(n)), n).astype(np.int32).tobytes()}
        row |= {"positive": field("positive", np.int32), "k": field("k", np.int32), "low": field("low", np.int64), "high": field("high", np.int64)}
        yield pa.RecordBatch.from_pylist([row], schema=BLOCKED)


def _pass(rows: DataFrame, groups: int, windows: DataFrame, same: bool, gather: bool) -> DataFrame:
    """Each group of rows meets each block of windows in the group's task. rows: g, id, label, v, size; windows: anchor, vec_id, label,
    v, size, ws."""
    blocks = windows.select("anchor", "vec_id", "label", "v", "size", "ws").mapInArrow(_blocks, BLOCKED_SQL)
    packed = blocks.select(F.struct(*BLOCKED.names).alias("b"))
    none = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("double").alias("size"), "b")
    own = rows.select("g", F.lit(0).alias("kind"), "id", "label", "v", "size", F.lit(None).cast(packed.schema["b"].dataType).alias("b"))
    dealt = own.unionByName(none).repartition(groups, "g").sortWithinPartitions("g", "kind")
    names = GATHERED if gather else COUNTED
    out_schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), *([("id", pa.int64()), ("score", pa.int64())] if gather else [("bucket", pa.int32()), ("n", pa.int64())])])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        now, group = None, _Group()
        for b in slices(batches, ROWS):
            for g in np.unique(b.column("g").to_numpy()):
                mine = b.filter(pa.array(b.column("g").to_numpy() == g))
                if g != now:
                    now, group = g, _Group()
                kinds = mine.column("kind").to_numpy()
                if (kinds == 0).any():
                    group.add(mine.filter(pa.array(kinds == 0)))
                for packed in mine.filter(pa.array(kinds == 1)).column("b"):
                    block = _Block(packed.as_py(), same)
                    w, x, y = block.gathered(group) if gather else block.counted(group)
                    keys = block.keys[block.of[w]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(block.positive[w], pa.int32()), pa.array(x, out_schema[2].type), pa.array(y, pa.int64())], schema=out_schema)

    return dealt.mapInArrow(run, names)


def _narrowed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """anchor, positive, k, low, high after a digit: the bucket with the k-th row (all from low on, if there are fewer)."""
    width = F.greatest(F.length(F.bin(F.col("high") - F.col("low"))) - DIGIT, F.lit(0)).cast("int")
    summed = counts.groupBy("anchor", "positive", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("anchor", "positive").agg(F.array_sort(F.collect_list(F.struct((-F.col("bucket")).alias("order"), "n"))).alias("h"))
    # A histogram has at most 2^DIGIT buckets.
    walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("b")), lambda a, x: F.when(a["n"] >= F.col("k"), a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), (-x["order"]).alias("b"))))
    both = windows.join(found, ["anchor", "positive"], "left").withColumn("s", width).withColumn("x", walk)
    at = F.expr("low + shiftleft(CAST(x.b AS BIGINT), s)")
    enough = F.coalesce(F.col("x.n") >= F.col("k"), F.lit(False))
    above = F.coalesce(F.col("x.n"), F.lit(0)) - F.coalesce(F.get(F.filter("h", lambda e: -e["order"] == F.col("x.b")), F.lit(0))["n"], F.lit(0))
    low = F.when(enough, at).otherwise(F.col("low"))
    high = F.when(enough, F.least(F.col("high"), F.expr("low + shiftleft(CAST(x.b AS BIGINT) + 1, s) - 1"))).otherwise(F.col("low"))
    return both.select("anchor", "positive", F.when(enough, F.col("k") - above).otherwise(F.col("k")).cast("int").alias("k"), low.alias("low"), high.alias("high"))


def _with_anchors(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    ws = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "k", "low", "high"))).alias("ws"))
    return anchors.join(ws, "anchor")


def radix_selected(rows: DataFrame, groups: int, anchors: DataFrame, windows: DataFrame, same: bool) -> DataFrame:
    """anchor, positive, id, score, rank: of each window the k best rows of the anchor's label (same) or of another one, with a score
    from low to high. windows: anchor, positive (its number among the anchor's), k, low, high."""
    whole = now = windows.select("anchor", "positive", "k", "low", "high")
    done: list[DataFrame] = []
    while not (open_ := now.where("low < high")).isEmpty():
        counts = written(_pass(rows, groups, _with_anchors(anchors, open_), same, False), "histograms")
        done += [now, counts]
        now = written(now.where("low >= high").unionByName(_narrowed(open_, counts)), "windows")
    thresholds = now.select("anchor", "positive", F.col("low").alias("least"))
    last = whole.join(thresholds, ["anchor", "positive"]).select("anchor", "positive", "k", F.col("least").alias("low"), "high").where("low <= high")
    found = _pass(rows, groups, _with_anchors(anchors, last), same, True)
    by = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    ranked = found.join(whole.select("anchor", "positive", "k"), ["anchor", "positive"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= F.col("k"))
    out = written(ranked.select("anchor", "positive", "id", "score", "rank"), "selected")
    freed(*done[1:], *([now] if done else []))
    return out


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: rows whose vec_id is divisible by every."""
    spark = embeddings.sparkSession
    clean = whole_vectors(embeddings)
    n, width = clean.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    groups = max(1, math.ceil(n * (width or 1) * 4 / GROUP_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(n / 1024)))
    # Hot vectors and ids are dealt evenly: a group is a row's own place in the table as read, fixed once it is written.
    rows = written(clean.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("g"), F.col("vec_id").alias("id"), "label", "v", "size"), "vectors")
    one = rows.where(F.col("id") % every == 0).select(F.col("id").alias("vec_id"), "label", "v", "size").distinct()
    anchors = written(one.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    # |score| is at most the product of both lengths.
    most = rows.agg(F.sqrt(F.max("size"))).first()[0]
    bound = F.ceil(F.sqrt("size") * most * (1 + 1e-9)).cast("long") + 1
    all_scores = anchors.select("anchor", F.lit(0).alias("positive"), F.lit(positives).alias("k"), (-bound).alias("low"), bound.alias("high"))
    near = radix_selected(rows, groups, anchors, all_scores, True)
    # 80 p <= 100 n <= 100 p: from .8 p, rounded up, to p; no n for a p below 0.
    windows = near.where("score >= 0").select("anchor", F.col("rank").alias("positive"), F.lit(negatives).alias("k"), F.expr("(4 * score + 4) div 5").alias("low"), F.col("score").alias("high"))
    far = radix_selected(rows, groups, anchors, windows, False)
    named = near.select("anchor", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = far.select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor", "positive"])
    return both.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, label, v, row_number() OVER (ORDER BY vec_id, label, v) AS k FROM (SELECT DISTINCT * FROM e WHERE vec_id % 100 = 0)),
s AS (SELECT a.k, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
        coalesce(list_sum(list_transform(range(1, 1 + least(len(a.v), len(b.v))), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score FROM a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT k, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS r FROM s WHERE alike) WHERE r <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.k, p.r ORDER BY s.score DESC, s.id) AS rank
        FROM p JOIN s ON p.k = s.k AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
