"""Operator 13: quality scores from random-indexing word vectors and a small network with calibrated probabilities.

Words (by a hash into BUCKETS rows of a table) have an index vector, sparse and drawn from the hash alone, and a context vector: the
sum of the index vectors of the words up to WINDOW places away, over all documents. A document's words are pooled: the mean and the
spread of their vectors, how alike neighbours are, and the mean index vector of their shapes (letters and digits collapsed, so ``A!!``
for ``DAS!!``), over the whole text and over its most unusual part of PART words. A network of two layers, in numpy, turns that into a
logit, and a temperature fitted on rows that it has not learned from into a probability.

The context table covers all documents: each task adds up its own, and the sums meet slice by slice. The network is fitted on at most
about FIT_ROWS labelled documents (chosen by a hash of doc_id); everything else scales with the tasks. Both are of fixed size, so they
go to the tasks whole.

Nulls count as empty texts; a text without words is pooled to zeros and gets a score like any other. Texts of any length are pooled
whole, in pieces of bounded size. Repeated rows are scored each for itself; a doc_id with several rows gives one of them to the fit. A
doc_id whose labels disagree is not learned from, nor is one whose label is neither 0 nor 1. A null doc_id counts as empty text in the
fold. Without labels of both kinds the score is the share of 1 (.5 without any). An empty table gives an empty result; other columns
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import Batches, as_bytes, slices
from plateflow.llm.common import documents, fold, mix64, table

#: Rows of the context table, of that of shapes, numbers of a vector, of them not 0 in an index vector, places to each side that are context.
BUCKETS, SHAPES, WIDTH, SPARSE, WINDOW = 1 << 14, 1 << 12, 16, 3, 2
#: Words of a part of a text; bytes that are pooled at once.
PART, PIECE = 64, 1 << 20
#: Labelled rows that the network is fitted on, at most about.
FIT_ROWS = 20_000
#: Score from which 1 is predicted.
THRESHOLD = 0.7
HIDDEN, EPOCHS, STEP, DECAY, SEED = 24, 60, 3e-3, 1e-4, 13
#: Rows of the context table that are added up together.
SLICE = 256

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: A byte's kind in a word's shape: upper, lower, digit, or itself; 0 for bytes of other letters, which take the kind before them.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = ord("A"), ord("a"), ord("0"), 0
_MIXED, _PLACES = mix64(np.arange(1, 257, dtype=np.uint64)), mix64(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)


def _hashes(values: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """A hash of each word's values in order; 0 for a word of none. word: ascending, of each value."""
    first = np.searchsorted(word, np.arange(n + 1))
    with np.errstate(over="ignore"):
        each = _MIXED[values] * _PLACES[(np.arange(len(word)) - first[word]) % len(_PLACES)]
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(each, out=sums[1:])
        return mix64(sums[first[1:]] - sums[first[:-1]])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of UTF-8 bytes its first place, the hash of its letters and digits (A-Z lower-cased; 0 for none), and of its
    shape."""
    there = ~_BLANK[data]
    start = there.copy()
    start[1:] &= ~there[:-1]
    firsts = np.flatnonzero(start)
    word = np.cumsum(start, dtype=np.int32) - 1
    core = np.flatnonzero(there & _WORD[data])
    letters = _hashes(_LOWER[data[core]], word[core], len(firsts))
    kind = _KIND[data]
    shown = np.flatnonzero(there & (kind > 0))
    k, w = kind[shown], word[shown]
    turn = np.ones(len(k), bool)
    turn[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    return firsts, letters, _hashes(k[turn], w[turn], len(firsts))


def index_vectors(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the numbers of each key's index vector that are not 0."""
    h = mix64(keys.astype(np.uint64) + np.uint64(0xA5A5))
    at = np.stack([(h >> np.uint64(8 * j)) % np.uint64(WIDTH) for j in range(SPARSE)], 1).astype(np.intp)
    sign = np.stack([1.0 - 2.0 * ((h >> np.uint64(40 + j)) & np.uint64(1)).astype(np.float32) for j in range(SPARSE)], 1)
    return at, sign


def dense_index(keys: np.ndarray) -> np.ndarray:
    at, sign = index_vectors(keys)
    out = np.zeros((len(keys), WIDTH), np.float32)
    np.add.at(out, (np.arange(len(keys))[:, None], at), sign)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def chunks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as chunks of at most about PIECE bytes: the bytes, where a text begins in them, and which one it is. Long texts go in
    pieces that end between words (a word over PIECE bytes is cut)."""
    now, size = [], 0
    for k, text in enumerate(texts):
        data, at = np.frombuffer(text or b"", np.uint8), 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):
                blank = np.flatnonzero(_BLANK[data[at:end]])
                end = at + int(blank[-1]) + 1 if len(blank) else end
            now.append((k, data[at:end]))
            size, at = size + end - at + 1, end
            if size >= PIECE:
                yield _joined(now)
                now, size = [], 0
    if now:
        yield _joined(now)


def _joined(parts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = np.full(1, 0x20, np.uint8)
    sizes = [len(x) + 1 for _, x in parts]
    return np.concatenate([y for _, x in parts for y in (x, blank)]), np.cumsum([0, *sizes[:-1]]), np.array([k for k, _ in parts])


def contexts(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The context vectors of a task's texts, as slices of the table."""
    total, plain = np.zeros((BUCKETS, WIDTH)), dense_index(np.arange(BUCKETS))
    for b in slices(batches):
        for data, begins, _ in chunks(b.column("text").to_pylist()):
            firsts, letters, _ = words_of(data)
            real = np.flatnonzero(letters)
            ids, of = (letters[real] % np.uint64(BUCKETS)).astype(np.intp), np.searchsorted(begins, firsts[real], side="right")
            v, near = plain[ids], np.zeros((len(ids), WIDTH), np.float32)
            for d in range(1, min(WINDOW, len(ids) - 1) + 1):
                same = (of[d:] == of[:-d])[:, None]
                near[d:] += v[:-d] * same
                near[:-d] += v[d:] * same
            order = np.argsort(ids.astype(np.int16), kind="stable")
            own = ids[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            if len(own):
                total[own[first]] += np.add.reduceat(near[order], first, axis=0)
    if total.any():
        for i in range(0, BUCKETS, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([total[i : i + SLICE].astype("<f4").tobytes()], pa.binary())], names=["slice", "sums"])


def _added(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that a task is dealt, one by one."""
    total: dict[int, np.ndarray] = {}
    for b in slices(batches):
        for i, x in zip(b.column("slice").to_pylist(), b.column("sums").to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(x, "<f4").astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total.values()], pa.binary())], names=["slice", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vector of each bucket: its context vector and its index vector, each of length 1 (a bucket without context has none)."""
    sums = as_bytes(docs).select("text").mapInArrow(contexts, "slice int, sums binary")
    found = sums.repartition(BUCKETS // SLICE, "slice").mapInArrow(_added, "slice int, sums binary").collect()
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in found:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["sums"], "<f4").reshape(-1, WIDTH)
    # What all words have in common tells nothing of one.
    out -= out.sum(0) / max(1, (np.abs(out).sum(1) > 0).sum()) * (np.abs(out).sum(1, keepdims=True) > 0)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)
    return np.concatenate([out, dense_index(np.arange(BUCKETS))], 1)


#: Numbers of a pooled text: mean and spread of its words, mean of its shapes, likeness of neighbours, the last two of its oddest
#: part, and its length.
POOLED = 6 * WIDTH + 5


class Pool:
    """Pools texts; holds the word vectors and the index vectors of shapes."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.shapes = vectors.astype(np.float32), dense_index(np.arange(SHAPES) + BUCKETS)
        self.bare = np.isin(np.arange(SHAPES), PLAIN % np.uint64(SHAPES)).astype(np.float32)

    def parts(self, data: np.ndarray, begins: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each part of PART words its text, its number of words with letters and of all, and sums over them: words, their
        squares, shapes, likeness to the word before and to the one before that, plain shapes."""
        firsts, letters, shapes = words_of(data)
        text = np.searchsorted(begins, firsts, side="right") - 1
        place = np.arange(len(firsts)) - np.searchsorted(text, text)
        cut = np.flatnonzero(place % PART == 0)
        at = np.flatnonzero(letters)
        v, s = np.zeros((len(firsts), 2 * WIDTH), np.float32), self.shapes[(k := (shapes % np.uint64(SHAPES)).astype(np.intp))]
        v[at] = self.vectors[(letters[at] % np.uint64(BUCKETS)).astype(np.intp)]
        own, t = v[at], text[at]
        near = np.zeros((len(firsts), 2), np.float32)
        for d in (1, 2):
            if len(at) > d:
                near[at[d:], d - 1] = np.einsum("ij,ij->i", own[d:], own[:-d]) / 2 * (t[d:] == t[:-d])
        sums = [np.add.reduceat(x, cut, axis=0) for x in (v, v * v, s, near, self.bare[k][:, None])]
        n = np.stack([np.add.reduceat((letters > 0).astype(np.int64), cut), np.diff(np.append(cut, len(firsts)))], 1)
        return of[text[cut]], n, np.concatenate(sums, 1)

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        n, total = np.zeros((len(texts), 2)), np.zeros((len(texts), 5 * WIDTH + 3))
        odd, oddest = np.full(len(texts), -1.0), np.zeros((len(texts), WIDTH + 2))
        for data, begins, of in chunks(texts):
            if not (~_BLANK[data]).any():
                continue
            text, count, sums = self.parts(data, begins, of)
            np.add.at(n, text, count)
            np.add.at(total, text, sums)
            # The oddest part: words repeat, or shapes are far from those of plain words.
            mean = sums[:, 4 * WIDTH :] / count[:, 1:]
            how = (mean[:, WIDTH : WIDTH + 2].sum(1) + 1 - mean[:, -1]) * np.minimum(1, count[:, 1] / PART)
            order = np.lexsort((np.arange(len(how)), -how, text))
            first = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
            new = first[how[first] > odd[text[first]]]
            odd[text[new]], oddest[text[new]] = how[new], mean[new, :-1]
        words, every = np.maximum(1, n[:, :1]), np.maximum(1, n[:, 1:])
        mean = total[:, : 2 * WIDTH] / words
        spread = np.sqrt(np.maximum(0, total[:, 2 * WIDTH : 4 * WIDTH] / words - mean * mean))
        return np.concatenate([mean, spread, total[:, 4 * WIDTH : -1] / every, oddest, np.log1p(n[:, 1:])], 1).astype(np.float32)


#: Shapes of words as plain prose has them.
PLAIN = np.concatenate([words_of(np.frombuffer(x, np.uint8))[2] for x in (b"a", b"Aa", b"a,", b"a.", b"Aa,", b"Aa.", b"A", b"A.", b"A,")])


class Network:
    """A hidden layer of ReLUs and a logistic output, fitted with Adam; a temperature divides its logits."""

    def __init__(self) -> None:
        self.share, self.temperature, self.w = 0.5, 1.0, None

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.w
        h = np.maximum(0, x @ a + b)
        return h, h @ c + d

    def fit(self, x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
        """check: rows that only the temperature is fitted on."""
        if not len(y) or y.min() == y.max():
            self.share = float(y.mean()) if len(y) else 0.5
            return self
        own = ~check if 0 < check.sum() < len(y) and y[~check].min() != y[~check].max() else np.ones(len(y), bool)
        self.mean, self.sd = x[own].mean(0), x[own].std(0) + 1e-3
        z, r = np.clip((x - self.mean) / self.sd, -8, 8), np.random.default_rng(SEED)
        n = x.shape[1]
        self.w = [r.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
        m, s, at, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], np.flatnonzero(own), 0
        for _ in range(EPOCHS):
            for rows in np.array_split(r.permutation(at), max(1, len(at) // 128)):
                h, logit = self._forward(z[rows])
                off = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
                back = np.outer(off, self.w[2]) * (h > 0)
                grads, t = [z[rows].T @ back, back.sum(0), h.T @ off, off.sum()], t + 1
                for k, g in enumerate(grads):
                    g = g + DECAY * self.w[k]
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        logit, target = self._forward(z[~own] if (~own).any() else z)[1], y[~own] if (~own).any() else y
        self.temperature = float(min(np.geomspace(0.25, 8, 200), key=lambda c: np.mean(np.logaddexp(0, logit / c) - target * logit / c)))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._forward(np.clip((x - self.mean) / self.sd, -8, 8))[1] / self.temperature, -30, 30)))


def _pooled(vectors: np.ndarray):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        pool = Pool(vectors)
        for b in slices(batches):
            x = [row.tobytes() for row in pool(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("part"), pa.array(x, pa.binary())], names=["doc_id", "label", "part", "x"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, column: str = "quality", folds: int = 4, held: int = 2, rows: int = FIT_ROWS) -> Network:
    """The network that learns labels.column from documents outside the held fold; a fifth of them only for the temperature."""
    own = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("_high")).where("label = _high").select("doc_id", "label")
    total = own.count()
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, rows / max(1, total)) * (1 << 30)))
    # At most about FIT_ROWS rows of two numbers go to all tasks, and as many texts, one a doc_id, are pooled.
    texts = as_bytes(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int").alias("part")
    found = texts.select("doc_id", F.col("label").cast("int").alias("label"), part, "text").mapInArrow(_pooled(vectors), "doc_id long, label int, part int, x binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, POOLED), np.float32)
    return Network().fit(x, np.array([r["label"] for r in found], float), np.array([r["part"] == 0 for r in found], bool))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        pool = Pool(vectors)
        for b in slices(batches):
            if b.num_rows:
                s = network(pool(b.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    x = docs.withColumn("held_out", fold("doc_id", folds) == held)
    return as_bytes(x, "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = word_vectors(docs)
    return scored(docs, vectors, fitted(docs, table(spark, sf_dir, "labels"), vectors))
