"""Operator 1: dedup of repeated byte strings with a distributed suffix sort.

A string of LENGTH bytes that occurs twice is found without sorting every suffix. Anchors are chosen by content: of all
GRAM-byte grams in a window of LENGTH bytes, the one of least hash, so equal windows have their anchor at the same place. Only
anchors whose gram occurs twice go on. Their suffixes, each with the bytes before it, are sorted:

1. each bucket of documents sorts its suffixes into a run and front-codes it: how much a suffix shares with the one before
   it, then its rest. Suffixes equal in all their context collapse first, so a thousand copies send one;
2. runs are cut by range and exchanged. The order begins with the gram's hash, so ranges are even without a sample;
3. each range merges its runs with a loser tree that keeps, for each loser, what it shares with its winner, and compares only
   behind that: known prefixes are never compared again;
4. in the merged order, common prefixes of neighbours say how far two suffixes agree to the right; with the bytes to the
   left this gives each anchor's longest repeated reach, and these spans make up exactly the bytes that are covered.

Texts are bytes (null: empty); matches never cross documents; texts under LENGTH bytes lose nothing. Rows equal in doc_id and
text are repeats of each other like any other rows. Texts of any length are handled in pieces of PIECE window starts. An empty
table gives an empty result.

Texts are dealt to buckets once and written as a bucketed table; all that goes on names a text by its bucket and its number there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import Batches, as_bytes, batch
from plateflow.llm.common import bucketed, buckets_for, documents, dropped_shuffles, mix64, row_key, text_bytes, written

LENGTH, GRAM = 200, 100
SIDE = LENGTH - GRAM
#: Window starts that are handled at once, text of a bucket, and merged suffixes that are judged at once (a gram's always together).
PIECE, BUCKET_MB, CHUNK = 1 << 20, 16, 50_000
_B = 0x100000001B3


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling."""
    power = lambda n: np.uint64(pow(_B, n, 1 << 64))
    with np.errstate(over="ignore"):
        h, width, out, done = mix64(data.astype(np.uint64) + np.uint64(1)), 1, None, 0
        n = len(data) - GRAM + 1
        while True:
            if GRAM & width:
                out = h[:n] if out is None else out * power(width) + h[done : done + n]
                done += width
            if width * 2 > GRAM:
                return mix64(out)
            h = h[:-width] * power(width) + h[width:]
            width *= 2


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that some window of LENGTH bytes has as its anchor."""
    places, hashes = [], []
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(text) - LENGTH + 1, PIECE):
        own = data[start : start + PIECE + LENGTH - 1]
        h = gram_hashes(own)
        x = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= SIDE + 1:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        rest = SIDE + 1 - width
        x = np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
        at = np.unique(x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        places.append(at + start)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _ordered(texts: pa.Table) -> list[bytes | None]:
    """A bucket's texts by number. Rows equal in doc_id and rk are equal in text, so their order doesn't matter."""
    return texts.sort_by([("doc_id", "ascending"), ("rk", "ascending")]).column("text").to_pylist()


ANCHORS = pa.schema([("h", pa.int64()), ("b", pa.int32()), ("i", pa.int32()), ("pos", pa.int32()), ("n", pa.int32())])


def _anchor_rows(texts: pa.Table) -> pa.Table:
    """h, b, i, pos, n. Grams that a bucket has twice are settled here: one row goes on under the gram's hash, with their
    number; the others under a hash of their own."""
    own_b = texts.column("b")[0].as_py()
    found = [anchors(t or b"") for t in _ordered(texts)]
    row = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
    pos, h = np.concatenate([p for p, _ in found]), np.concatenate([x for _, x in found])
    _, first, place, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    other = np.ones(len(h), bool)
    other[first] = False
    with np.errstate(over="ignore"):
        own = mix64(mix64((np.uint64(own_b) << np.uint64(32)) + row.astype(np.uint64)) + pos.astype(np.uint64))
    return pa.Table.from_batches([batch(ANCHORS, {"h": np.where(other, own, h).view(np.int64), "b": np.full(len(h), own_b, np.int32), "i": row.astype(np.int32), "pos": pos.astype(np.int32), "n": np.where(other, 2, count[place]).astype(np.int32)})])


def _repeated(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h, those whose hash has two grams or more."""
    held: pa.Table | None = None

    def kept(t: pa.Table) -> list[pa.RecordBatch]:
        h = t.column("h").to_numpy()
        starts = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        total = np.add.reduceat(t.column("n").to_numpy().astype(np.int64), starts)
        keep = np.repeat(total >= 2, np.diff(starts, append=len(h)))
        return t.filter(pa.array(keep)).select(["b", "i", "pos"]).combine_chunks().to_batches()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        h = t.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield from kept(t.slice(0, last))
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield from kept(held)


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width), size


def _shared(strings: list[bytes], width: int) -> np.ndarray:
    """What each string shares with the one before it, in bytes."""
    m, size = _matrix(strings, width)
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = np.concatenate([m[1:] != m[:-1], np.ones((len(m) - 1, 1), bool)], axis=1)
        out[1:] = np.minimum(np.minimum(differ.argmax(axis=1), size[1:]), size[:-1])
    return out


class Run:
    """A sorted run of suffixes: keys (hash and up to LENGTH bytes), the bytes before them reversed, and where they are."""

    @staticmethod
    def pack(keys: list[bytes], lefts: list[bytes], ids: np.ndarray) -> bytes:
        """ids: bucket, number in it, pos and whether the suffix is settled, by row."""
        sk, sl = _shared(keys, LENGTH + 8), _shared(lefts, SIDE)
        head = np.array([sk, [len(x) for x in keys], sl, [len(x) for x in lefts]], np.uint8)
        tails = [k[a:] + x[b:] for k, a, x, b in zip(keys, sk.tolist(), lefts, sl.tolist(), strict=True)]
        return zlib.compress(len(keys).to_bytes(4, "little") + head.tobytes() + ids.astype("<i4").tobytes() + b"".join(tails), 1)

    def __init__(self, block: bytes):
        raw = zlib.decompress(block)
        n = int.from_bytes(raw[:4], "little")
        self.shared, self.size, self.left_shared, self.left_size = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).tolist()
        self.ids = np.frombuffer(raw, "<i4", 4 * n, 4 + 4 * n).reshape(4, n)
        self.raw, self.at, self.n = raw, 4 + 20 * n, n

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, int]]:
        """Shared with the one before, key, bytes before it reversed, number in the run."""
        key = left = b""
        at, raw = self.at, self.raw
        for i in range(self.n):
            s, ls = self.shared[i], self.left_shared[i]
            mid = at + self.size[i] - s
            end = mid + self.left_size[i] - ls
            key, left, at = key[:s] + raw[at:mid], left[:ls] + raw[mid:end], end
            yield s, key, left, i


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """All runs in one order: what each suffix shares with the one put out before it, its key, the bytes before it, its run, its number."""
    width = 1 << max(len(runs) - 1, 0).bit_length()
    streams = [iter(r) for r in runs]
    heads: list = [next(s, None) for s in streams] + [None] * (width - len(runs))
    #: What each head shares with the suffix put out last.
    known = [0] * width

    def better(a: int, b: int) -> bool:
        """Whether a goes before b. Sets what the loser shares with the winner."""
        if heads[a] is None or heads[b] is None:
            return heads[b] is None
        x, y = known[a], known[b]
        if x != y:
            return x > y
        p, q = heads[a][1], heads[b][1]
        n = min(len(p), len(q))
        same = n - ((int.from_bytes(p[x:n]) ^ int.from_bytes(q[x:n])).bit_length() + 7) // 8
        first = p[same : same + 1] <= q[same : same + 1] if p[same : same + 1] != q[same : same + 1] else a < b
        known[b if first else a] = same
        return first

    losers, winners = [0] * width, list(range(width))
    for level in range(width.bit_length() - 2, -1, -1):
        row, winners = winners, []
        for i in range(1 << level):
            a, b = row[2 * i], row[2 * i + 1]
            if better(a, b):
                winners.append(a)
                losers[(1 << level) + i] = b
            else:
                winners.append(b)
                losers[(1 << level) + i] = a
    top = winners[0]
    while heads and heads[top] is not None:
        _, key, left, i = heads[top]
        yield known[top], key, left, top, i
        heads[top] = new = next(streams[top], None)
        if new is not None:
            known[top] = new[0]
        node, mine = (top + width) >> 1, top
        while node:
            other = losers[node]
            if better(other, mine):
                losers[node], mine = mine, other
            node >>= 1
        top = mine


def reaches(shared: np.ndarray, sizes: np.ndarray, lefts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes, the most bytes to the left, and to the right of the gram, in a window of LENGTH bytes that another
    one has too; -1 if there is none. shared: with the one before, in bytes of the suffix."""
    n = len(lefts)
    m, left_size = _matrix(lefts, SIDE)
    far_left, far_right = np.full(n, -1), np.full(n, -1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for t in range(SIDE + 1):
            if t:
                h = mix64(h + m[:, t - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(_B)
            # Suffixes that agree in LENGTH - t bytes stand together; with t bytes to the left they make a window.
            together = np.cumsum(shared < LENGTH - t)
            able = np.flatnonzero((left_size >= t) & (sizes >= LENGTH - t))
            x = mix64(h[able] + mix64(together[able].astype(np.uint64)))
            order = np.argsort(x)
            same = x[order][1:] == x[order][:-1]
            pair = np.flatnonzero(same)
            p, q = able[order[pair]], able[order[pair + 1]]
            same[pair] = (together[p] == together[q]) & (m[p, :t] == m[q, :t]).all(axis=1)  # the bytes decide, not the hash
            hit = able[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(able) else able
            far_left[hit] = t
            far_right[hit] = np.maximum(far_right[hit], SIDE - t)
    return far_left, far_right


OUT = pa.schema([("part", pa.int32()), ("block", pa.binary()), ("b", pa.int32()), ("i", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
OUT_DDL = "part int, block binary, b int, i int, start int, stop int"


def _span_rows(b, i, start, stop) -> dict:
    n = len(start)
    return {"part": pa.nulls(n, pa.int32()), "block": pa.nulls(n, pa.binary()), "b": b, "i": i, "start": start, "stop": stop}


def _runs(parts: int):
    def run(found: pa.Table, texts: pa.Table) -> pa.Table:
        """A bucket's sorted runs by range, and the spans that its own suffixes settle."""
        if not found.num_rows or not texts.num_rows:
            return OUT.empty_table()
        own, text_of = found.column("b")[0].as_py(), _ordered(texts)
        entries = []
        for i, pos in zip(found.column("i").to_pylist(), found.column("pos").to_pylist(), strict=True):
            text = text_of[i]
            s = text[pos : pos + LENGTH]
            entries.append((gram_key(s), text[max(0, pos - SIDE) : pos][::-1], own, i, pos))
        entries.sort()
        spans, rows, at = [], [], 0
        while at < len(entries):
            key, left, b, i, pos = entries[at]
            end = at + 1
            while end < len(entries) and entries[end][0] == key and entries[end][1] == left:
                end += 1
            settled = end - at > 1 and len(key) - 8 + len(left) >= LENGTH
            if settled:
                spans += [(b, e[3], e[4] - len(left), e[4] + len(key) - 8) for e in entries[at:end]]
            rows += [(key, left, b, i, pos, settled)] if settled or end - at == 1 else [(*e, False) for e in entries[at:end]]
            at = end
        part = np.array([int.from_bytes(r[0][:4]) * parts >> 32 for r in rows])
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        blocks = [Run.pack([r[0] for r in rows[a:b]], [r[1] for r in rows[a:b]], np.array([r[2:] for r in rows[a:b]], np.int64).T) for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
        n = len(blocks)
        first = batch(OUT, {"part": part[cuts].astype(np.int32), "block": blocks} | {k: pa.nulls(n, pa.int32()) for k in OUT.names[2:]})
        s = np.array(spans, np.int32).reshape(-1, 4).T
        return pa.Table.from_batches([first, batch(OUT, _span_rows(*s))])

    return run


def gram_key(suffix: bytes) -> bytes:
    """A suffix in sort order: the hash of its gram, then its bytes."""
    return hashlib.blake2b(suffix[:GRAM], digest_size=8).digest() + suffix


def _merge(blocks: pa.Table) -> pa.Table:
    """The spans of one range of the suffix order."""
    runs = [Run(x) for x in blocks.column("block").to_pylist()]
    held: list = []
    out = []

    def judge() -> None:
        shared = np.array([x[0] for x in held]) - 8
        shared[0] = 0
        sizes = np.array([len(x[1]) for x in held]) - 8
        left, right = reaches(shared, sizes, [x[2] for x in held])
        for k in np.flatnonzero(left >= 0).tolist():
            b, i, pos, settled = runs[held[k][3]].ids[:, held[k][4]].tolist()
            if not settled:
                out.append((b, i, pos - int(left[k]), pos + GRAM + int(right[k])))
        held.clear()

    for x in merged(runs):
        if len(held) >= CHUNK and x[0] - 8 < GRAM:
            judge()
        held.append(x)
    if held:
        judge()
    return pa.Table.from_batches([batch(OUT, _span_rows(*np.array(out, np.int32).reshape(-1, 4).T))])


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(texts: pa.Table, found: pa.Table) -> pa.Table:
    spans: dict[int, list[tuple[int, int]]] = {}
    for i, a, b in zip(*(found.column(k).to_pylist() for k in ("i", "start", "stop")), strict=True):
        spans.setdefault(i, []).append((a, b))
    out = []
    for i, text in enumerate(_ordered(texts)):
        text = text or b""
        gone = _covered(spans.get(i, []))
        kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True))
        out.append((len(text), len(text) - len(kept), len(gone), kept))
    ids = texts.sort_by([("doc_id", "ascending"), ("rk", "ascending")]).column("doc_id").combine_chunks()
    return pa.Table.from_batches([batch(KEPT, {"doc_id": ids} | {k: [r[i] for r in out] for i, k in enumerate(KEPT.names[1:])})])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every row."""
    spark = docs.sparkSession
    n = buckets_for(spark, text_bytes(docs), BUCKET_MB)
    rows = as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text"), "rk")
    of = F.pmod(F.xxhash64("doc_id", "rk"), F.lit(n)).cast("int").alias("b")
    texts = bucketed(rows.select(of, "doc_id", "rk", "text"), "b", n, "texts")
    found = texts.groupBy("b").applyInArrow(_anchor_rows, "h long, b int, i int, pos int, n int")
    twice = found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_repeated, "b int, i int, pos int")
    runs = written(twice.groupBy("b").cogroup(texts.groupBy("b")).applyInArrow(_runs(n), OUT_DDL), "runs")
    dropped_shuffles(spark)
    spans = runs.where("part IS NOT NULL").groupBy("part").applyInArrow(_merge, OUT_DDL).union(runs.where("part IS NULL")).select("b", "i", "start", "stop")
    return texts.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
