"""Operator 3: benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark is read in blocks of at most BLOCK_BYTES of text (a longer item goes in overlapping pieces), so what is broadcast
has a bound whatever its size. A block holds its vocabulary, every window as a 64-bit hash, and the words themselves to verify
hits. Documents stream past: their words become vocabulary ids, windows with a word outside the vocabulary are skipped, the others
are looked up and verified word by word. A benchmark of one block takes one pass and no shuffle. With more, each block has a pass
of its own, whose hits alone are written; in the end they are put together and meet the documents in one shuffle.

Null and empty texts have no words and no hits. Items without words have no window. Items with a null id mark words as hit
but are in no list of items; items that share an id are one. Rows that share a doc_id are judged each for itself. Texts of any length are judged whole; the same words
in several items hit for each. `remove_documents` and `remove_spans` pass columns of any name through, `with_hits` needs its two
own names free. With an
empty benchmark nothing is contaminated.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import LOWER_BYTES, Batches, batch, slices
from plateflow.llm.common import documents, row_key, table, written

WINDOW = 10
#: Text of one broadcast block of the benchmark.
BLOCK_BYTES = 8_000_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").translate(LOWER_BYTES))


def _hashes(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            h = (h ^ ids[starts + j].astype(np.uint64)) * _BASE
            h ^= h >> np.uint64(29)
    return h


class WindowSet:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        flat, spans = [], {}
        for n, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            length = min(window, len(ids))
            if length:
                spans.setdefault(length, []).append((len(flat), len(flat) + len(ids) - length + 1, n))
                flat += ids
        self.ids = np.array(flat, np.int32)
        #: For each length of window: sorted hashes, where each begins in ids, and its item.
        self.windows = {}
        for length, found in spans.items():
            starts = np.concatenate([np.arange(a, b) for a, b, _ in found])
            item = np.concatenate([np.full(b - a, n) for a, b, n in found])
            h = _hashes(self.ids, starts, length)
            order = np.argsort(h, kind="stable")
            self.windows[length] = h[order], starts[order].astype(np.int32), item[order].astype(np.int32)

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Of each word whether it is hit; the items with a window in these words."""
        n = len(words)
        covered, found = np.zeros(n + 1, np.int32), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for length, (hashes, starts, item) in self.windows.items():
            if n < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            h = _hashes(ids, at, length)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for k in np.flatnonzero(high > low).tolist():
                mine = ids[at[k] : at[k] + length]
                same = (self.ids[starts[low[k] : high[k], None] + np.arange(length)] == mine).all(axis=1)
                if same.any():
                    covered[at[k]] += 1
                    covered[at[k] + length] -= 1
                    found.update(item[low[k] : high[k]][same].tolist())
        return np.cumsum(covered[:-1]) > 0, found


def _pieces(text: bytes | None, most: int, window: int = WINDOW) -> Iterator[bytes]:
    """A text, or, if it is longer, parts of it of about `most` bytes that have all its windows between them."""
    if text is None or len(text) <= most:
        yield text or b""
        return
    words = words_of(text)
    start = 0
    while start == 0 or start + window <= len(words):
        size, stop = 0, start
        while stop < len(words) and (size < most or stop - start < window):
            size += len(words[stop]) + 1
            stop += 1
        yield b" ".join(words[start:stop])
        start = max(stop - window + 1, start + 1)
        if stop == len(words):
            return


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[WindowSet]:
    """The benchmark's rows stream through the driver, a block at a time; at least one block."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    items, size, made = [], 0, 0
    for r in rows.toLocalIterator():
        for piece in _pieces(bytes(r["text"]) if r["text"] is not None else None, block_bytes // 2):
            if items and size + len(piece) > block_bytes:
                yield WindowSet(items)
                items, size, made = [], 0, made + 1
            items.append((r["item_id"], piece))
            size += len(piece)
    if items or not made:
        yield WindowSet(items)


HITS = "hit_words binary, items array<string>"


def _found(windows: WindowSet, text: str | bytes | None) -> tuple[bytes, list[str]]:
    hit, found = windows.hits(words_of(text.encode() if isinstance(text, str) else text))
    return np.packbits(hit).tobytes(), sorted({windows.items[k] for k in found if windows.items[k] is not None})


def _with_block(docs: DataFrame, block: WindowSet) -> DataFrame:
    """docs' columns, hit_words and items, by one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bits, items = zip(*(_found(shared.value, t) for t in b.column("text").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=[*b.schema.names, "hit_words", "items"])

    return docs.mapInArrow(run, f"{fields}, {HITS}")


PART = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("hit_words", pa.binary()), ("items", pa.list_(pa.string()))])


def _block_hits(docs: DataFrame, block: WindowSet) -> DataFrame:
    """doc_id, rk, hit_words and items of the rows with a hit, written."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(*own, *_found(shared.value, t)) for *own, t in zip(*(b.column(k).to_pylist() for k in ("doc_id", "rk", "text")), strict=True)]
            found = [x for x in found if any(x[2])]
            yield batch(PART, {k: [x[i] for x in found] for i, k in enumerate(PART.names)})

    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text").mapInArrow(run, f"doc_id long, rk long, {HITS}").dropDuplicates(["doc_id", "rk"])
    out = written(part, "hits")
    shared.unpersist()
    return out


def _merged(rows: pa.Table) -> pa.Table:
    """One row's hits by all blocks."""
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows.column("hit_words").to_pylist()])
    items = sorted({x for own in rows.column("items").to_pylist() for x in own})
    return pa.Table.from_batches([batch(PART, {k: rows.column(k)[:1].combine_chunks() for k in ("doc_id", "rk")} | { "hit_words": [bits.tobytes()], "items": [items]})])


def with_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns, hit_words (a bit for each word, packed; the last byte's rest 0) and items (the ids with an occurring window,
    sorted). docs has no columns of these names."""
    blocks = _blocks(benchmark, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _with_block(docs, block)
    parts = _block_hits(docs, block)
    for block in itertools.chain([more], blocks):
        parts = parts.unionByName(_block_hits(docs, block))
    hits = parts.groupBy("doc_id", "rk").applyInArrow(_merged, f"doc_id long, rk long, {HITS}").withColumnRenamed("doc_id", "hit_id")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("id"), row_key().alias("row"))
    both = own.join(hits, (F.col("row") == F.col("rk")) & F.col("hit_id").eqNullSafe(F.col("id")), "left")
    none = F.coalesce("hit_words", F.lit(b"")), F.coalesce("items", F.array().cast("array<string>"))
    return both.select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns), none[0].alias("hit_words"), none[1].alias("items"))


def n_hit_bits(packed: bytes) -> int:
    return int(np.unpackbits(np.frombuffer(packed, np.uint8)).sum())


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no window of the benchmark, with their columns as they are."""
    clash = {c: f"_own_{c}" for c in ("hit_words", "items") if c in docs.columns}
    hits = with_hits(docs.withColumnsRenamed(clash), benchmark)
    return hits.where(~_any_bit(F.col("hit_words"))).drop("hit_words", "items").withColumnsRenamed({v: k for k, v in clash.items()})


def _any_bit(packed):
    return F.length(F.translate(F.hex(packed), "0", "")) > 0


_SPAN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with each run of hit words cut from its text (from the first word's start to the last one's end)."""

    @F.pandas_udf("string")
    def cut(texts, packed):
        import pandas as pd

        def one(text, bits):
            if text is None or not any(bits):
                return text
            # A-Z and a-z are word characters alike once lower-cased, so spans are found on the lower-cased text.
            low = text.encode().translate(LOWER_BYTES).decode()
            spans = [m.span() for m in _SPAN.finditer(low)]
            hit = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(spans))
            out, at = [], 0
            edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            for a, b in edges.tolist():
                out.append(text[at : spans[a][0]])
                at = spans[b - 1][1]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, b) for t, b in zip(texts, packed, strict=True)], dtype=object)

    clash = {c: f"_own_{c}" for c in ("hit_words", "items") if c in docs.columns}
    hits = with_hits(docs.withColumnsRenamed(clash), benchmark)
    return hits.withColumn("text", cut("text", "hit_words")).drop("hit_words", "items").withColumnsRenamed({v: k for k, v in clash.items()})


REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _report(batches: Batches) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n = [len(words_of(t)) for t in b.column("text").to_pylist()]
        hit = [n_hit_bits(x) for x in b.column("hit_words").to_pylist()]
        items = b.column("items").to_pylist()
        yield batch(REPORT, {"doc_id": b.column("doc_id"), "n_words": n, "n_hit": hit, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [x > 0 for x in hit]})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return with_hits(docs, table(spark, sf_dir, "benchmark")).mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
x AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT d.r, d.w, n.n, unnest(range(1, len(d.w) - n.n + 2)) AS i FROM d, n WHERE len(d.w) >= n.n)),
h AS (SELECT x.r, x.n, x.i, g.item_id FROM x JOIN g ON x.n = g.n AND x.gram = g.gram),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
