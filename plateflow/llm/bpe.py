"""Operator 8: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings (hash, displace, compare): a pre-token that is a whole
token costs one array access and one comparison. Tier two: the others are merged with a heap of (rank, position) over a
doubly linked list of bytes, so a pre-token of n bytes takes n log n steps however long it is.

The tables are made once on the driver from the vocabulary's file (its size is the bound of what is broadcast). Tasks look
up each distinct pre-token of a small batch once. Null counts as empty: no ids. Rows that share a doc_id are encoded each
for itself. An empty table gives an empty result. Texts and pre-tokens of any length are encoded whole; of equal ranks the leftmost
pair is merged first. docs has no column token_ids or decoded; others pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import Batches, batch, slices
from plateflow.llm.common import documents, mix64

#: A blank between two characters that aren't white space.
_BLANK = re.compile(r"(?<!\s) (?!\s)")
#: Distinct pre-tokens, and stretches of text, that a task remembers at most.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash of byte strings: buckets, largest first, get the first seed that sends all their keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.m = max(1, n // per_bucket)
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, n)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.m))[:-1])
        self.seeds = [0] * self.m
        self.slots = [-1] * n
        free = np.ones(n, bool)
        singles = []
        for b in sorted(range(self.m), key=lambda b: -len(members[b])):
            own = h[members[b]]
            if len(own) == 1:
                singles.append(b)
                continue
            for first in range(1 if len(own) else 1 << 30, 1 << 30, 128):
                at = self._place(own, np.arange(first, first + 128, dtype=np.uint64)[:, None])
                ordered = np.sort(at, axis=1)
                fit = np.flatnonzero(free[at].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fit):
                    self.seeds[b] = first + int(fit[0])
                    free[at[fit[0]]] = False
                    for k, x in zip(members[b].tolist(), at[fit[0]].tolist(), strict=True):
                        self.slots[x] = k
                    break
        # A bucket of one key keeps its slot itself, as a negative seed.
        for b, x in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.seeds[b] = -1 - x
            self.slots[x] = int(members[b][0])

    def _place(self, h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(h + seeds * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def candidate(self, key: bytes) -> int:
        """The one key number that key can have."""
        h = xxhash.xxh64_intdigest(key)
        seed = self.seeds[h % self.m]
        if seed < 0:
            return self.slots[-1 - seed]
        x = (h + seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        return self.slots[(x ^ (x >> 31)) % self.n]


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        number = {t: i for i, t in enumerate(tokens)}
        self.bytes = [number[bytes([i])] for i in range(256)]
        #: Two ids that join to a token: left << 32 | right to the token's id, which is its rank.
        self.joins = {number[t[:k]] << 32 | number[t[k:]]: i for t, i in number.items() for k in range(1, len(t)) if t[:k] in number and t[k:] in number}

    def id_of(self, piece: bytes) -> int | None:
        k = self.hash.candidate(piece)
        return k if self.tokens[k] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token: merge the pair of least rank, the leftmost first, until no pair is a token."""
        get, n = self.joins.get, len(piece)
        ids = [self.bytes[x] for x in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry: the token that two neighbours would make, where the left one starts, both as they were then.
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (x := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (k := before[i]) >= 0 and (x := get(ids[k] << 32 | r)) is not None:
                heapq.heappush(heap, (x, k, ids[k], r))
        return [x for x in ids if x >= 0]

    def encoder(self):
        """A function from a text to ids, with a memory of its own. A single blank between two other characters always begins a
        pre-token, so a text is cut there and each distinct stretch is split and looked up once."""
        split, stretches, inner = regex.compile(self.pattern).findall, _BLANK.split, {}
        pack = struct.Struct("<I").pack

        def ids_of(piece: str) -> bytes:
            b = piece.encode()
            k = self.id_of(b)
            found = pack(k) if k is not None else np.array(self.merged(b), "<u4").tobytes()
            if len(inner) < REMEMBERED and len(b) <= 64:
                inner[piece] = found
            return found

        class Stretches(dict):
            """By a stretch with the blank before it: its ids."""

            def __missing__(self, stretch: str) -> bytes:
                found = b"".join([inner.get(x) or ids_of(x) for x in split(" " + stretch)])
                if len(self) < REMEMBERED and len(stretch) <= 64:
                    self[stretch] = found
                return found

        words = Stretches()

        def encode(text: str) -> np.ndarray:
            first, *rest = stretches(text)
            head = b"".join([inner.get(x) or ids_of(x) for x in split(first)])
            return np.frombuffer(head + b"".join(map(words.__getitem__, rest)), "<u4")

        return encode

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


IDS = "token_ids binary"


def with_token_ids(docs: DataFrame, codec: Codec) -> DataFrame:
    """docs' columns but text, and token_ids: the ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in docs.columns if c != "text")

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        if not hasattr(codec, "_encode"):  # a Python worker that Spark uses again keeps what it has learnt
            codec._encode = codec.encoder()
        encode = codec._encode
        for b in slices(batches):
            ids = [encode(t or "").tobytes() for t in b.column("text").to_pylist()]
            rest = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ids, pa.binary())], names=[*rest.schema.names, "token_ids"])

    return docs.mapInArrow(run, fields + IDS)


def with_decoded(encoded: DataFrame, codec: Codec) -> DataFrame:
    """encoded's columns, and decoded: the bytes that token_ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)
    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in encoded.columns)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [shared.value.decode(np.frombuffer(x, "<u4")) for x in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, fields + ", decoded binary")


def public_codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = public_codec()
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = with_decoded(with_token_ids(docs, codec), codec)
    return both.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
