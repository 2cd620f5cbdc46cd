"""Operator 6: token ids in a binary file format.

Ids are ranked by how often they occur in the whole corpus, so that frequent ones take one byte. A block holds the ids of
up to BLOCK_DOCS documents in byte-aligned variable-length coding with separate control bytes: two bits an id give its
length in bytes, four lengths to a control byte, and all data bytes follow in a stream of their own. A reader decodes with
numpy: a table of 256 entries turns control bytes into lengths, a running sum turns lengths into places.

Files are Parquet containers of blocks in ascending doc_id order: shard (a range of doc_ids), number of the block in it, ids of
the shard before the block, doc_ids, ids of each document, control bytes, data bytes. Spark's committer writes them, so a lost
executor leaves no half file. The rank table is a small file of its own (as many rows as the vocabulary has ids).

Texts are read and tokenized once; documents are dealt by ranges of doc_id in compressed form, and what is written then is
recoded by rank in a second pass over blocks that shuffles nothing.

Null counts as empty: the end id alone. Rows with equal doc_ids follow each other in order of their first four ids, then of
their compressed form; null doc_ids come first. A text of any length is one document of one block; ids that occur equally
often are ranked by number. An empty table gives empty files and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import Batches, batch, slices
from plateflow.llm.common import buckets_for, documents, freed, shared_dir, text_bytes, written

END = 1
#: Documents of a block at most, and ids after which a block ends.
BLOCK_DOCS, BLOCK_IDS = 512, 1 << 18
#: Distinct chunks of text that a worker remembers at most.
REMEMBERED = 800_000
#: By control byte: the lengths of its four ids.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(size > k, raw[start + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


_END = np.array([END], "<u4").tobytes()
#: Characters whose lower case the tokenizer and Python agree on wherever they stand.
_PLAIN = re.compile(r"[^\x00-\u024f]")


def _chunks(text: str) -> list[str]:
    """What stands between blanks and line ends, lower-cased as the tokenizer would, where that is safe beforehand."""
    if "<|" in text or not text.isascii() and _PLAIN.search(text):  # special strings are found before any lower-casing
        return text.replace("\n", " ").split(" ")
    return text.lower().replace("\n", " ").split(" ")


#: Lower-case letters of Latin-1, and at most one mark after them: two pre-tokens of the tokenizer, whatever stands around.
_WORD = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)\Z")
#: The byte-level alphabet: bytes that print stand for themselves, the others, in order, for characters from 256 on.
_LEVEL = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Encoders by vocabulary: a Python worker that Spark uses again keeps what it has learnt.
_ENCODERS: dict = {}
#: Stands between chunks that are encoded in one call; chunks that hold it are encoded alone. It is a token of its own.
_MARK = "\x00"


def chunk_encoder(tokenizer):
    """A function from texts to ids. The tokenizer drops white space and no token spans it, so a text's ids are those of its
    chunks between blanks and line ends, and each distinct chunk is encoded once."""
    known: dict[str, bytes] = {}
    (mark,) = tokenizer.encode(_MARK, add_special_tokens=False).ids

    def of_word(word: str) -> bytes:
        ids = [t.id for t in tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_LEVEL))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(chunks: list[str]) -> list[str]:
        """Adds the chunks to known; returns all keys added. Plain words, with a mark after them or without, go to the
        tokenizer's model as they are: its normalizer and its splitting would leave them so."""
        added, rest = [], []
        for c in chunks:
            if (m := _WORD.match(c)) is None:
                rest.append(c)
                continue
            ids = b""
            for part in filter(None, m.groups()):
                if part not in known:
                    known[part] = of_word(part)
                    added.append(part)
                ids += known[part]
            if m[2]:
                known[c] = ids
                added.append(c)
        plain = [c for c in rest if _MARK not in c]
        joined = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group, e in zip(joined, tokenizer.encode_batch_fast([f" {_MARK} ".join(g) for g in joined], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = [-1, *np.flatnonzero(ids == mark).tolist(), len(ids)]
            flat = ids.tobytes()
            for c, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                known[c] = flat[4 * a + 4 : 4 * b]
        known.update((c, np.array(tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()) for c in rest if _MARK in c)
        return added + rest

    def encode(texts: list[str]) -> list[bytes]:
        split = [_chunks(t) for t in texts]
        found = [list(map(known.get, chunks)) for chunks in split]
        holes = [[k for k, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        added = learn(list({chunks[k] for chunks, new in zip(split, holes, strict=True) for k in new}))
        for chunks, ids, new in zip(split, found, holes, strict=True):
            for k in new:
                ids[k] = known[chunks[k]]
        if len(known) > REMEMBERED:  # what came first is frequent: it stays
            for c in added:
                known.pop(c, None)
        return [b"".join(ids) + _END for ids in found]

    return encode


#: Bytes of a squeezed document by which rows of one doc_id are put in order.
HEAD = 16


def squeezed(ids: bytes) -> bytes:
    """32-bit ids in a compressed form, behind the first HEAD bytes as they are."""
    values = np.frombuffer(ids, "<u4")
    small = len(values) == 0 or int(values.max()) < 1 << 16
    raw = values.astype("<u2").tobytes() if small else ids
    return ids[:HEAD].ljust(HEAD, b"\0") + struct.pack("<?Q", small, len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(x: bytes) -> np.ndarray:
    small, size = struct.unpack_from("<?Q", x, HEAD)
    return np.frombuffer(pa.decompress(x[HEAD + 9 :], size, "zstd", asbytes=True), "<u2" if small else "<u4")


def tokenized(docs: DataFrame, path: str, bounds: np.ndarray) -> DataFrame:
    """shard (how many bounds lie under the doc_id; null: 0), doc_id and ids (squeezed, the end id last) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((open(path).read(), bounds))  # a vocabulary file and a number a shard
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        vocabulary, bounds = shared.value
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = chunk_encoder(Tokenizer.from_str(vocabulary))
        encode = _ENCODERS[vocabulary]
        for b in slices(batches, 128):
            doc_id = b.column("doc_id")
            shard = np.where(doc_id.is_null(), 0, np.searchsorted(bounds, doc_id.fill_null(0).to_numpy()))
            yield batch(schema, {"shard": shard.astype(np.int32), "doc_id": doc_id, "ids": [squeezed(x) for x in encode([t or "" for t in b.column("text").to_pylist()])]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, doc_id long, ids binary")


def doc_id_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """Numbers that cut the doc_ids into about equal ranges (a number a shard)."""
    if shards < 2:
        return np.zeros(0, np.int64)
    cuts = [k / shards for k in range(1, shards)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, max(10_000, 20 * shards)).alias("x")).first()["x"]
    return np.unique(np.array(found or [], np.int64))


BLOCKS = "shard int, block int, before long, doc_ids array<long>, counts array<long>, ids binary"
BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])
#: Text of a shard.
SHARD_MB = 48


def _blocks(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Of rows in order of shard and doc_id, blocks of documents with their ids in compressed form."""
    shard, number, before, doc_ids, parts, held = None, 0, 0, [], [], 0

    def block() -> pa.RecordBatch:
        return batch(BLOCK, {"shard": [shard], "block": [number], "before": [before], "doc_ids": [doc_ids], "counts": [[len(x) for x in parts]], "ids": [squeezed(np.concatenate(parts).astype("<u4").tobytes())]})

    for b in batches:
        for own, doc_id, x in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if parts and (own != shard or len(parts) >= BLOCK_DOCS or held >= BLOCK_IDS):
                yield block()
                number, before, doc_ids, parts, held = number + 1, before + held, [], [], 0
            if own != shard:
                shard, number, before = own, 0, 0
            doc_ids.append(doc_id)
            parts.append(unsqueezed(x))
            held += len(parts[-1])
    if parts:
        yield block()


def frequencies(blocks: DataFrame) -> DataFrame:
    """id and n: how often it occurs. Each task adds up its own before anything is shuffled."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches, 1):
            own = np.bincount(unsqueezed(b.column("ids")[0].as_py()), minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield batch(schema, {"id": at, "n": total[at]})

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


FILES = "shard int, block int, before long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, to: str) -> None:
    """Writes `to`/ranks (one row an id: rank, id, n) and `to`/blocks, in ascending doc_id order."""
    spark = docs.sparkSession
    n = buckets_for(spark, text_bytes(docs), SHARD_MB)
    dealt = tokenized(docs, path, doc_id_bounds(docs, n)).repartitionById(n, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    draft = written(dealt.mapInArrow(_blocks, BLOCKS), "ids")
    ranked = sorted(frequencies(draft).collect(), key=lambda r: (-r["n"], r["id"]))  # at most the vocabulary's size
    spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(f"{to}/ranks")
    rank = np.zeros(max([r["id"] for r in ranked], default=0) + 1, np.uint32)
    rank[[r["id"] for r in ranked]] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank)
    schema = pa.schema([*BLOCK][:-1] + [("control", pa.binary()), ("data", pa.binary())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            control, data = encode_block(shared.value[unsqueezed(b.column("ids")[0].as_py())])
            yield batch(schema, {k: b.column(k) for k in BLOCK.names[:-1]} | {"control": [control], "data": [data]})

    draft.mapInArrow(run, FILES).write.option("compression", "zstd").parquet(f"{to}/blocks")
    freed(draft)


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers), as the files have them."""
    ranks = spark.read.parquet(f"{at}/ranks").orderBy("rank").collect()  # at most the vocabulary's size
    blocks = spark.read.parquet(f"{at}/blocks")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    # Where each shard starts: one number a shard is all that leaves the files.
    sizes = blocks.groupBy("shard").agg(F.max(F.col("before") + total).alias("n")).collect()
    starts = np.zeros(max([r["shard"] for r in sizes], default=-1) + 2, np.int64)
    for r in sizes:
        starts[r["shard"] + 1] = r["n"]
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in ranks], "<u4"), np.cumsum(starts)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        ids, starts = shared.value
        for b in slices(batches, 1):
            for r in b.to_pylist():
                counts = np.array(r["counts"], np.int64)
                values = ids[decode_block(r["control"], r["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                yield batch(schema, {"doc_id": r["doc_ids"], "start": starts[r["shard"]] + r["before"] + ends - counts, "n_tokens": counts, "ids": [values[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]})

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = f"{shared_dir(spark)}/plateflow-tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), to)
    return read_token_files(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
