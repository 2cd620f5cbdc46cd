"""Operator 5: SimHash near-dedup with BK-trees.

Fingerprints are 64 bits over word shingles. Copies collapse first: everything after works on distinct fingerprints. Two
that differ in at most three of 64 bits agree in at least two of five blocks, so each is dealt to ten shards (pairs of
blocks, about 26 bits each). A shard's fingerprints are cut into slices of a tree's size; every two slices meet in one task, where
each tree is handed to the rest, which follow only edges within the radius of their own distance. A task yields a spanning forest
of its links (never all pairs), and the links' components are found with star contraction (a hub is a skewed key of inner joins,
which Spark's adaptive execution splits).

`keep_near_first` is the same for similarity: texts whose sets of five-word shingles have a Jaccard similarity of SIMILAR or more.
Such fingerprints differ in ten bits or so, which no block is sure to survive; so each is dealt to as many shards of randomly chosen
bits as find a pair at SIMILAR with probability RECALL. A shard's BK-tree finds what lies within WIDE bits; a sketch of the set that
travels along tells what may be similar, before anything is chosen. Sure links make classes inside the task, and one link a class is
enough; of doubtful ones to another class the best go out first and are verified on the sets, and where there were more of them
than went out, the shard is looked at again with the classes that are known by then, until none is left. No link is given up.

Null and empty texts have fingerprint zero, linked like any other. Rows may share a doc_id. A null doc_id is never a
component's id unless all its members have none (then null). An empty table gives an empty result. Texts of any length count whole; a bit
set in exactly half of the hashes is 0. Rows keep columns of any name.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import LOWER_BYTES, Batches, as_bytes, batch, per_row, slices
from plateflow.llm.common import cut, documents, mix64, row_key, written
from plateflow.llm.components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: First bit and length of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Nodes of one tree.
TREE = 4096


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned integer."""
    ws = (text or b"").translate(LOWER_BYTES).split()
    if not ws:
        return 0
    grams = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False)) if len(ws) > words else [b" ".join(ws)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


class BKTree:
    """Children are keyed by their distance to the parent, so a search within r of a node at distance d needs only keys d - r to d + r."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (value ^ self.values[at]).bit_count()
            if (below := self.children[at].setdefault(d, new)) == new:
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield self.values[at]
            if kids := self.children[at]:
                for k in range(max(d - radius, 0), d + radius + 1):
                    if k in kids:
                        stack.append(kids[k])


def spanning_links(values: list[int], radius: int, tree: int = TREE) -> list[tuple[int, int]]:
    """Links that connect what the whole of a shard's links connects; at most one for each value."""
    roots = {v: v for v in values}

    def root(v: int) -> int:
        while roots[v] != v:
            roots[v] = v = roots[roots[v]]
        return v

    links, trees = [], [BKTree()]
    for v in values:
        for t in trees:
            for other in t.within(v, radius):
                if (a := root(v)) != (b := root(other)):
                    roots[a] = b
                    links.append((v, other))
        if len(trees[-1].values) >= tree:
            trees.append(BKTree())
        trees[-1].insert(v)
    return links


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(radius: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by shard and its slices i and j; what belongs together may go on in the next batch."""
        held: pa.Table | None = None

        def linked(t: pa.Table) -> pa.RecordBatch:
            keys, values = np.stack([t.column(k).to_numpy() for k in ("shard", "i", "j")]), t.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(values)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    found += spanning_links(values[a:b].tolist(), radius)
            out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return batch(LINKS, {"a": out[:, 0], "b": out[:, 1]})

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            keys = np.stack([t.column(k).to_numpy() for k in ("shard", "i", "j")])
            other = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield linked(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield linked(held)

    return run


def _sliced(dealt: DataFrame, tree: int = TREE) -> DataFrame:
    """dealt with i and j: a shard of more members than a tree holds is cut into slices, and every two slices meet in a task of their
    own, so that no task has more than two trees."""
    slices = dealt.groupBy("shard").agg(F.ceil(F.count("*") / tree).alias("slices")).where("slices > 1").withColumnRenamed("shard", "big")
    sized = dealt.join(slices, F.col("shard") == F.col("big"), "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("slices"))
    met = sized.select("shard", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("other"))
    return met.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")


def _shards(radius: int):
    """One key for each choice of blocks that two fingerprints within the radius must share: its number, then its bits."""
    same = len(BLOCKS) - radius
    for n, chosen in enumerate(combinations(BLOCKS, same)):
        key, shift = F.lit(n).cast("long"), 0
        key = F.shiftleft(key, 58)
        for at, length in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << length) - 1).cast("long")), shift))
            shift += length
        yield key


FPS = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, rk and fp (signed 64 bits) of every row."""
    signed = lambda t: (int(np.uint64(fingerprint(t, words)).view(np.int64)),)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    return as_bytes(rows, "rk").mapInArrow(per_row(FPS, ("doc_id", "rk"), lambda: signed), "doc_id long, rk long, fp long")


def near_duplicate_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and root: the class of each distinct fingerprint, named by one of its members."""
    distinct = cut(prints.select("fp").distinct())
    dealt = distinct.select("fp", F.explode(F.array(*_shards(radius))).alias("shard"))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = _sliced(dealt).repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp").mapInArrow(_links(radius), "a long, b long")
    roots = components(links)
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, rk, fp, component_id, and first: whether the row is the one that stands for its component."""
    prints = written(fingerprints(docs, words), "fingerprints")
    classes = near_duplicate_classes(prints, radius)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    least = prints.groupBy("fp").agg(F.min(rank).alias("least")).join(classes, "fp")
    first = least.groupBy("root").agg(F.min("least").alias("first"))
    named = cut(least.select("fp", "root").join(first, "root").select("fp", "first"))
    joined = prints.join(named, "fp")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rk") == F.col("first.rk"))
    return joined.select("doc_id", "rk", "fp", F.col("first.doc_id").alias("component_id"), is_first.alias("first"))


def _only(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs that first (id, rk) names, one of those equal in doc_id and text. Dealt by the row's hash alone, so that both
    the join and the choice among equal rows rest on one shuffle of the texts."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").alias("id"), row_key().alias("row"))
    named = first.select(F.col("id").alias("first_id"), F.col("rk").alias("first_rk"))
    kept = own.join(named, (F.col("first_rk") == F.col("row")) & F.col("first_id").eqNullSafe(F.col("id")), "left_semi")
    return kept.dropDuplicates(["row", "id"]).select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns))


def keep_first(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each near-duplicate class (the smallest doc_id), with its columns as they are."""
    return _only(docs, simhash_components(docs, words, radius).where("first").select(F.col("doc_id").alias("id"), "rk").distinct())


#: Words of a shingle, similarity of a near copy, how likely a pair at that similarity meets in a shard, bits searched for (a pair at
#: SIMILAR differs in 9.7 bits on average, with a deviation of 2.9).
NEAR_WORDS, SIMILAR, RECALL, WIDE = 5, 0.8, 0.95, 21
#: Different texts of a shard, about. Slots of a sketch (four bits each): a similarity is estimated with a deviation of .037 at SIMILAR.
SHARD, SLOTS = 256, 128
#: Estimates from which a link may be one, and from which it is taken for one until it is verified.
DOUBTFUL, SURE = 0.70, 0.92
#: Doubtful links from a text to other classes that go out in the first round, and by how much they grow from round to round.
FIRST, GROWS = 4, 8
SETS = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.binary())])


_R = np.random.default_rng(65)
_ODD, _ADD = _R.integers(0, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1), _R.integers(0, 1 << 63, SLOTS, np.uint64)


def sketch(h: np.ndarray) -> bytes:
    """Of SLOTS permutations of a set's hashes four bits of the least one."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        np.minimum(least, (h[i : i + 4096, None] * _ODD + _ADD).min(axis=0), out=least)
    bits = (mix64(least) >> np.uint64(60)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).tobytes()


def estimated(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of a set to others by their sketches (a row of slots each): equal slots, less those equal by chance."""
    return ((others == one).mean(axis=1) - 1 / 16) * 16 / 15


def shingle_set(text: bytes | None, words: int) -> tuple[int, int, int, bytes, bytes]:
    """A name for the text's set of shingles, its SimHash, its size, its sketch, and the sorted 32-bit hashes."""
    ws = (text or b"").translate(LOWER_BYTES).split()
    grams = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False)) if len(ws) > words else ([b" ".join(ws)] if ws else [])
    h = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])
    node = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))
    return node, fp, len(h), sketch(h), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()


def chosen_bits(nodes: int) -> list[list[int]]:
    """Of each table of shards the bits that name a shard: so many that shards hold SHARD texts or so, and so many tables that two
    texts at SIMILAR share a shard with probability RECALL. Bits differ with the angle between the sets."""
    k = min(40, max(6, math.ceil(math.log2(max(nodes, 1) / SHARD))))
    differ = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differ) ** k))
    r = random.Random(64)
    return [r.sample(range(64), k) for _ in range(tables)]


class Leafy:
    """A BK-tree over all values at once: a parent is one value, children are keyed by their distance to it, and few values are a leaf.
    A search goes down with many values together, along the edges within the radius of each one's own distance."""

    LEAF = 64

    def __init__(self, values: np.ndarray, places: np.ndarray | None = None) -> None:
        self.places = np.arange(len(values)) if places is None else places
        self.values, self.kids, self.pivot = values, {}, None
        if len(values) > self.LEAF:
            d = np.bitwise_count(values ^ values[0])
            if d.any():  # equal values stay a leaf
                self.pivot = values[0]
                self.kids = {int(k): Leafy(values[d == k], self.places[d == k]) for k in np.unique(d)}

    def within(self, found: np.ndarray, of: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in of and places in the tree of the pairs within the radius."""
        if self.pivot is None:
            for i in range(0, len(of), 512):
                a, b = np.nonzero(np.bitwise_count(of[i : i + 512, None] ^ self.values[None, :]) <= radius)
                yield found[i + a], self.places[b]
            return
        d = np.bitwise_count(of ^ self.pivot).astype(np.int64)
        for k, kid in self.kids.items():
            near = np.abs(d - k) <= radius
            if near.any():
                yield from kid.within(found[near], of[near], radius)


SHARDED = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary()), ("root", pa.int64())])
SHARDED_SQL = "shard long, node long, fp long, n int, sketch binary, root long"


def _to_shards(tables: list[list[int]]):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            fp = b.column("fp").to_numpy().view(np.uint64)
            for t, bits in enumerate(tables):
                key = np.full(len(fp), t, np.uint64) << np.uint64(40)
                for i, bit in enumerate(bits):
                    key |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(i)
                yield batch(SHARDED, {"shard": key.view(np.int64)} | {k: b.column(k) for k in SHARDED.names[1:]})

    return run


def near_links(fp: np.ndarray, n: np.ndarray, slots: np.ndarray, root: np.ndarray, own: np.ndarray, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Links between the places of a shard's texts, and whether there are more. root: what class each is known to be of; own: its
    slice (of two slices only what lies across counts, as each has met itself). Sure links are a spanning forest; of a text's doubtful
    links to other classes the most best ones. Texts go down the tree in blocks, so that pairs take no more room than a block's."""
    cls, tree, across = np.unique(root, return_inverse=True)[1], Leafy(fp), own.min(initial=0) != own.max(initial=0)
    links, doubt = [], []
    for start in range(0, len(fp), 256):
        block = np.arange(start, min(start + 256, len(fp)))
        a, b = np.concatenate([np.stack(x) for x in tree.within(block, fp[block], WIDE)], axis=1)
        fit = (b < a) & (np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b])) & (cls[a] != cls[b])
        if across:
            fit &= own[a] != own[b]
        a, b = a[fit], b[fit]
        order = np.lexsort((b, np.bitwise_count(fp[a] ^ fp[b]), a))
        a, b = a[order], b[order]
        begins = np.searchsorted(a, np.arange(start, start + len(block) + 1))
        for q, x, y in zip(block.tolist(), begins[:-1], begins[1:], strict=True):
            # The nearest one first: if it is a sure link, what else its class holds need not be looked at.
            for part in (b[x : x + 1], b[x + 1 : y]):
                part = part[cls[part] != cls[q]]
                if not len(part):
                    continue
                e = estimated(slots[q], slots[part])
                for k in np.flatnonzero(e >= SURE):
                    if cls[part[k]] != cls[q]:
                        links.append((q, int(part[k])))
                        cls[cls == cls[part[k]]] = cls[q]
                weak = (e >= DOUBTFUL) & (e < SURE)
                if weak.any():
                    doubt.append((q, part[weak], e[weak]))
    more, at = False, 0
    while at < len(doubt):
        end = at + 1 + (at + 1 < len(doubt) and doubt[at + 1][0] == doubt[at][0])  # what the two looks at a text have left
        q, c, e = doubt[at][0], np.concatenate([x[1] for x in doubt[at:end]]), np.concatenate([x[2] for x in doubt[at:end]])
        apart = cls[c] != cls[q]
        c = c[apart][np.lexsort((c[apart], -e[apart]))]
        more |= len(c) > most
        links += [(q, int(k)) for k in c[:most]]
        at = end
    return links, more


NEAR = pa.schema([("shard", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _near_links(most: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by shard and its slices i and j. Candidate links; a shard with more of them, without a link."""
        held: list[pa.RecordBatch] = []
        now = None

        def linked() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            node, fp, n = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t.column("n").to_numpy()
            packed = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
            slots = np.stack([packed >> 4, packed & 15], 2).reshape(len(node), SLOTS)
            links, more = near_links(fp, n, slots, t.column("root").to_numpy(), t.column("own").to_numpy(), most)
            x = np.array(links, int).reshape(-1, 2)
            a, b = node[x[:, 0]], node[x[:, 1]]
            shard = t.column("shard")[0].as_py()
            return batch(NEAR, {"shard": [shard] * (len(x) + more), "a": np.maximum(a, b).tolist() + [None] * more, "b": np.minimum(a, b).tolist() + [None] * more})

        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in ("shard", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if now is not None and tuple(keys[x]) != now and held:
                        if sum(h.num_rows for h in held) > 1:
                            yield linked()
                        held.clear()
                    now = tuple(keys[x])
                    held.append(b.slice(x, y - x))
        if sum(h.num_rows for h in held) > 1:
            yield linked()

    return run


def _verified(batches: Batches) -> Iterator[pa.RecordBatch]:
    """The links whose sets are similar enough."""
    for x in slices(batches, 1024):
        keep = []
        for p, q in zip(x.column("p").to_pylist(), x.column("q").to_pylist(), strict=True):
            p, q = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
            common = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(common >= SIMILAR * (len(p) + len(q) - common))
        yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cut_shards(dealt: DataFrame, tree: int = TREE) -> DataFrame:
    """dealt with i and j, as `_sliced`, with all columns."""
    large = dealt.groupBy("shard").agg(F.ceil(F.count("*") / tree).alias("slices")).where("slices > 1").withColumnRenamed("shard", "big")
    sized = dealt.join(large, F.col("shard") == F.col("big"), "left").drop("big").withColumn("slices", F.coalesce("slices", F.lit(1)))
    met = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    return met.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("slices", "_other")


def near_copies(docs: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, rk, node and root: the class of near copies of each row, named by one of its sets."""
    made = lambda t: shingle_set(t, words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    prints = written(as_bytes(rows, "rk").mapInArrow(per_row(SETS, ("doc_id", "rk"), lambda: made), "doc_id long, rk long, node long, fp long, n int, sketch binary, shingles binary"), "sets")
    # Copies collapse before anything is shuffled: a set that a third of all rows share is one row of each map task.
    nodes = written(prints.select("node", "fp", "n", "sketch").distinct(), "nodes")
    tables = chosen_bits(nodes.count())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges, roots, again, most = None, None, None, FIRST
    while True:
        known = nodes.withColumn("root", F.col("node"))
        if roots is not None:
            known = nodes.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", "fp", "n", "sketch", F.coalesce("root", "node").alias("root"))
        dealt = known.mapInArrow(_to_shards(tables), SHARDED_SQL)
        dealt = dealt if again is None else dealt.join(again, "shard", "left_semi")
        found = written(_cut_shards(dealt).repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "node").mapInArrow(_near_links(most), "shard long, a long, b long"), "links")
        good = written(_similar(found.where("a IS NOT NULL").select("a", "b").distinct(), prints), "verified")
        edges = good if edges is None else edges.unionByName(good)
        again = found.where("a IS NULL").select("shard").distinct()
        roots = cut(components(edges))
        if again.isEmpty():
            break
        most *= GROWS
    named = roots.select(F.col("node").alias("member"), "root")
    classes = prints.select("doc_id", "rk", "node").join(named, F.col("node") == F.col("member"), "left")
    return classes.select("doc_id", "rk", "node", F.coalesce("root", "node").alias("root"))


def _similar(links: DataFrame, prints: DataFrame) -> DataFrame:
    """The links whose sets are similar."""
    links = cut(links)
    involved = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "node")
    sets = written(prints.groupBy("node").agg(F.first("shingles").alias("shingles")).join(involved, "node"), "shingles")
    with_p = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("p")), "a")
    with_q = with_p.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("q")), "b")
    return with_q.select("a", "b", "p", "q").mapInArrow(_verified, "a long, b long")


def keep_near_first(docs: DataFrame, words: int = NEAR_WORDS) -> DataFrame:
    """One row of each class of near copies (the smallest doc_id, ids before none, then the least row hash), with its columns as they
    are."""
    first = near_copies(docs, words).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "rk")).alias("x"))
    return _only(docs, first.select("x.id", "x.rk"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
