"""Operator 4: language-model scoring with a hierarchical Pitman-Yor model.

A token is drawn in the restaurant of the word before it (at the start of a text, of the end token). A new table there is a
customer of the parent that all contexts share, and a new table in the parent is drawn from a uniform base over the vocabulary
and one unknown word, the outcomes that the contract's base has. Seating is sampled by Gibbs: a random customer of a dish
leaves (their table closes with the probability that they sat alone) and sits down again, at a new table in proportion to the
parent's probability. A pass makes as many moves of each dish as it has customers and starts from the tables of the pass
before. Predictive probabilities are averaged over the last passes; a text's score is the sum of its tokens' log10
probabilities, from which perplexity follows.

Counts cover all training documents. Buckets of documents tokenize their texts once. Three kinds of groups exchange compressed
blocks of numbers, each answer in the order of its question, so that nothing is named twice:

- word groups (by a word's hash) count the words and number them, frequent ones low. They hold the parent restaurant;
- pair groups hold the restaurants of contexts. Pairs (word before, word) are dealt by both, so that a frequent word or context is
  spread over all of them. A pair with one customer has one table and nothing to sample, so only the others, the dishes, take part
  in passes: each pass asks the word groups for tables and customers, seats, and tells them its tables;
- buckets ask for the totals of their words and pairs in the end and score their documents.

Words are known by 64 bits of hash. A word counts as often as the word before as it counts as a token, as each text begins and ends
with the end token.

Null counts as empty: the end token alone. Rows that share a doc_id are scored each for itself; a null id counts as empty text
for the fold. Without training rows every count is 0. Texts of any length are one document of one bucket; words that are as frequent
are numbered by hash. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import LOWER_BYTES, Batches, as_bytes, batch, slices
from plateflow.llm.common import bucket, bucketed, buckets_for, documents, fold_of, freed, mix64, text_bytes, written

FOLDS = 10
#: The end of a text, as a word; no word holds a blank.
END = b" "
#: Restaurants of a Sample, the sampler in one process.
CONTEXTS = 8
#: Discount and strength of every restaurant; passes before the samples, samples to average over.
DISCOUNT, STRENGTH, BURN_IN, SAMPLES = 0.7, 1.0, 2, 2
#: Dishes of more customers make their moves in this many batches (a batch changes the tables by 1 or 2 %).
BATCHES = 64
#: Text of a bucket.
BUCKET_MB = 24


def alone_table(discount: float, customers: int = 1024, tables: int = 128) -> np.ndarray:
    """By customers and tables of a dish: the probability that a random customer sits alone, S(c-1,t-1) / S(c,t) with generalised
    Stirling numbers, from the ratios v(c,t) = S(c,t) / S(c,t-1)."""
    t = np.arange(tables + 1)
    out = np.zeros((customers + 1, tables + 1))
    out[1, 1] = 1
    v = np.zeros(tables + 1)
    for c in range(2, customers + 1):
        out[c, 1:] = 1 / (1 + (c - 1 - discount * t[1:]) * np.where(t[1:] < c, np.append(1e300, v[2:])[: tables], 0))
        out[c, 1] = 0
        out[c, c + 1 :] = 0
        new = np.zeros(tables + 1)
        with np.errstate(divide="ignore"):
            below = np.where(v[1:-1] > 0, 1 / v[1:-1], 0)
            new[2:] = (1 + (c - 1 - discount * t[2:]) * v[2:]) / (below + c - 1 - discount * (t[2:] - 1))
        new[c + 1 :] = 0
        v = new
    return out


ALONE = alone_table(DISCOUNT)


_Y = np.geomspace(1e-12, 1 - 1e-9, 4000)
#: Tables a customer, and the share of customers that sit alone then, of dishes too large for ALONE (saddle point of the sizes).
FEW, LIMIT = (1 - _Y**DISCOUNT) / (DISCOUNT * (1 - _Y) * _Y ** (DISCOUNT - 1)), _Y ** (1 - DISCOUNT)


def alone(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The probability that a random customer of a dish sits alone. c, t: its customers and tables."""
    inside = (c < ALONE.shape[0]) & (t < ALONE.shape[1])
    out = ALONE[np.where(inside, c, 0), np.where(inside, t, 0)]
    if not inside.all():
        out = np.where(inside, out, np.interp(t / np.maximum(c, 1), FEW, LIMIT) * (t - 1) / np.maximum(t, 1))
    return out


def sweep(c: np.ndarray, t: np.ndarray | None, tables: np.ndarray | float, parent: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after as many moves as it has customers. c, t: its customers and tables (None: begins where
    as many tables open as close); tables: those of its whole restaurant; parent: its probability there."""
    order = np.argsort(-c, kind="stable")
    c, parent = c[order], parent[order]
    tables = np.broadcast_to(tables, c.shape)[order]
    now = np.minimum(c, 1) if t is None else t[order]
    others = np.maximum(tables - now, 0)
    steps, moves = np.minimum(c, BATCHES), -(-c // BATCHES)
    ends = len(c) - np.searchsorted(steps[::-1], np.arange(BATCHES), side="right")
    if t is None:
        high = c.copy()
        while (now < high).any():
            middle = (now + high + 1) // 2
            rate = (STRENGTH + DISCOUNT * (others + middle)) * parent
            opens = alone(c, middle) <= rate / (rate + np.maximum(c - 1 - DISCOUNT * middle, 1e-12))
            now, high = np.where(opens, middle, now), np.where(opens, high, middle - 1)
            now, high = np.minimum(now, c), np.maximum(high, now)
    for k in range(BATCHES):
        n = int(ends[k])
        if not n or c[0] < 2:
            break
        cs, ts, m = c[:n], now[:n], moves[:n]
        left = ts - rng.binomial(m, np.where(ts > 1, alone(cs, ts), 0))
        base = np.where(m == 1, left, ts)
        rate = (STRENGTH + DISCOUNT * (others[:n] + base)) * parent[:n]
        came = rng.binomial(m, rate / (rate + np.maximum(cs - 1 - DISCOUNT * base, 1e-12)))
        now[:n] = np.where(cs > 1, np.clip(left + came, 1, cs), ts)
    out = np.empty_like(now)
    out[order] = now
    return out


def parent_p(customers, tables, all_tables, all_customers, vocabulary):
    """The parent's probability of a word (numbers or columns)."""
    return (customers - DISCOUNT * tables + (STRENGTH + DISCOUNT * all_tables) / (vocabulary + 1)) / (STRENGTH + all_customers)


class Sample:
    """The sampler over a few restaurants in one process: a pass's number, and what it is drawn with (tables of each context and of
    the parent before it)."""

    def __init__(self, number: int, context_tables: np.ndarray, parent_tables: int, vocabulary: int):
        self.number, self.context_tables, self.parent_tables, self.vocabulary = number, context_tables, parent_tables, vocabulary

    def parent(self, c: np.ndarray, t: np.ndarray, tables: int, customers: int) -> np.ndarray:
        return parent_p(c, t, tables, customers, self.vocabulary)

    def seat(self, words: list[bytes], of: np.ndarray, context: np.ndarray, c: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of each (word, context), and of each word the parent's customers and tables, after a pass. before: the tables of
        the pass before, of each (word, context) and each word."""
        rng, n = np.random.default_rng(self.number), len(words)
        t, up = before or (None, None)
        above = np.bincount(of, np.minimum(c, 1) if t is None else t, n).astype(np.int64)
        p = self.parent(above, np.minimum(above, 1) if up is None else up, self.parent_tables, int(self.context_tables.sum()))
        t = sweep(c, t, self.context_tables[context], p[of], rng)
        above = np.bincount(of, t, n).astype(np.int64)
        return t, above, sweep(above, None if up is None else np.minimum(up, above), self.parent_tables, np.full(n, 1 / (self.vocabulary + 1)), rng)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, in as few bytes each as the largest takes, byte by byte of all numbers, compressed."""
    heads, parts = [], []
    for x in arrays:
        x = np.ascontiguousarray(x).astype("<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        heads.append(struct.pack("<QB", len(x), width))
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(parts)
    return struct.pack("<BQ", len(arrays), len(raw)) + b"".join(heads) + pa.compress(raw, "zstd", asbytes=True)


def unpack(x: bytes) -> list[np.ndarray]:
    n, size = struct.unpack_from("<BQ", x)
    raw, at, out = pa.decompress(x[9 + 9 * n :], size, "zstd", asbytes=True), 0, []
    for k in range(n):
        count, width = struct.unpack_from("<QB", x, 9 + 9 * k)
        wide = np.zeros((count, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
        out.append(wide.view("<u8").reshape(-1))
        at += count * width
    return out


#: Whom a block is for, whom it comes from, what kind it is of.
MAIL = pa.schema([("to", pa.int32()), ("at", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
MAIL_DDL = "to int, at int, kind int, block binary"


def mail(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([batch(MAIL, {k: [r[i] for r in rows] for i, k in enumerate(MAIL.names)})])


def blocks_of(t: pa.Table) -> list[tuple[int, int, bytes]]:
    """from, kind, block of each row, in order of these two."""
    return sorted(zip(t.column("at").to_pylist(), t.column("kind").to_pylist(), t.column("block").to_pylist(), strict=True), key=lambda r: r[:2])


def _key(t: pa.Table, other: pa.Table, name: str = "to") -> int:
    return (t if t.num_rows else other).column(name)[0].as_py()


TOKENS = pa.schema([("b", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("block", pa.binary())])


def _tokenized(rows: pa.Table) -> pa.Table:
    """A bucket's documents: their ids; of each document tokens and whether it is held out, of the tokens one after the other the
    word's number, and the words' hashes. Words are numbered by how often they occur."""
    place: dict[bytes, int] = {END: 0}
    ids, size = [], []
    for t in rows.column("text").to_pylist():
        ws = [*(t or b"").translate(LOWER_BYTES).split(), END]
        for w in set(ws):
            place.setdefault(w, len(place))
        ids.append(np.fromiter(map(place.__getitem__, ws), np.int64, len(ws)))
        size.append(len(ws))
    ids = np.concatenate(ids)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place))
    order = np.argsort(-np.bincount(ids, minlength=len(place)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    doc_ids = rows.column("doc_id").to_pylist()
    held = np.array([fold_of(d, FOLDS) == 0 for d in doc_ids])
    return pa.Table.from_batches([batch(TOKENS, {"b": [rows.column("b")[0].as_py()], "doc_ids": [doc_ids], "block": [pack(np.array(size), held, number[ids], hashes[order])]})])


class Bucket:
    """A bucket's tokens (numbers of words and of words before), its words' hashes in order of word group and hash, and where each
    word group's begin."""

    def __init__(self, block: bytes, groups: int):
        size, held, ids, hashes = unpack(block)
        self.size, self.held = size.astype(np.int64), held.astype(bool)
        order = np.lexsort((hashes, hashes % np.uint64(groups)))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.ids = number[ids.astype(np.int64)]
        self.end = number[np.flatnonzero(hashes == np.uint64(xxhash.xxh64_intdigest(END)))[0]]
        self.before = np.concatenate([[self.end], self.ids[:-1]])  # a text begins after the end of another
        self.train = ~np.repeat(self.held, self.size)
        self.cuts = np.searchsorted((self.hashes % np.uint64(groups)).astype(np.int64), np.arange(groups + 1))

    def pairs(self, names: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
        """Distinct pairs of known words, by pair group and then by the words' global numbers: number of the word before, of the word,
        training tokens; where each group's begin; and the pair (or -1) of each token."""
        codes, of = np.unique(self.before * len(self.hashes) + self.ids, return_inverse=True)
        c = np.bincount(of, self.train, len(codes)).astype(np.int64)
        u, w = np.divmod(codes, len(self.hashes))
        u, w = names[u], names[w]
        with np.errstate(over="ignore"):
            q = (mix64(mix64(u.astype(np.uint64)) + w.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        q[(u < 0) | (w < 0)] = parts
        order = np.lexsort((w, u, q))
        order = order[: np.searchsorted(q[order], parts)]
        place = np.full(len(codes), -1)
        place[order] = np.arange(len(order))
        return u[order], w[order], c[order], np.searchsorted(q[order], np.arange(parts + 1)), place[of]


def _ask_words(groups: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        """To each word group: the hashes of the bucket's words, and their training tokens."""
        for b in slices(batches, 1):
            own = Bucket(b.column("block")[0].as_py(), groups)
            c = np.bincount(own.ids, own.train, len(own.hashes)).astype(np.int64)
            rows = [(p, b.column("b")[0].as_py(), 0, pack(own.hashes[i:j], c[i:j])) for p, (i, j) in enumerate(zip(own.cuts[:-1], own.cuts[1:], strict=True)) if j > i]
            yield from mail(rows).to_batches()

    return run


def _number_words(asked: pa.Table) -> pa.Table:
    """To each bucket: its words' numbers in the word group, from 1 on (0: no training token has it). To the group itself (kind 1):
    training tokens of each word by number."""
    p, rows = asked.column("to")[0].as_py(), blocks_of(asked)
    hashes, counts = zip(*(unpack(x) for _, _, x in rows), strict=True)
    every, of = np.unique(np.concatenate(hashes), return_inverse=True)
    c = np.bincount(of, np.concatenate(counts), len(every)).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    number = np.empty(len(c), np.int64)
    number[order] = np.arange(1, len(c) + 1)
    number[c == 0] = 0
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    return mail([(b, p, 0, pack(x)) for (b, _, _), x in zip(rows, np.split(number[of], cuts), strict=True)] + [(p, p, 1, pack(c[order][: int((c > 0).sum())]))])


def _names(own: Bucket, told: list[tuple[int, int, bytes]], groups: int) -> np.ndarray:
    """The global number of each of a bucket's words, or -1."""
    out = np.full(len(own.hashes), -1)
    for p, kind, x in told:
        if kind == 0:
            r = unpack(x)[0].astype(np.int64)
            out[own.cuts[p] : own.cuts[p + 1]] = np.where(r > 0, (r - 1) * groups + p, -1)
    return out


def _ask_pairs(groups: int, parts: int):
    def run(tokens: pa.Table, told: pa.Table) -> pa.Table:
        """To each pair group: the bucket's pairs (steps of the word before, the word) and their training tokens."""
        own, b = Bucket(tokens.column("block")[0].as_py(), groups), tokens.column("b")[0].as_py()
        u, w, c, cuts, _ = own.pairs(_names(own, blocks_of(told), groups), parts)
        return mail([(q, b, 0, pack(np.diff(u[i:j], prepend=0), w[i:j], c[i:j])) for q, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i])

    return run


#: Kinds of what a pair group makes: its dishes; for a bucket; the words of its dishes, and all its words, for a word group.
DISHES, ANSWERED, WORDS, FIXED = range(4)


def _part(groups: int):
    def run(asked: pa.Table) -> pa.Table:
        """DISHES: words, and of each dish the number of word and word before among them, customers. ANSWERED: of each pair asked
        for, 0 (not trained), 1 (one customer) or the dish + 2. WORDS: numbers in the word group. FIXED: the same of all words, and
        of each as word and as word before: pairs of one customer, and dishes."""
        q, rows = asked.column("to")[0].as_py(), blocks_of(asked)
        us, ws, cs = zip(*(unpack(x) for _, _, x in rows), strict=True)
        size = [len(x) for x in us]
        u, w, n = np.concatenate([np.cumsum(x.astype(np.int64)) for x in us]), np.concatenate(ws).astype(np.int64), np.concatenate(cs).astype(np.int64)
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])]))
        of = np.empty(len(u), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
        c, u, w = np.add.reduceat(n[order], first), su[first], sw[first]
        dish = c >= 2
        answer = np.where(dish, np.cumsum(dish) + 1, c)[of]
        x, both = np.unique(np.concatenate([w[dish], u[dish]]), return_inverse=True)
        wi, ui = np.split(both, 2)
        out = [(q, q, DISHES, pack(x, wi, ui, c[dish]))]
        out += [(b, q, ANSWERED, pack(a)) for (b, _, _), a in zip(rows, np.split(answer, np.cumsum(size)[:-1]), strict=True)]
        has = c > 0
        every, both = np.unique(np.concatenate([w[has], u[has]]), return_inverse=True)
        sums = [np.bincount(i, v, len(every)) for v in (c[has] == 1, dish[has]) for i in np.split(both, 2)]
        for kind, words, more in ((WORDS, x, []), (FIXED, every, sums)):
            p = words % groups
            for k in np.unique(p):
                at = p == k
                out.append((int(k), q, kind, pack(np.diff(words[at] // groups, prepend=0), *(v[at].astype(np.int64) for v in more))))
        return mail(out)

    return run


STATE = pa.schema([("to", pa.int32()), ("block", pa.binary()), ("up", pa.int64()), ("above", pa.int64())])
STATE_DDL = "to int, block binary, up long, above long"


def _state(p: int, cw, sw, su, above, tables, up) -> pa.Table:
    """A word group: of each word training tokens, tables of one customer as word and as word before, customers in the parent, tables
    as word before, tables in the parent."""
    return pa.Table.from_batches([batch(STATE, {"to": [p], "block": [pack(cw, sw, su, above, tables, up)], "up": [int(up.sum())], "above": [int(above.sum())]})])


def _first_state(counted: pa.Table, fixed: pa.Table) -> pa.Table:
    if not counted.num_rows:
        return STATE.empty_table()
    cw = unpack(counted.column("block")[0].as_py())[0].astype(np.int64)
    sums = np.zeros((4, len(cw)), np.int64)
    for _, _, x in blocks_of(fixed):
        steps, *more = unpack(x)
        sums[:, np.cumsum(steps.astype(np.int64))] += np.array(more, np.int64)
    sw, su, mw, mu = sums
    return _state(_key(counted, fixed), cw, sw, su, sw + mw, su + mu, np.minimum(sw + mw, 1))


def _tell_parts(state: pa.Table, asked: pa.Table) -> pa.Table:
    """To each pair group: of its dishes' words, tables as word before, customers and tables in the parent."""
    if not asked.num_rows:
        return MAIL.empty_table()
    _, _, _, above, tables, up = unpack(state.column("block")[0].as_py())
    return mail([(q, _key(state, asked), 0, pack(*(v[at] for v in (tables, above, up)))) for q, _, x in blocks_of(asked) for at in [np.cumsum(unpack(x)[0].astype(np.int64))]])


SWEPT = pa.schema([*MAIL, ("t", pa.binary()), ("before", pa.binary())])
SWEPT_DDL = MAIL_DDL + ", t binary, before binary"


def _sweep(number: int, groups: int, up_total: int, customers: int, vocabulary: int):
    def run(part: pa.Table, told: pa.Table) -> pa.Table:
        """DISHES with the tables after this pass (t) and after the one before; WORDS: to each word group, of its words the new tables
        as word and as word before."""
        q, old = part.column("to")[0].as_py(), part.column("t")[0].as_py()
        x, wi, ui, c = (v.astype(np.int64) for v in unpack(part.column("block")[0].as_py()))
        tables, above, up = (np.zeros(len(x), np.int64) for _ in range(3))
        for p, _, block in blocks_of(told):
            at = np.flatnonzero(x % groups == p)
            tables[at], above[at], up[at] = unpack(block)
        p = parent_p(above, up, up_total, customers, vocabulary)
        t = sweep(c, unpack(old)[0].astype(np.int64) if old else None, tables[ui], p[wi], np.random.default_rng([number, q])) if len(c) else c
        tw, tu = (np.bincount(i, t, len(x)).astype(np.int64) for i in (wi, ui))
        rows = [(q, q, DISHES, part.column("block")[0].as_py(), pack(t), old)]
        rows += [(int(k), q, WORDS, pack(np.diff(x[at] // groups, prepend=0), tw[at], tu[at]), None, None) for k in np.unique(x % groups) for at in [x % groups == k]]
        return pa.Table.from_batches([batch(SWEPT, {k: [r[i] for r in rows] for i, k in enumerate(SWEPT.names)})])

    return run


def _seat_words(number: int, up_total: int, vocabulary: int):
    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        """The word group after a pass over its seats in the parent."""
        p = _key(state, told)
        cw, sw, su, _, _, up = (v.astype(np.int64) for v in unpack(state.column("block")[0].as_py()))
        above, tables = sw.copy(), su.copy()
        for _, _, x in blocks_of(told):
            steps, tw, tu = unpack(x)
            at = np.cumsum(steps.astype(np.int64))
            above[at] += tw.astype(np.int64)
            tables[at] += tu.astype(np.int64)
        before = None if number == 1 else np.clip(up, np.minimum(above, 1), above)
        up = sweep(above, before, up_total, np.full(len(above), 1 / (vocabulary + 1)), np.random.default_rng([number, p, 1])) if len(above) else above
        return _state(p, cw, sw, su, above, tables, up)

    return run


def train(state: DataFrame, parts: DataFrame, groups: int, vocabulary: int) -> tuple[list[tuple[DataFrame, int, int]], DataFrame]:
    """Of each sample the word groups, tables and customers of the parent; and the dishes with the tables of the last two passes."""
    samples, old = [], []
    asks = parts.where(F.col("kind") == WORDS)
    swept = parts.where(F.col("kind") == DISHES).select("*", F.lit(b"").alias("t"))
    totals = lambda: tuple(x or 0 for x in state.agg(F.sum("up"), F.sum("above")).first())
    up_total, customers = totals()
    for number in range(1, BURN_IN + SAMPLES + 1):
        told = state.groupBy("to").cogroup(asks.groupBy("to")).applyInArrow(_tell_parts, MAIL_DDL)
        swept = written(swept.select(*MAIL.names, "t").groupBy("to").cogroup(told.groupBy("to")).applyInArrow(_sweep(number, groups, up_total, customers, vocabulary), SWEPT_DDL), "swept")
        news, swept = swept.where(F.col("kind") == WORDS).select(*MAIL.names), swept.where(F.col("kind") == DISHES)
        state = written(state.groupBy("to").cogroup(news.groupBy("to")).applyInArrow(_seat_words(number, up_total, vocabulary), STATE_DDL), "state")
        up_total, customers = totals()
        samples.append((state, up_total, customers))
        freed(*old)
        old = [swept] if number > BURN_IN else [swept, state]
    return samples[-SAMPLES:], swept


def _tell_words(names: pa.Table, states: pa.Table) -> pa.Table:
    """To each bucket: of its words training tokens, and of each sample tables as word before, customers and tables in the parent."""
    order = np.argsort(states.column("sample").to_numpy())
    found = [unpack(x) for x in states.column("block").take(pa.array(order)).to_pylist()]
    values = [np.append([0], v) for v in ([found[0][0]] + [x[k] for x in found for k in (4, 3, 5)] if found else [[]] * (1 + 3 * SAMPLES))]
    return mail([(b, _key(names, states), 1, pack(*(v[at] for v in values))) for b, _, x in ((r[2], 0, r[3]) for r in zip(names.column("to").to_pylist(), names.column("kind").to_pylist(), names.column("b").to_pylist(), names.column("block").to_pylist(), strict=True)) for at in [unpack(x)[0].astype(np.int64)]])


def _tell_pairs(rows: pa.Table) -> pa.Table:
    """To each bucket: of its pairs customers, and tables in the samples."""
    c = t1 = t2 = np.zeros(0, np.int64)
    for r in rows.filter(pa.array([x is None for x in rows.column("b").to_pylist()])).to_pylist():
        c, t1, t2 = unpack(r["block"])[3], unpack(r["before"])[0], unpack(r["t"])[0]
    values = [np.append([0, 1], v).astype(np.int64) for v in (c, t1, t2)]
    q = rows.column("q")[0].as_py()
    return mail([(b, q, 2, pack(*(v[at] for v in values))) for b, x in zip(rows.column("b").to_pylist(), rows.column("block").to_pylist(), strict=True) if b is not None for at in [unpack(x)[0].astype(np.int64)]])


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(groups: int, parts: int, totals: list[tuple[int, int]], total: int, vocabulary: int):
    def run(tokens: pa.Table, told: pa.Table) -> pa.Table:
        own, rows = Bucket(tokens.column("block")[0].as_py(), groups), blocks_of(told)
        u, w, n, cuts, pair_of = own.pairs(_names(own, rows, groups), parts)
        words = np.zeros((1 + 3 * SAMPLES, len(own.hashes)), np.int64)
        pairs = np.zeros((1 + SAMPLES, len(u) + 1), np.int64)  # the last one: a pair with an unknown word
        for at, kind, x in rows:
            if kind == 1:
                words[:, own.cuts[at] : own.cuts[at + 1]] = np.array(unpack(x), np.int64)
            elif kind == 2:
                pairs[:, cuts[at] : cuts[at + 1]] = np.array(unpack(x), np.int64)
        c = words[0]
        p = np.zeros(len(own.ids))
        for s, (up_total, customers) in enumerate(totals):
            tables, above, up = words[1 + 3 * s : 4 + 3 * s]
            parent = parent_p(above, up, up_total, customers, vocabulary)
            seated = (pairs[0] - DISCOUNT * pairs[1 + s])[pair_of]
            p += (seated + (STRENGTH + DISCOUNT * tables)[own.before] * parent[own.ids]) / (STRENGTH + c[own.before]) / SAMPLES
        starts = np.cumsum(own.size) - own.size
        base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
        known, base, scores = (np.add.reduceat(x, starts) for x in ((c[own.ids] > 0).astype(np.int64), base[own.ids], np.log10(p)))
        doc_ids = tokens.column("doc_ids")[0].as_py()
        return pa.Table.from_batches([batch(SCORES, {"doc_id": doc_ids, "held_out": own.held, "n_tokens": own.size, "n_known": known, "train_tokens": np.full(len(doc_ids), total), "base_score": base, "score": scores})])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    n = buckets_for(docs.sparkSession, text_bytes(docs), BUCKET_MB, spread=False)
    parts_n = 2 * n  # a task holds all pairs of a group in several orders
    rows = as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # Rows without an id would all share a bucket: they are dealt by text.
    dealt = rows.withColumn("b", F.when(F.col("doc_id").isNull(), bucket("text", n)).otherwise(bucket("doc_id", n)))
    tokens = bucketed(dealt.groupBy("b").applyInArrow(_tokenized, "b int, doc_ids array<long>, block binary"), "b", n, "tokens", deal=False)
    names = written(tokens.mapInArrow(_ask_words(n), MAIL_DDL).groupBy("to").applyInArrow(_number_words, MAIL_DDL), "names")
    of_buckets, counted = names.where("kind = 0"), names.where("kind = 1")
    asked = tokens.groupBy("b").cogroup(of_buckets.groupBy("to")).applyInArrow(_ask_pairs(n, parts_n), MAIL_DDL)
    parts = written(asked.groupBy("to").applyInArrow(_part(n), MAIL_DDL), "parts")
    state = written(counted.groupBy("to").cogroup(parts.where(F.col("kind") == FIXED).groupBy("to")).applyInArrow(_first_state, STATE_DDL), "state")

    def sizes(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [unpack(x)[0] for x in b.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([len(x) for x in c], pa.int64())], names=["n", "v"])

    total, vocabulary = (x or 0 for x in counted.mapInArrow(sizes, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    samples, swept = train(state, parts, n, vocabulary)
    states = samples[0][0].withColumn("sample", F.lit(0))
    for k, (x, _, _) in enumerate(samples[1:], 1):
        states = states.unionByName(x.withColumn("sample", F.lit(k)))
    by_word = of_buckets.select(F.col("at").alias("to"), "kind", F.col("to").alias("b"), "block")
    of_words = by_word.groupBy("to").cogroup(states.groupBy("to")).applyInArrow(_tell_words, MAIL_DDL)
    none = F.lit(None).cast("binary")
    by_pair = parts.where(F.col("kind") == ANSWERED).select(F.col("at").alias("q"), F.col("to").alias("b"), "block", none.alias("t"), none.alias("before"))
    of_pairs = by_pair.unionByName(swept.select(F.col("to").alias("q"), F.lit(None).cast("int").alias("b"), "block", "t", "before")).groupBy("q").applyInArrow(_tell_pairs, MAIL_DDL)
    told = of_buckets.unionByName(of_words).unionByName(of_pairs)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return tokens.groupBy("b").cogroup(told.groupBy("to")).applyInArrow(_score(n, parts_n, [x[1:] for x in samples], total, vocabulary), ddl)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
