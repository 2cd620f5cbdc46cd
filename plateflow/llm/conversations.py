"""Operator 12: repair of a conversation's structure by the cheapest edits, the least of equals.

A conversation's roles must read ``(s?(ua)+)?``. A place in the edit graph is a row of the conversation and a state of that pattern;
an arc is an edit (Delete, Insert, Keep, Rerole) with its cost. Minimum costs are found from both ends; an arc is tight (part of some
cheapest repair) where the cost before it, its own and the cost behind it make the whole cost. From the first place a frontier of
places goes along tight arcs, at each step along those of the least letter, which gives the least string of all cheapest repairs.

Spark finds each row's faults in built-in functions and counts equal rows; what a conversation sends to its task is a row's turn,
role and SHA-256. The task holds some sixty bytes a row while it looks for the edits, never a text. The texts that stay come by
once more, in order, and are hashed as they stream past, as SHA-256 of a whole conversation is one chain. A conversation of any
length is done so (its audit is one string, so it must stay under 2^31 edits).

Nulls in conv_id, turn, role or text count as one space (in the damage's key too); rows without conv_id are one conversation. Rows of
a turn come in order of role, then of the SHA-256 of their role and text (equal ones are interchangeable). Roles count by their first
character; an empty role has none and can't be kept. An empty text is blank. Repeated rows are duplicates of the first of them. An
empty table gives an empty result. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.arrow import Batches, slices
from plateflow.llm.common import BLANK, BLANK_CLASS, table

#: Costs of the edits, and what a truncated row costs that is not deleted.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States of the pattern: nothing yet, s, u open, whole pairs. The state behind a user or assistant turn.
START, SYSTEM, USER, PAIRS = range(4)
NEXT = (USER, USER, PAIRS, USER)
#: Where a role's initial may be kept, and where that leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, PAIRS: USER}, "a": {USER: PAIRS}}
ENDS = (0, None, None, 0)
LEGAL = {"su", "ua", "au"}
ROLE = {USER: "user", PAIRS: "assistant"}
#: A state that costs so much more than the best one is never on a cheapest repair (three inserts and a deletion make up for any).
FAR = 200


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after the damage that the task defines; dropped rows stay with 0 copies."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), code.alias("c"), some("role").alias("role"), some("text").alias("text"))
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("c") == 0, 0).when(F.col("c") == 3, 2).otherwise(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds digest (of role and text), blank and cut (truncated, if it is neither blank nor a duplicate)."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    cut = ~F.substring(F.rtrim(F.col("text"), F.lit(BLANK)), -1, 1).isin(".", "!", "?")
    return rows.withColumns({"digest": digest, "blank": ~F.col("text").rlike(f"[^{BLANK_CLASS[1:-1]}]"), "cut": cut})


def _inserts_before(f: list) -> list:
    """Costs of states once inserts are allowed too."""
    f[USER] = min(f[USER], f[START] + INSERT, f[SYSTEM] + INSERT, f[PAIRS] + INSERT)
    f[PAIRS] = min(f[PAIRS], f[USER] + INSERT)
    return f


def _inserts_behind(b: list) -> list:
    b[USER] = min(b[USER], b[PAIRS] + INSERT)
    for q in (START, SYSTEM, PAIRS):
        b[q] = min(b[q], b[USER] + INSERT)
    return b


def _arcs(q: int, initial: str, cut: bool) -> list[tuple[str, int, int]]:
    """letter, cost and next state of the edits of a row in a state."""
    more = TRUNCATED if cut else 0
    out = [("D", DELETE, q)]
    if q in (to := KEPT.get(initial, {})):
        out.append(("K", more, to[q]))
    out.append(("R", REROLE + more, NEXT[q]))
    return out


#: The arcs of each kind of row, from each state.
KINDS = {(i, c): [_arcs(q, i, c) for q in range(4)] for i in ("s", "u", "a", "") for c in (False, True)}
CODES = list(KINDS)


def _packed(costs: list) -> tuple[bytes, int]:
    least = min(costs)
    return bytes(min(c - least, FAR) for c in costs), least


def repair(kinds: bytes) -> tuple[int, Iterator[tuple[int, str, int]]]:
    """The least cost of rows of these kinds (places in CODES), and the least of the cheapest repairs: of each edit the row that it
    is at, its letter and the state behind it. Keeps ten bytes a row."""
    n = len(kinds)
    before, behind, up, down = bytearray(4 * (n + 1)), bytearray(4 * (n + 1)), bytearray(n + 1), bytearray(n + 1)
    f = _inserts_before([0, FAR, FAR, FAR])
    before[:4], low = _packed(f)
    first = low
    for i, k in enumerate(kinds):
        now, g = before[4 * i : 4 * i + 4], [9999] * 4
        for q, arcs in enumerate(KINDS[CODES[k]]):
            if now[q] < FAR:
                for _, cost, to in arcs:
                    g[to] = min(g[to], now[q] + cost)
        before[4 * i + 4 : 4 * i + 8], up[i + 1] = _packed(_inserts_before(g))
    b = _inserts_behind([FAR if x is None else x for x in ENDS])
    behind[4 * n :], low = _packed(b)
    last = low
    for i in range(n - 1, -1, -1):
        now, arcs = behind[4 * i + 4 : 4 * i + 8], KINDS[CODES[kinds[i]]]
        behind[4 * i : 4 * i + 4], down[i] = _packed(_inserts_behind([min(now[to] + cost for _, cost, to in arcs[q]) for q in range(4)]))
    rest = last + sum(down)
    total = first + before[START] + rest + behind[START]

    def least() -> Iterator[tuple[int, str, int]]:
        done, left, i, frontier = first, rest, 0, {START}
        while True:
            step: dict[str, set[int]] = {}
            for q in frontier:
                so_far = done + before[4 * i + q]
                if i < n:
                    for letter, cost, to in KINDS[CODES[kinds[i]]][q]:
                        if so_far + cost + (left - down[i]) + behind[4 * i + 4 + to] == total:
                            step.setdefault(letter, set()).add(to)
                if so_far + INSERT + left + behind[4 * i + NEXT[q]] == total:
                    step.setdefault("I", set()).add(NEXT[q])
            if not step:
                return
            letter = min(step)
            # A letter leads from a place to one place, so a frontier that starts as one place stays one.
            frontier = step[letter]
            yield i, letter, next(iter(frontier))
            if letter != "I":
                done, left, i = done + up[i + 1], left - down[i], i + 1

    return total, least()


class _Conversation:
    """What is kept of a conversation until its last row has come."""

    def __init__(self, key: int | None) -> None:
        self.key, self.kinds, self.deleted, self.turns, self.digests, self.roles, self.known = key, bytearray(), array("q", [0]), [], bytearray(), array("i"), {}
        self.low = self.high = self.now = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, cut: bool, first: bool, copies: int) -> None:
        if turn is not None and turn != self.now:
            self.low, self.high, self.now, self.distinct = turn if self.low is None else self.low, turn, turn, self.distinct + 1
        initial = role[:1]
        self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + copies - 1
        self.initial = initial
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - first
            self.truncated += first and cut
        if blank or not first:
            self.deleted[-1] += copies
            return
        # The first row can stay; the edits of what stands behind it are deletions.
        self.kinds.append(CODES.index((initial if initial in KEPT else "", cut)))
        self.deleted.append(copies - 1)
        self.turns.append(turn)
        self.digests += digest
        self.roles.append(self.known.setdefault(role, len(self.known)))

    def rows(self) -> Iterator[dict]:
        """A row for each text that stays, with the roles inserted before it; at last what is known of the whole."""
        cost, edits = repair(bytes(self.kinds))
        names, pre, at, audit = list(self.known), "", 0, ["D" * self.deleted[0]]
        for i, letter, state in edits:
            audit.append(letter)
            if letter == "I":
                pre += ROLE[state][0]
                continue
            if letter != "D":
                role = names[self.roles[i]]
                yield {"conv_id": self.key, "last": False, "turn": self.turns[i], "role": role, "digest": bytes(self.digests[32 * i : 32 * i + 32]), "pre": pre, "to": role if letter == "K" else ROLE[state]}
                pre = ""
            at = i + 1
            audit.append("D" * self.deleted[at])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        yield {"conv_id": self.key, "last": True, "pre": pre, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": int(self.truncated), "illegal": int(self.illegal), "cost": cost + DELETE * sum(self.deleted), "audit": "".join(audit)}


EDITS = pa.schema([("conv_id", pa.int64()), ("last", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("pre", pa.string()), ("to", pa.string()), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
EDITS_SQL = "conv_id long, last boolean, turn long, role string, digest binary, pre string, to string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _edits(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Sorted rows of conversations to their edits."""
    now, out = None, []

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            yield pa.RecordBatch.from_pylist(out, schema=EDITS)
            out.clear()

    def ended(c: _Conversation) -> Iterator[pa.RecordBatch]:
        for row in c.rows():
            out.append(row)
            yield from ready(4096)

    for b in slices(batches, 4096):
        for key, turn, role, digest, blank, cut, place, copies in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "digest", "blank", "cut", "place", "copies")), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield from ended(now)
                now = _Conversation(key)
            if copies:
                now.add(turn, role, digest, blank, cut, place == 1, copies)
    if now is not None:
        yield from ended(now)
    yield from ready(1)


def edits(rows: DataFrame) -> DataFrame:
    """A row for each text that stays, and one for each conversation (EDITS). rows: of damaged(), or any with its columns."""
    # Equal rows are counted before they move; dropped ones only tell that their conversation exists.
    there = F.col("copies") > 0
    own = lambda c: F.when(there, F.col(c)).alias(c)
    counted = with_faults(rows).select("conv_id", *map(own, ("turn", "role", "digest", "blank", "cut")), "copies").groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies"))
    dealt = counted.repartition("conv_id")
    by = F.expr("row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn NULLS FIRST)")
    return dealt.withColumn("place", by).sortWithinPartitions("conv_id", "turn", "role", "digest").mapInArrow(_edits, EDITS_SQL)


def _repaired(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Edits and texts of conversations in order to one row a conversation; of a text's copies the first is taken."""
    schema = pa.schema([(k, EDITS.field(k).type) for k in ("conv_id", *TOLD)] + [("repaired_sha256", pa.string())])
    chain, some, edit = hashlib.sha256(), False, None

    def line(text: str) -> None:
        nonlocal some
        chain.update((("\n" if some else "") + text).encode())
        some = True

    for b in slices(batches):
        out = []
        for r in b.to_pylist():
            if r["kind"] == 0:
                for k in r["pre"]:
                    line("user:" if k == "u" else "assistant:")
                edit = None if r["last"] else r
                if r["last"]:
                    out.append({k: r[k] for k in ("conv_id", *TOLD)} | {"repaired_sha256": chain.hexdigest()})
                    chain, some = hashlib.sha256(), False
            elif edit is not None and all(r[k] == edit[k] for k in ("conv_id", "turn", "digest")):
                line(f"{edit['to']}:{r['text']}")
                edit = None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """REPAIRED: what each conversation lacked, its cheapest edits, and the hash of what they make of it."""
    found = edits(rows).withColumns({"kind": F.lit(0), "text": F.lit(None).cast("string")})
    kept = with_faults(rows.where("copies > 0")).where("NOT blank")
    texts = kept.select("conv_id", F.lit(False).alias("last"), "turn", "role", "digest", *(F.lit(None).cast(found.schema[k].dataType).alias(k) for k in ("pre", "to", *TOLD)), F.lit(1).alias("kind"), "text")
    both = found.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "last", "turn", "role", "digest", "kind")
    return both.mapInArrow(_repaired, REPAIRED)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, '-') AS ck, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
-- CRC-32 of an ASCII text, bit by bit.
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(k)), lambda i: ascii(substr(k, i, 1))::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS code FROM c),
e AS (SELECT ck, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy) AS i, row_number() OVER (PARTITION BY ck, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS ini FROM e),
f AS (SELECT *, blank OR nth > 1 AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS t, lag(ini) OVER (PARTITION BY ck ORDER BY i) AS prev FROM o),
n AS (SELECT ck, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND nth > 1) AS duplicate, count(*) FILTER (WHERE NOT gone AND cut) AS truncated,
        count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY ck),
-- Cheapest ways to the end behind i rows, from each state: nothing yet, s, an open u, whole pairs.
b AS (SELECT ck, n AS i, 0 AS b0, 10 AS b1, 5 AS b2, 0 AS b3 FROM n UNION ALL
  SELECT ck, i, least(r0, least(r2, r3 + 5) + 5), least(r1, least(r2, r3 + 5) + 5), least(r2, r3 + 5), least(r3, least(r2, r3 + 5) + 5) FROM (
    SELECT b.ck, b.i - 1 AS i, least(2 + b0, CASE WHEN gone THEN 99999999 WHEN ini = 's' THEN least(t + b1, 1 + t + b2) WHEN ini = 'u' THEN t + b2 ELSE 1 + t + b2 END) AS r0, least(2 + b1, CASE WHEN gone THEN 99999999 WHEN ini = 'u' THEN t + b2 ELSE 1 + t + b2 END) AS r1,
      least(2 + b2, CASE WHEN gone THEN 99999999 WHEN ini = 'a' THEN t + b3 ELSE 1 + t + b3 END) AS r2, least(2 + b3, CASE WHEN gone THEN 99999999 WHEN ini = 'u' THEN t + b2 ELSE 1 + t + b2 END) AS r3 FROM b JOIN f ON f.ck = b.ck AND f.i = b.i)),
s AS (SELECT ck, i, unnest([0, 1, 2, 3]) AS q, unnest([b0, b1, b2, b3]) AS left_over FROM b),
w AS (SELECT ck, 0::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS made FROM n UNION ALL
  SELECT ck, CASE WHEN letter = 'I' THEN i ELSE i + 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kq ELSE nq END, audit || letter,
    CASE letter WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) ELSE list_append(made, CASE nq WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN letter = 'I' THEN '' ELSE text END) END FROM (
    SELECT w.*, f.role, f.text, nq, kq, CASE WHEN f.i IS NOT NULL AND 2 + d.left_over = now.left_over THEN 'D' WHEN 5 + ins.left_over = now.left_over THEN 'I' WHEN NOT gone AND kq IS NOT NULL AND t + kp.left_over = now.left_over THEN 'K' WHEN NOT gone AND 1 + t + re.left_over = now.left_over THEN 'R' END AS letter
    FROM (SELECT *, CASE WHEN q = 2 THEN 3 ELSE 2 END AS nq FROM w) w JOIN s now ON now.ck = w.ck AND now.i = w.i AND now.q = w.q JOIN s ins ON ins.ck = w.ck AND ins.i = w.i AND ins.q = nq
    LEFT JOIN (SELECT f.*, q0 AS at, CASE WHEN ini = 's' AND q0 = 0 THEN 1 WHEN ini = 'u' AND q0 IN (0, 1, 3) THEN 2 WHEN ini = 'a' AND q0 = 2 THEN 3 END AS kq FROM f, (SELECT unnest([0, 1, 2, 3]) AS q0)) f ON f.ck = w.ck AND f.i = w.i + 1 AND f.at = w.q
    LEFT JOIN s d ON d.ck = w.ck AND d.i = w.i + 1 AND d.q = w.q LEFT JOIN s kp ON kp.ck = w.ck AND kp.i = w.i + 1 AND kp.q = kq LEFT JOIN s re ON re.ck = w.ck AND re.i = w.i + 1 AND re.q = nq) WHERE letter IS NOT NULL),
z AS (SELECT w.ck, audit, made FROM w JOIN n ON w.ck = n.ck AND w.i = n.n JOIN s ON s.ck = w.ck AND s.i = w.i AND s.q = w.q WHERE left_over = 0)
SELECT u.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.left_over, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM c) u LEFT JOIN n ON n.ck = u.ck LEFT JOIN z ON z.ck = u.ck LEFT JOIN s ON s.ck = u.ck AND s.i = 0 AND s.q = 0"""
