"""Hard negatives and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from plateflow.llm import conversations as c
from plateflow.llm import hard_negatives as h

VECTORS = "vec_id long, embedding array<float>, label int, anchor string, g int, score double"


def plain_negatives(rows):
    use = []
    for i, e, label, *_ in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            use.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in e)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in set(x for x in use if x[0] % 100 == 0):
        scored = sorted((-dot(v, w), j, k) for j, k, w in use if j != i)
        for p, j in [(-s, j) for s, j, k in scored if k == label][:5]:
            near = [(-s, x) for s, x, k in scored if k != label and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(i, j, r + 1, x, p, s) for r, (s, x) in enumerate(near)]
    return sorted(out)


def vectors(seed, n, scale=1.0):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = []
    for i in range(n):
        v = [x + r.gauss(0, 0.4) for x in r.choice(base)] if i % 3 else base[0]
        size = math.sqrt(sum(x * x for x in v))
        out.append((i * 5, [scale * x / size for x in v], i % 10 if i % 4 else 1, "a", 0, 0.0))
    return out


@pytest.mark.parametrize("scale", [2e6])
def test_hard_negatives(spark, scale):
    import numpy as np

    rows = [(i, [float(np.float32(x)) for x in v], *rest) for i, v, *rest in vectors(3, 160, scale)]
    rows += [(None, [1.0] * 6, 1, "a", 0, 0.0), (3, None, 1, "a", 0, 0.0), (4, [1.0, None], 1, "a", 0, 0.0), (8, [float("nan")] * 6, 1, "a", 0, 0.0), (9, [float("inf")], 2, "a", 0, 0.0), (11, rows[0][1], None, "a", 0, 0.0)]
    rows += [rows[20], rows[20], rows[0], (600, rows[1][1][:3], 4, "a", 0, 0.0), (700, [], 5, "a", 0, 0.0), (13, [], 5, "a", 0, 0.0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    expected = plain_negatives(rows)
    assert len(expected) > 40
    assert sorted(map(tuple, h.hard_negatives(df).collect())) == expected


def test_hard_negatives_of_nothing(spark):
    assert h.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert h.hard_negatives(spark.createDataFrame(vectors(1, 20)[1:19], VECTORS)).count() == 0


def test_few_digits_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 2)
    monkeypatch.setattr(h, "ROWS", 7)
    rows = [(i, [round(x * 256) / 256 for x in v], *rest) for i, v, *rest in vectors(4, 120)]
    assert sorted(map(tuple, h.hard_negatives(spark.createDataFrame(rows, VECTORS), 100).collect())) == plain_negatives(rows)


def cheapest(rows, insert=5):
    """All edits by search over increasing costs: rows of (role, forced, cut); the least audit of the cheapest, and what it makes."""
    ok = re.compile("(s?(ua)+)?").fullmatch
    best = None

    def go(i, audit, made, cost):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        seq = "".join(r[:1] or "-" for r, _ in made)
        if not re.fullmatch("s?(ua)*u?", seq):
            return
        if i == len(rows) and ok(seq) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        if cost + insert <= limit:
            for role in ("user", "assistant"):
                go(i, audit + "I", [*made, (role, None)], cost + insert)
        if i < len(rows):
            role, forced, cut = rows[i]
            go(i + 1, audit + "D", made, cost + 2)
            if not forced:
                go(i + 1, audit + "K", [*made, (role, i)], cost + 5 * cut)
                for other in ("user", "assistant"):
                    go(i + 1, audit + "R", [*made, (other, i)], cost + 1 + 5 * cut)

    limit = 2 * len(rows)
    go(0, "", [], 0)
    return best


def plain_repair(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        some = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text, own = some(role), some(text), by.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        n = Counter(faults)
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, made = cheapest([(r, f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, faults, strict=True)])
        text = "\n".join(f"{r}:{'' if i is None else own[i][2]}" for r, i in made)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string, pre string, kind int, audit string"


def made_up(seed, n):
    r = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "four", "", "  \n", "cut off,", "Same. ", "a\nb.", "x" * 300 + ".", None, "Ünï.", "…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "USER"]
    out = []
    for i in range(n):
        kind = r.random()
        for turn in range(r.randint(1, 6)):
            good = ("user", "assistant")[turn % 2]
            role = good if kind < 0.5 else r.choice(roles)
            out.append((i, r.choice([turn, turn, turn, None, 3]) if kind > 0.8 else turn, role, f"Words {r.random()}." if r.random() < 0.5 else r.choice(texts), "p", 1, "z"))
    return out + [(None, 1, "user", "No key.", "p", 1, "z"), (None, None, "assistant", None, "p", 1, "z")]


def test_conversation_repair(spark):
    rows = made_up(7, 220)
    rows += [rows[0]] * 3 + rows[5:8]
    out = sorted(map(tuple, c.repaired(c.damaged(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))).collect()), key=repr)
    assert out == plain_repair(rows)
    assert {x for r in out for x in r[7]} == set("DKR") and any(r[7] == "" for r in out)


def test_cheap_inserts(monkeypatch):
    """At cost 5 a deletion beats any insert; at cost 1 both are chosen among."""
    monkeypatch.setattr(c, "INSERT", 1)
    r, letters = random.Random(3), set()
    for _ in range(300):
        rows = [(r.choice("suax"), r.random() < 0.2) for _ in range(r.randint(0, 5))]
        cost, audit, _ = cheapest([(i, False, cut) for i, cut in rows], 1)
        total, edits = c.repair(bytes(c.CODES.index((i if i in c.KEPT else "", cut)) for i, cut in rows))
        assert (total, "".join(x[1] for x in edits)) == (cost, audit)
        letters |= set(audit)
    assert letters == set("DIKR")


def test_repair_of_nothing(spark):
    assert c.repaired(c.damaged(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = c.repaired(c.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0, "")], CONVERSATIONS))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_of_one_key(spark):
    """Many rows of one conversation, most of them copies, against the costs of a plain shortest path."""
    r = random.Random(2)
    rows = [(5, t // 2, r.choice(["user", "assistant"]), r.choice(["Same.", f"Text {t}.", "cut"]), "", 0, "") for t in range(4000)]
    out = c.repaired(c.damaged(spark.createDataFrame(rows, CONVERSATIONS))).first()
    roles = re.sub("D", "", out.audit)
    assert out.duplicate > 1000 and len(out.audit) == sum(k != "I" for k in out.audit) + out.audit.count("I") and set(roles) <= set("KRI")
    assert 2 * out.audit.count("D") + 5 * out.audit.count("I") + out.audit.count("R") <= out.cost
