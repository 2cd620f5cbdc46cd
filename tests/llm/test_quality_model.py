"""The quality classifier: its pieces against plain versions, and its accuracy on rows that it has not learned from."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plateflow.llm import quality_model as q

DOCS = "doc_id long, text string, lang string, source string, held_out string, score int, label string, part string"
LABELS = "doc_id long, quality int, toxic int"


def prose(r, n):
    parts = ["th", "ing", "er", "ly", "ea", "ous", "on", "é"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) + r.choice(["", "", ".", ","]) for _ in range(n))


def junk(r, n):
    kind = r.randrange(3)
    words = prose(r, n).split()
    if kind == 0:
        return " ".join(w + "$$$" for w in words)
    return " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join([words[0]] * n)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, d = random.Random(4), str(tmp_path_factory.mktemp("quality"))
    docs, labels = [], []
    for i in range(400):
        good = i % 5 > 0
        docs.append((i, prose(r, r.randint(30, 200)) if good else prose(r, 20) + "\n" + junk(r, 80)))
        labels.append((i, int(good), 0))
    docs += [(500, None), (501, ""), (None, docs[0][1]), (0, docs[0][1]), (0, docs[1][1]), (502, "x" * 3_000_000), (503, prose(r, 300_000)), (504, " \n\t"), (505, "é" * 50)]
    labels += [(5, 0, 0), (7, 1, 0), (7, 1, 0), (None, 1, 0), (900, 1, 1), (500, None, None), (501, 3, 0)]
    spark.createDataFrame([(*x, "xx", "s", "no", 3, "l", "p") for x in docs], DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{d}/labels.parquet")
    return d, docs


def test_held_out_accuracy(spark, tables):
    d, docs = tables
    out = q.op13_quality_classifier(spark, d).collect()
    assert sorted(repr(r.doc_id) for r in out) == sorted(repr(i) for i, _ in docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and 0 < r.doc_id < 400]
    assert len(held) > 60 and sum(r.predicted == (r.doc_id % 5 > 0) for r in held) >= 0.97 * len(held)
    same = [r.score for r in out if r.doc_id in (500, 501, 504)]
    assert len(set(same)) == 1


@pytest.mark.parametrize("kind", ["none", "one", "empty"])
def test_labels_of_one_kind(spark, tmp_path, kind):
    r = random.Random(1)
    rows = [] if kind == "empty" else [(i, prose(r, 20), "", "", "", 0, "", "") for i in range(12)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)] if kind == "one" else [], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = q.op13_quality_classifier(spark, str(tmp_path)).collect()
    assert [x.score for x in out] == [1.0 if kind == "one" else 0.5] * len(rows)


def test_words_and_shapes():
    _, letters, shapes = q.words_of(np.frombuffer(" Das DAS das!! a$$$\tÉa éa 12 ||".encode(), np.uint8))
    assert len(letters) == 8 and letters[0] == letters[1] == letters[2] and letters[4] != letters[5] and letters[7] == 0
    same = lambda a, b: q.words_of(np.frombuffer(a, np.uint8))[2][0] == q.words_of(np.frombuffer(b, np.uint8))[2][0]
    assert same(b"DAS!!", b"EINS!!!") and same("élan,".encode(), b"a,") and not same(b"Das", b"das") and len(set(shapes)) == 7


def test_contexts_against_a_plain_sum(monkeypatch):
    monkeypatch.setattr(q, "PIECE", 40)
    r = random.Random(2)
    texts = [prose(r, 7).encode() for _ in range(9)] + [b"", None, b"!!", b"one"]
    got = np.concatenate([np.frombuffer(b.column("sums")[0].as_py(), "<f4").reshape(-1, q.WIDTH) for b in q.contexts([pa.record_batch([pa.array(texts, pa.binary())], names=["text"])])])
    expected, plain = np.zeros((q.BUCKETS, q.WIDTH)), q.dense_index(np.arange(q.BUCKETS))
    for t in texts:
        words = [w for w in re.findall(rb"[^\x20\x09-\x0D]+", t or b"") if re.search(rb"[0-9A-Za-z\x80-\xff]", w)]
        ids = [int(q.words_of(np.frombuffer(w, np.uint8))[1][0] % np.uint64(q.BUCKETS)) for w in words]
        # A text over PIECE bytes is cut between words: contexts end there.
        at, begins = 0, []
        for piece in (x for data, b, _ in q.chunks([t]) for x in np.split(data, b[1:])):
            n = len([w for w in re.findall(rb"[^\x20\x09-\x0D]+", piece.tobytes()) if re.search(rb"[0-9A-Za-z\x80-\xff]", w)])
            begins += [at] * n
            at += 1
        for i in range(len(ids)):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j and begins[i] == begins[j]:
                    expected[ids[i]] += plain[ids[j]]
    assert np.allclose(got, expected, atol=1e-5)


def test_pooling_does_not_depend_on_batches():
    r = random.Random(3)
    pool = q.Pool(np.random.default_rng(0).normal(size=(q.BUCKETS, 2 * q.WIDTH)))
    texts = [(prose(r, r.randint(0, 200)) if r.random() < 0.6 else junk(r, 90)).encode() for _ in range(30)] + [b"", None]
    assert np.allclose(pool(texts), np.concatenate([pool([t]) for t in texts]), atol=1e-4)
    assert (pool([None]) == 0).all() and pool([]).shape == (0, q.POOLED)


def test_temperature():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = (r.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = q.Network().fit(x, y, np.arange(3000) % 5 == 0)
    p = net(x[::5])
    assert abs(p.mean() - y[::5].mean()) < 0.05 and all(abs(y[::5][(p >= a) & (p < a + 0.25)].mean() - p[(p >= a) & (p < a + 0.25)].mean()) < 0.12 for a in (0, 0.25, 0.5, 0.75))
