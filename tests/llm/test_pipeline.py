"""The pipeline, each stage against a plain version of it on the same rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plateflow.llm import bpe
from tests.llm.test_operators import BENCH, BLANKS, SCHEMA, bench, lower, rows, sf  # noqa: F401


def plain_quality(docs, items):
    def good(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)})
        ls = [x for x in t.split("\n") if x.strip(BLANKS)]
        bare = sum(not any("a" <= c.lower() <= "z" or c > "\x7f" for c in x) for x in w)
        cut, bullets = sum(x.strip(BLANKS).endswith(("...", "…")) for x in ls), sum(x.strip(BLANKS)[0] in "-*•" for x in ls)
        bad = len(w) < 50 or 2 * rep > len(w) or 2 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 2 * (len(ls) - len(set(ls))) > len(ls)
        return not (bad or not 2 * len(w) <= sum(map(len, w)) <= 25 * len(w) or 2 * bare > len(w) or 10 * cut > 3 * len(ls) or 10 * bullets > 9 * len(ls))

    return [(i, t) for i, t in docs if good(t)]


def plain_lines(docs, items):
    key = lambda x: x.strip(BLANKS).encode().lower().decode()
    of = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            of.setdefault(key(x), set()).add(i)
    top = {k: max(d - {None}) for k, d in of.items() if len(k) >= 40 and len(d - {None}) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if top.get(key(x), i) == i) if t is not None else None) for i, t in docs]


def plain_near(docs, items):
    def grams(t):
        w = lower(t).split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    kept = {}
    for r, (i, t) in zip(root, docs, strict=True):
        if r not in kept or (i is None, i or 0) < (kept[r][0] is None, kept[r][0] or 0):
            kept[r] = (i, t)
    return list(kept.values())


def plain_benchmark(docs, items):
    find = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    grams = set()
    for _, t in items:
        w = find(lower(t))
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    hit = lambda w: any(tuple(w[k : k + len(g)]) == g for g in grams for k in range(len(w) - len(g) + 1))
    return [(i, t) for i, t in docs if not hit(find(lower(t)))]


PLAIN = [plain_quality, plain_lines, plain_near, plain_benchmark]


def test_stages_against_plain_ones(spark, sf, rows, bench):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], PLAIN, strict=True):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        got = docs.collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(plain(before, bench), key=repr), name
        assert all((r["items"], r["_kept"], r["b"]) == ("own", 3, "z") and r.n_chars == len(r.text) for r in got)
        sizes.append(len(got))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 0
    codec = bpe.public_codec()
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    expected = sorted(((r.doc_id, np.array(lib.encode_ordinary(r.text), "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect()), key=repr)
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r.doc_id, bytes(r.token_ids), r.decoded_sha256) for r in out), key=repr) == expected


@pytest.mark.parametrize("kind", ["nothing", "nulls"])
def test_pipeline_without_text(spark, tmp_path, kind):
    found = [(None, None, None, None, None, None, None, None), (1, None, "en", None, None, None, None, None), (1, "", "en", None, 0, None, None, None)] if kind == "nulls" else []
    spark.createDataFrame(found, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # Past the quality rules, rows without text are one group of copies.
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    assert docs.count() == (1 if found else 0)
