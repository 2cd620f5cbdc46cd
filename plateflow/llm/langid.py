"""Operator 2: language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece, fitted by expectation
maximisation on labelled words: a word's probability is the sum over all its segmentations, and a piece's expected count
the sum over those that use it. A text's score in a language is the sum over its words of the forward algorithm's result;
no segmentation is chosen anywhere. Words repeat, so both fitting and scoring work on distinct words with counts.

Fitting takes a bounded sample of labelled rows: of the MAX_LANGS languages with most training documents (equal ones by name)
FIT_DOCS documents each, those with the least hash of their text. All words of these count, whatever their length. Expected
counts are added up on the cluster; the driver holds a number for each piece and language. Everything is scored, whole.

Null texts and texts without a letter (`str.isalpha`) are `und` with score 0; so is everything if no labelled row is left to
learn from. Between languages of equal score the first by name is taken. A word of any length is one lattice; where its probabilities
could leave the range of doubles it is summed in logarithms, with the same result. Rows that share a doc_id are judged each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.llm.arrow import Batches, batch, slices
from plateflow.llm.common import documents, fold, freed, written

FOLDS = 5
FIT_DOCS, MAX_LANGS, ROUNDS = 400, 500, 3
#: Probability of a character that no piece covers, and what each piece gets besides its expected count.
UNKNOWN, PSEUDO = 1e-6, 0.1
#: Decimal digits below 1 within which a word's probabilities are summed as doubles (a product of two must stay within them too).
DIGITS = 140
#: Cells of the lattices that are summed at once.
CELLS = 1 << 21
#: Distinct words that a task remembers at most.
REMEMBERED = 300_000
MARK = "▁"


def read_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


class Model:
    """Per-language probabilities of pieces, languages along the second axis."""

    def __init__(self, pieces: list[str], langs: list[str]):
        #: Other pieces stand in no word.
        self.number = {p: i + 1 for i, p in enumerate(pieces) if p == MARK or p.removeprefix(MARK).isalpha()}
        self.langs, self.longest = langs, max(map(len, self.number), default=1)
        #: Row 0 stands for no piece.
        self.p = np.full((len(pieces) + 1, len(langs)), 1 / max(len(pieces), 1))
        self.p[0] = 0
        self.log_prior = np.zeros(len(langs))

    def lattice(self, words: list[str]) -> np.ndarray:
        """The piece (or 0) of each word of one length, by end - 1 and length - 1."""
        get, n = self.number.get, len(words[0]) + 1
        spans = [(b - k, b) for b in range(1, n + 1) for k in range(1, min(b, self.longest) + 1)]
        out = np.zeros((len(words), n * self.longest), np.int32)
        out[:, [(b - 1) * self.longest + b - a - 1 for a, b in spans]] = [[get(w[a:b], 0) for a, b in spans] for w in (MARK + x for x in words)]
        return out.reshape(len(words), n, self.longest)

    def forward(self, lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of every prefix, for each word and language: the sum over its segmentations. p: of each piece and language."""
        m, n, _ = lattice.shape
        out = np.zeros((m, n + 1, p.shape[1]))
        out[:, 0] = 1
        for b in range(1, n + 1):
            for k in range(1, min(b, self.longest) + 1):
                out[:, b] += out[:, b - k] * p[lattice[:, b - 1, k - 1]]
            out[:, b] += np.where(lattice[:, b - 1].any(axis=1), 0, UNKNOWN)[:, None] * out[:, b - 1]
        return out

    def log_forward(self, lattice: np.ndarray, log_p: np.ndarray, backward: bool = False) -> np.ndarray:
        """forward in logarithms, for words of any length. backward: of every suffix instead."""
        m, n, longest = lattice.shape
        out = np.full((m, n + 1, log_p.shape[1]), -np.inf)
        out[:, n if backward else 0] = 0
        bare = np.where(lattice.any(axis=2), -np.inf, np.log(UNKNOWN))
        for at in range(n - 1, -1, -1) if backward else range(1, n + 1):
            k = np.arange(1, min(n - at if backward else at, longest) + 1)
            ends = at + k if backward else np.full(len(k), at)
            terms = out[:, ends if backward else at - k] + log_p[lattice[:, ends - 1, k - 1]]
            terms[:, 0] = np.logaddexp(terms[:, 0], bare[:, ends[0] - 1, None] + out[:, ends[0] if backward else at - 1])
            out[:, at] = np.logaddexp.reduce(terms, axis=1)
        return out

    @staticmethod
    def deep(p: np.ndarray, letters: int) -> bool:
        """Whether a segmentation of so many letters may be so improbable that doubles do not hold it."""
        least = min(UNKNOWN, p[1:][p[1:] > 0].min(initial=1.0))
        return -np.log10(least) * (letters + 1) > DIGITS

    def groups(self, words: list[str]) -> Iterator[list[str]]:
        """Words of equal length, as many as lattices may have cells at once."""
        for n, group in itertools.groupby(sorted(words, key=len), key=len):
            group, some = list(group), max(1, min(4096, CELLS // ((n + 1) * self.longest)))
            yield from (group[i : i + some] for i in range(0, len(group), some))

    def log_words(self, words: list[str]) -> dict[str, np.ndarray]:
        """Log probability of each word in each language."""
        found, log_p = {}, None
        for some in self.groups(words):
            if self.deep(self.p, len(some[0])):
                if log_p is None:
                    with np.errstate(divide="ignore"):
                        log_p = np.log(self.p)
                found.update(zip(some, self.log_forward(self.lattice(some), log_p)[:, -1], strict=True))
            else:
                found.update(zip(some, np.log(self.forward(self.lattice(some), self.p)[:, -1]), strict=True))
        return found

    def expected(self, counts: dict[str, int], lang: int) -> np.ndarray:
        """How often each piece is expected in these words of a language, over all segmentations."""
        p = self.p[:, [lang]]
        out = np.zeros(len(p))
        with np.errstate(divide="ignore"):
            log_p = np.log(p)
        for some in self.groups(list(counts)):
            x, weight = self.lattice(some), np.array([counts[w] for w in some], float)
            n = x.shape[1]
            if self.deep(p, len(some[0])):
                f, back = self.log_forward(x, log_p)[:, :, 0], self.log_forward(x, log_p, backward=True)[:, :, 0]
                for k in range(1, min(n, self.longest) + 1):
                    use = np.exp(f[:, : n + 1 - k] + log_p[x[:, k - 1 :, k - 1], 0] + back[:, k:] - f[:, n:])
                    np.add.at(out, x[:, k - 1 :, k - 1], weight[:, None] * use)
                continue
            f = self.forward(x, p)[:, :, 0]
            back = np.zeros_like(f)
            back[:, n] = 1
            for b in range(n, 0, -1):
                back[:, b - 1] += np.where(x[:, b - 1].any(axis=1), 0, UNKNOWN) * back[:, b]
                for k in range(1, min(b, self.longest) + 1):
                    through = p[x[:, b - 1, k - 1], 0] * back[:, b]
                    back[:, b - k] += through
                    np.add.at(out, x[:, b - 1, k - 1], weight * f[:, b - k] * through / f[:, n])
        out[0] = 0
        return out

    def predictor(self):
        known: dict[str, int] = {}
        logs = np.zeros((0, len(self.langs)))

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal logs
            counts = [Counter(words_of(t)) if t is not None and self.langs else None for t in texts]
            new = [w for w in set().union(*filter(None, counts)) if w not in known]
            at = len(known)
            if at + len(new) > len(logs):
                logs = np.concatenate([logs, np.zeros((max(at, len(new)), len(self.langs)))])
            for k, (w, x) in enumerate(self.log_words(new).items(), at):
                known[w] = k
                logs[k] = x
            out = []
            for c in counts:
                if not c:
                    out.append(("und", 0.0))
                    continue
                total = self.log_prior + np.fromiter(c.values(), float, len(c)) @ logs[np.fromiter(map(known.__getitem__, c), np.int64, len(c))]
                p = np.exp(total - total.max())
                k = int(total.argmax())
                out.append((self.langs[k], float(p[k] / p.sum())))
            if len(known) > REMEMBERED:  # what came first is frequent: it stays
                for w in new:
                    del known[w]
            return out

        return predict


_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters: marks, digits and symbols tell nothing of the language."""
    found = _LETTERS.findall(text.lower())
    if text.isascii():
        return found
    # The pattern also takes number signs that are no digits, such as a half.
    return [x for w in found for x in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def sampled(docs: DataFrame, fit_docs: int = FIT_DOCS, max_langs: int = MAX_LANGS) -> DataFrame:
    """lang and text of the fit_docs training documents of each language whose texts hash lowest; of documents of one text and language
    one counts. Salted, so that no task gets more than a part of a language, and each passes on fit_docs rows at most."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != 0)).select("lang", "text")
    hashed = rows.select("lang", F.xxhash64("text").alias("h"))
    langs = hashed.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).select("lang")
    hashed = hashed.join(F.broadcast(langs), "lang", "left_semi")
    for part in (F.pmod("h", F.lit(97)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("lang", part).orderBy("h"))
        hashed = hashed.distinct().withColumn("_rank", rank).where(F.col("_rank") <= fit_docs).drop("_rank")
    chosen = hashed.select(F.col("lang").alias("_lang"), F.col("h").alias("_h"))  # max_langs * fit_docs rows at most
    found = rows.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_h")), "left_semi")
    return found.groupBy("lang", F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text")).select("lang", "text")


def fitted(docs: DataFrame, pieces: list[str], fit_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> Model:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
    expected = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("x", pa.float64())])

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
            yield batch(schema, {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())})

    words = sampled(docs, fit_docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()  # max_langs rows at most
    model = Model(pieces, [r["lang"] for r in totals])
    total = np.array([r["n"] for r in totals], float)
    model.log_prior = np.log((total + 1) / (total + 1).sum()) if totals else model.log_prior
    for _ in range(rounds if totals else 0):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages

        def expect(batches: Batches, shared=shared) -> Iterator[pa.RecordBatch]:
            model, counts = shared.value, {}
            for b in batches:
                for lang, word, n in zip(*(b.column(k).to_pylist() for k in ("lang", "word", "n")), strict=True):
                    counts.setdefault(lang, {})[word] = n
            for k, lang in enumerate(model.langs):
                if lang in counts:
                    x = model.expected(counts[lang], k)
                    at = np.flatnonzero(x)
                    yield batch(expected, {"lang": np.full(len(at), k, np.int32), "piece": at.astype(np.int32), "x": x[at]})

        sums = words.mapInArrow(expect, "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toArrow()
        p = np.full(model.p.shape, PSEUDO)
        p[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] += sums.column("x").to_numpy()
        p[0] = 0
        model.p = p / p.sum(axis=0)
    freed(words)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages: the vocabulary is fixed
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if not hasattr(model, "_predict"):  # a Python worker that Spark uses again keeps what it has learnt
            model._predict = model.predictor()
        predict = model._predict
        for b in slices(batches):
            found = predict(b.column("text").to_pylist())
            yield batch(schema, {"doc_id": b.column("doc_id"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    model = fitted(docs, read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return identify(docs, model).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score")
