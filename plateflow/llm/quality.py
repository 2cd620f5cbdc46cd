"""Operator 10: quality rules as a short-circuit cascade, with built-in functions only.

Each rule is a Boolean column over the text and its words. On a random sample (SAMPLE_ROWS rows or so, from all of the table) one
job finds which rules reject a row together, and how many characters, words and lines these rows have. A rule's cost on a row is
estimated from these numbers and the fixed prices of its steps, so that the order is the same in each run, whatever else the machines
do. The planner takes the rule with the most rejections per cost, then the next one by what the rules before leave over, and so
on. The cascade is one CASE expression, which Spark evaluates from the left and leaves at the first rule that rejects, so the
order changes the work but never the result. Rules that rank equal go by cost, then by name.

Nulls and empty texts have no words and are rejected by ``too_few_words``. Repeated rows are judged each for itself. Texts of any
length are judged whole. An empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.common import BLANK, BLANK_CLASS, documents, let

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The method's own thresholds: symbols for 100 words, repeated lines for 100 lines with a word, mean length of words.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MEAN_WORD = 50, 50, (2, 25)
#: Percent of lines that are list items, of lines that break off, of words without a letter.
MAX_BULLET_PERCENT, MAX_CUT_PERCENT, MAX_LETTERLESS_PERCENT = 90, 30, 50
#: So many repeated windows in a text are looked up one by one; the count is the same either way.
LOOKUP = 32
#: Rows that the planner measures rules on, about, and the seed of their choice.
SAMPLE_ROWS, SEED = 2000, 10


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), "")


def word_chars(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.char_length(text) - F.regexp_count(text, F.lit(BLANK_CLASS))).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the ascending starts: each adds what lies before the next one, at most three."""
    return let(starts, lambda p: F.aggregate(F.transform(p, lambda a, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - a, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b))


def _starts_by_sort(grams: Column) -> Column:
    equal = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: equal(s, x, j - 1) | equal(s, x, j + 1)), lambda x: x["i"])))


def _starts_by_lookup(grams: Column, twice: Column) -> Column:
    return F.array_compact(F.transform(grams, lambda h, i: F.when(F.array_contains(twice, h), i)))


def n_repeat_words(ws: Column) -> Column:
    """Windows are compared by hash. Few repeated hashes are looked up for each window, many are found by sorting windows."""

    def repeated(g: Column) -> Column:
        twice = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j - 1))))
        return let(twice, lambda t: _covered(F.when(F.size(t) <= LOOKUP, _starts_by_lookup(g, t)).otherwise(_starts_by_sort(g))))

    def of(w: Column) -> Column:
        grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(repeated(g)))

    return let(ws, of)


def _share_of_lines(text: Column, hit: Callable[[Column], Column], percent: int) -> Column:
    return let(worded_lines(text), lambda x: F.size(F.filter(x, hit)) * 100 > F.size(x) * percent)


def is_bullet(line: Column) -> Column:
    return line.rlike(r"^[\x20\x09-\x0D]*[-*\x{2022}]")


def is_cut(line: Column) -> Column:
    return let(F.btrim(line, F.lit(BLANK)), lambda x: x.endswith("...") | x.endswith("\u2026"))


def has_no_letter(word: Column) -> Column:
    return ~word.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")


def _word_length(text: Column, w: Column) -> Column:
    return let(word_chars(text), lambda c: (c < F.size(w) * MEAN_WORD[0]) | (c > F.size(w) * MEAN_WORD[1]))


#: Of each rule, from a text and its words: whether it rejects.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "too_few_words": lambda t, w: F.size(w) < MIN_WORDS,
    "repeated_words": lambda t, w: n_repeat_words(w) * 100 > F.size(w) * MAX_REPEAT_PERCENT,
    "symbols": lambda t, w: n_symbols(t) * 100 > F.size(w) * MAX_SYMBOL_PERCENT,
    "repeated_lines": lambda t, w: let(worded_lines(t), lambda x: n_dup_lines(x) * 100 > F.size(x) * MAX_DUP_LINE_PERCENT),
    "word_length": _word_length,
    "bullet_lines": lambda t, w: _share_of_lines(t, is_bullet, MAX_BULLET_PERCENT),
    "cut_lines": lambda t, w: _share_of_lines(t, is_cut, MAX_CUT_PERCENT),
    "letterless_words": lambda t, w: F.size(F.filter(w, has_no_letter)) * 100 > F.size(w) * MAX_LETTERLESS_PERCENT,
}
#: Of each rule: nanoseconds a text, a character, a word and a line, as measured once (only their proportions matter).
PRICES: dict[str, tuple[float, float, float, float]] = {
    "too_few_words": (20, 0, 0, 0),
    "repeated_words": (100, 0, 1500, 0),
    "symbols": (50, 15, 0, 0),
    "repeated_lines": (100, 12, 0, 150),
    "word_length": (50, 50, 0, 0),
    "bullet_lines": (100, 12, 0, 250),
    "cut_lines": (100, 12, 0, 300),
    "letterless_words": (100, 0, 370, 0),
}
#: The price of a rule whose count is there already.
READY = (20, 0, 0, 0)


def measure(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[frozenset[str], int, int, int, int]]:
    """Of the sample, by which rules reject a row: how many rows, their characters, words and lines. At most a row for each set of rules."""
    total = docs.count()
    t = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.sample(fraction=rows / total, seed=SEED) if total > rows else t
    names = list(RULES)
    split = t.select("t", words(F.col("t")).alias("w"))
    bits = [F.when(RULES[k](F.col("t"), F.col("w")), 1 << i).otherwise(0) for i, k in enumerate(names)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    lines = F.regexp_count("t", F.lit("\n")) + 1
    found = split.select(mask.alias("mask"), F.char_length("t").alias("c"), F.size("w").alias("n"), lines.alias("l")).groupBy("mask").agg(F.count("*").alias("rows"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("l").alias("l")).collect()
    return [(frozenset(k for i, k in enumerate(names) if r["mask"] >> i & 1), r["rows"], r["c"], r["n"], r["l"]) for r in found]


def cascade_order(measured: list[tuple[frozenset[str], int, int, int, int]], ready: frozenset[str] = frozenset(), done: frozenset[str] = frozenset()) -> list[str]:
    """The rules but those done before the cascade, each chosen by rejections per cost among the rows that the ones before leave."""
    left, order, rest = [x for x in measured if not x[0] & done], [], set(RULES) - done
    while rest:

        def rank(name: str) -> tuple[float, float, str]:
            cost = sum(sum(a * b for a, b in zip(READY if name in ready else PRICES[name], x[1:], strict=True)) for x in left)
            return -sum(x[1] for x in left if name in x[0]) / max(cost, 1), cost, name  # noqa: B023

        order.append(min(rest, key=rank))
        rest.remove(order[-1])
        left = [x for x in left if order[-1] not in x[0]]
    return order


def cascade(text: Column, order: list[str]) -> Column:
    """The name of the first rule that rejects, or null. The text is split into words once."""

    def of(w: Column) -> Column:
        out = F.when(RULES[order[0]](text, w), F.lit(order[0]))
        for name in order[1:]:
            out = out.when(RULES[name](text, w), F.lit(name))
        return out

    return let(words(text), of)


def quality_filter(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows that no rule rejects, with their columns as they are."""
    order = order or cascade_order(measure(docs, text))
    return docs.where(cascade(F.col(text), order).isNull())


def quality_features(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, the contract's counts, and the verdict. Rules over counts read them; the others look at a text only if no rule before
    them has rejected it."""
    text = F.col("text")
    counted = docs.select("doc_id", "text", let(words(text), lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"))).alias("w"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), let(worded_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), n_dup_lines(x).alias("dup"))).alias("l"))
    x = counted.select("doc_id", "text", F.col("w.w").alias("ws"), "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"))
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    ready = {
        "symbols": F.col("n_symbols") * 100 > n * MAX_SYMBOL_PERCENT,
        "repeated_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT,
        "word_length": (F.col("word_chars") < n * MEAN_WORD[0]) | (F.col("word_chars") > n * MEAN_WORD[1]),
    }
    base = frozenset({"too_few_words", "repeated_words"})
    order = [k for k in order or cascade_order(measure(docs), frozenset(ready), base) if k not in base]
    verdict = F.when(failed, False)
    for name in order:
        verdict = verdict.when(ready[name] if name in ready else RULES[name](F.coalesce("text", F.lit("")), F.col("ws")), False)
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict.otherwise(True).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_features(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM
      (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) o(k) WHERE n >= 2 GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(list_concat([''], ws), 'string_agg', ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]'))) AS n_bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS n_cut,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS n_letterless
      FROM w LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 100 * n_bullets > 90 * n_lines OR 100 * n_cut > 30 * n_lines OR 100 * n_letterless > 50 * n_words) AS kept
FROM f"""
