"""Operator 7: line dedup over range-partitioned hashes, with built-in functions only.

Lines of at least min_chars code points (key: stripped, A-Z lower-cased) become two independent 64-bit hashes, 16 bytes
for any length. They are dealt by range of the first hash. Hashes are uniform, so ranges of equal width are even but for lines
that very many documents share; a range with more rows than its share is split further by document. Within its part a line's
rows are sorted by document (largest first), then position, and one pass over them counts documents and tells the largest
one. Parts of a split range merge these sums, a row for each part and key, and get the verdict back by part and key, so that
no task ever holds all rows of a line. What leaves is a keep bitmap for each document that loses lines, compressed to the
64-line words that have a dropped line. No text is shuffled before that.

Null and empty texts are one empty line. Rows with one doc_id count as one document. A null doc_id counts as no document
and is never the largest, so its lines go where the key does. Texts of any length are split whole. An empty table gives empty
results. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.llm.common import BLANK, bucketed, documents, freed, lower_ascii, row_key, written

MIN_CHARS, MIN_DOCS = 40, 5
#: Lines of a part, and how many times its share a range may hold before it is split by document.
PART_LINES, UNEVEN = 1_000_000, 1.5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    key = lambda x: lower_ascii(F.btrim(x, F.lit(BLANK)))
    hashed = F.transform(lines_of(F.col("text")), lambda x, i: F.when(F.char_length(x) >= min_chars, F.struct(i.alias("pos"), key(x).alias("key"))))
    rows = docs.select("doc_id", row_key().alias("rk"), F.explode(F.filter(hashed, lambda x: F.char_length(x["key"]) >= min_chars)).alias("x"))
    return rows.select(F.xxhash64("x.key").alias("h1"), F.xxhash64(F.lit(7), F.col("x.key")).alias("h2"), "doc_id", "rk", "x.pos")


def _dealt(lines: DataFrame) -> DataFrame:
    """lines with r (the range of h1), parts (that the range is split in) and d (the line's part), dealt by r and d."""
    rows = lines.count()
    n = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_LINES))
    ranged = lines.withColumn("r", F.shiftrightunsigned(F.shiftrightunsigned("h1", 33) * F.lit(n), 31))
    sizes = ranged.groupBy("r").agg(F.greatest(F.ceil(F.count("*") / F.lit(max(rows / n * UNEVEN, 1))), F.lit(1)).cast("long").alias("parts"))  # n rows
    document = F.coalesce(F.col("doc_id"), F.col("rk"))  # rows without an id are no document's: they may part
    dealt = ranged.join(F.broadcast(sizes), "r").withColumn("d", F.pmod(F.xxhash64(document), F.col("parts")))
    return bucketed(dealt, ["r", "d"], n, "lines")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, rk, positions of dropped lines for each key; only keys that lose lines."""
    hashed = written(_long_lines(docs, min_chars), "hashed")
    dealt = _dealt(hashed)
    freed(hashed)
    key = ["r", "d", "h1", "h2"]
    streamed = Window.partitionBy(*key).orderBy(F.desc_nulls_last("doc_id"), "pos")
    whole = streamed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(streamed))
    seen = dealt.withColumn("first", first).withColumns({"n_docs": F.count(F.when(F.col("first"), 1)).over(whole), "top": F.first("doc_id").over(whole)})
    alone = seen.where((F.col("parts") == 1) & (F.col("n_docs") >= min_docs)).select("doc_id", "rk", "pos", "top")
    # A split range: a row for each part and key is merged, and the verdict goes back to each part.
    split = dealt.where(F.col("parts") > 1)
    of_parts = split.groupBy("r", "d", "h1", "h2", "parts", "doc_id").agg(F.lit(1).alias("one")).groupBy("r", "d", "h1", "h2", "parts").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("top"))
    merged = of_parts.groupBy("r", "h1", "h2", "parts").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top")).where(F.col("n_docs") >= min_docs)
    verdict = merged.select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("d"), "h1", "h2", "top")
    spread = split.join(verdict, key).select("doc_id", "rk", "pos", "top")
    return alone.unionByName(spread).where(~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "rk", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, rk, n_dropped, and drops: a map from a line's number div 64 to 64 bits, with a bit set for each dropped line."""
    words = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "rk", (F.col("pos") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "rk").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drops"))


def with_kept_text(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """own (a row of docs), kept (its text without the dropped lines, null where nothing goes) and n_dropped."""
    drops = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("drop_id"), F.col("rk").alias("drop_rk"), "n_dropped", "drops")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").alias("id"), row_key().alias("rk"))
    joined = keyed.join(drops, F.col("drop_id").eqNullSafe(F.col("id")) & (F.col("drop_rk") == F.col("rk")), "left")
    stays = lambda _, i: F.coalesce(F.getbit(F.element_at("drops", (i / 64).cast("int")), i % 64), F.lit(0)) == 0
    kept = F.when(F.col("drops").isNotNull(), F.array_join(F.filter(lines_of(F.col("own.text")), stays), "\n"))
    return joined.select("own", kept.alias("kept"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the dropped lines gone from text and n_chars brought in line; texts that lose nothing stay as they are."""
    now = {"text": F.coalesce("kept", F.col("own.text"))}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("kept").isNull(), F.col("own.n_chars")).otherwise(F.char_length("kept")).cast(docs.schema["n_chars"].dataType)
    return with_kept_text(docs, min_chars, min_docs).select(*(now.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_kept_text(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("kept", F.col("own.text"), F.lit(""))
    return out.select("own.doc_id", F.size(lines_of(F.col("own.text"))).cast("long").alias("n_lines"), "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
