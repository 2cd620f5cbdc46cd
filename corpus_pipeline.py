"""From raw documents to token ids: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; all but the last
return the columns of documents. The last one's rows: doc_id, n_tokens, token_ids (little-endian unsigned 32-bit), and the
SHA-256 of the ids and of the bytes that they decode to.

Rows without text, or with too few words, end at the quality rules. Of near copies the row of least doc_id stays (a row without one
only if none has one; of rows equal in doc_id the one of least hash). Repeated rows are copies of each other; rows that share a doc_id
but not their text are rows of their own. Texts of any length go whole through each stage. Empty tables give empty results. Further
columns of documents, whatever their names, reach the last stage untouched and end there; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.llm.bpe import public_codec, with_decoded, with_token_ids
from plateflow.llm.common import documents, table, written
from plateflow.llm.decontaminate import remove_documents
from plateflow.llm.line_dedup import line_dedup
from plateflow.llm.quality import quality_filter
from plateflow.llm.simhash import keep_near_first


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects."""
    return quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a later document holds too (if five documents hold them)."""
    return line_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each group of near copies (five-word shingles, similarity .8)."""
    return keep_near_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and what they decode to."""
    codec = public_codec()
    both = with_decoded(with_token_ids(docs.select("doc_id", "text"), codec), codec)
    return both.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: SimHash needs XXH64, which DuckDB lacks: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
