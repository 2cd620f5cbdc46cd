"""What the training-data operators share: reading tables, shared scratch space, hashing and partition counts."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words and is stripped from lines.
BLANK = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one given to setCheckpointDir."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-")  # one machine: tests and benchmarks
    spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/plateflow-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str | list[str], n: int, what: str, deal: bool = True) -> DataFrame:
    """df as a bucketed table in the shared folder: dealt by key once, read in that partitioning as often as needed. deal: False if
    its rows are dealt by key as they come. n: of groups; where Spark allows fewer buckets, a bucket holds several of them (whoever
    reads the table takes them one by one, by their key)."""
    key = [key] if isinstance(key, str) else key
    n = min(n, int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    name = f"plateflow_{what}_{uuid.uuid4().hex}"
    (df.repartition(n, *key) if deal else df).write.bucketBy(n, *key).option("path", f"{shared_dir(df.sparkSession)}/{name}").option("compression", "zstd").saveAsTable(name)
    dropped_shuffles(df.sparkSession)
    return df.sparkSession.table(name)


def freed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark drop the shuffles of finished queries."""
    for t in tables:
        if files := t.inputFiles():
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    if tables:
        dropped_shuffles(tables[0].sparkSession)


def dropped_shuffles(spark: SparkSession) -> None:
    """Spark's cleaner drops the shuffle files of plans that the driver no longer holds, once it has collected its garbage (what the
    last job holds goes at the second time)."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint of a small table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row, also where body's lambdas use it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; rows equal in both are interchangeable."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from a pass that keeps no text."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(spark: SparkSession, total_bytes: int, each_mb: float, spread: bool = True) -> int:
    """As many buckets as keep each near each_mb, whatever the size of the input. spread: but no fewer than Spark's shuffle partitions
    (groups that exchange blocks with each other are best no more than their size asks for)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) if spread else 1, math.ceil(total_bytes / (each_mb * 1e6)))


def bucket(doc_id: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(n)).cast("int")


def fold_of(doc_id: int | None, folds: int) -> int:
    """crc32(doc_id as text) mod folds; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
