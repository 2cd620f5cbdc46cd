"""Small helpers for functions over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

Batches = Iterable[pa.RecordBatch]


def as_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns asked for, and the text as UTF-8 bytes (null stays null)."""
    return docs.select("doc_id", *more, F.col("text").cast("binary").alias("text"))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=schema.field(k).type) for k, x in columns.items()], schema=pa.schema([schema.field(k) for k in columns]))


def slices(batches: Batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that long texts don't pile up."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def per_row(schema: pa.Schema, keep: tuple[str, ...], made: Callable[[], Callable[[object], tuple]], source: str = "text") -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: the kept columns, and what made()'s function makes of each row's source column. made runs once for a task."""
    rest = [x for x in schema.names if x not in keep]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        f = made()
        for b in slices(batches):
            rows = [f(x) for x in b.column(source).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(rest)
            yield batch(schema, {k: b.column(k) for k in keep} | {k: list(v) for k, v in zip(rest, columns, strict=True)})

    return run
