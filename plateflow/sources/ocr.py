"""A user's own reader of plates: a function that is run on each picture, inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.functions.text import clamp_confidence

#: From a picture, its layout and the characters to expect (None: any) to the text, its confidence and those of its characters.
Reader = Callable[[bytes, str, str | None], tuple[str, float, list[float] | None]]

#: What a row without a picture says.
NOTHING = "there is no picture"
READ = "text string, conf double, chars array<double>, success boolean, message string"


def attempts_from(pictures: DataFrame, ocr: Reader, picture: str = "content") -> DataFrame:
    """The pictures' other columns with text, conf, chars (both within 0 and 1; percentages are taken as such), success and message. A
    reading that raises an error is a row without success that carries its message, as is one without a picture; the others go on, and so
    does the task. An empty text is no success.
    pictures: a picture (bytes), layout, characters (if there are any) and what else the attempts need, as in `attempts.gathered`."""
    rest = [f for f in pictures.schema if f.name != picture]
    characters = "characters" in pictures.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [READ])

    def one(content: bytes | None, layout: str, expected: str | None) -> tuple:
        if not content:
            return "", 0.0, None, False, NOTHING
        try:
            text, conf, chars = ocr(content, layout, expected)
        except Exception as e:  # noqa: BLE001  whatever a user's function raises is this row's own
            return "", 0.0, None, False, str(e) or type(e).__name__
        text = (text or "").strip()
        return text, float(conf or 0.0), None if chars is None else [float(c) for c in chars], text != "", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.string())
        for b in batches:
            for k in range(0, b.num_rows, 64):  # pictures are large
                part = b.slice(k, 64)
                expected = part.column("characters").to_pylist() if characters else [None] * part.num_rows
                rows = [one(*x) for x in zip(part.column(picture).to_pylist(), part.column("layout").to_pylist(), expected, strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in rest] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.name for f in rest] + ["text", "conf", "chars", "success", "message"])

    found = pictures.mapInArrow(run, schema)
    return found.withColumns({"conf": F.get(clamp_confidence(F.array("conf")), F.lit(0)), "chars": clamp_confidence(F.col("chars"))})
