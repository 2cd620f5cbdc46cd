"""The pictures of a plate that a reader is shown, as a table: which of them a candidate has depends on what is known of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.functions.text import hint_layout

# Fixed values: (name, layout, source, picture) of the variants of a whole plate, of its text alone and of its rows side by side.
WHOLE = [
    ("raw_line", "Line", "full_plate", "raw"),
    ("gray_line", "Line", "full_plate", "gray"),
    ("binary_line", "Line", "full_plate", "bright"),
    ("darkbinary_line", "Line", "full_plate", "dark"),
    ("invgray_line", "Line", "full_plate", "inverse"),
    ("prepared_line", "Line", "full_plate", "prepared"),
    ("raw_block", "Block", "full_plate", "raw"),
    ("gray_block", "Block", "full_plate", "gray"),
    ("invgray_block", "Block", "full_plate", "inverse"),
    ("prepared_block", "Block", "full_plate", "prepared"),
    ("prepared_word", "Word", "full_plate", "prepared"),
]
TEXT_ONLY = [
    ("textonly_line", "Line", "text_only", "gray"),
    ("textonly_binary_line", "Line", "text_only", "bright"),
    ("textonly_darkbinary_line", "Line", "text_only", "dark"),
    ("textonly_prepared_line", "Line", "text_only", "prepared"),
    ("textonly_block", "Block", "text_only", "gray"),
    ("textonly_inv_block", "Block", "text_only", "inverse"),
    ("textonly_prepared_block", "Block", "text_only", "prepared"),
    ("textonly_lefttrim_line", "Line", "text_only_trimmed", "left"),
    ("textonly_lefttrim_block", "Block", "text_only_trimmed", "left_prepared"),
    ("textonly_righttrim_line", "Line", "text_only_trimmed", "right"),
    ("textonly_righttrim_block", "Block", "text_only_trimmed", "right_prepared"),
]
COMPOSITE = [
    ("rowcomposite_line", "Line", "row_composite", "gray"),
    ("rowcomposite_binary_line", "Line", "row_composite", "dark"),
    ("rowcomposite_prepared_line", "Line", "row_composite", "prepared"),
    ("rowcomposite_block", "Block", "row_composite", "gray"),
    ("rowcomposite_inv_block", "Block", "row_composite", "inverse"),
    ("rowcomposite_prepared_block", "Block", "row_composite", "prepared"),
    ("rowcomposite_word", "Word", "row_composite", "prepared"),
]
# Fixed values: (name, layout, picture) of the variants of one row, and of those that expect letters or digits only.
ROW = [("gray_line", "Line", "gray"), ("gray_word", "Word", "gray"), ("prepared_line", "Line", "prepared"), ("prepared_word", "Word", "prepared"), ("binary_dark_line", "Line", "dark"), ("binary_bright_line", "Line", "bright"), ("invgray_line", "Line", "inverse")]
TOP_ROW = [("letters_line", "Line", "prepared"), ("letters_word", "Word", "prepared"), ("letters_binary_line", "Line", "dark")]
LOW_ROW = [("digits_word", "Word", "prepared"), ("digits_line", "Line", "gray"), ("digits_prepared_line", "Line", "prepared"), ("digits_binary_word", "Word", "dark"), ("digits_binary_line", "Line", "dark")]
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _specs(specs: list[tuple[str, str, str, str]]):
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("name", "layout", "source", "picture"), x, strict=True))) for x in specs))


def _row_specs(specs: list[tuple[str, str, str]], characters: str | None = None):
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(kind).alias("layout"), F.lit(p).alias("picture"), F.lit(characters).cast("string").alias("characters")) for n, kind, p in specs))


def plate_variants(candidates: DataFrame, *keys: str) -> DataFrame:
    """keys, attempt (from 1), name, layout, source, picture: the variants of each candidate's plate. candidates: keys, has_text (a
    picture of its text alone is there), has_rows (a picture of its rows side by side). A narrow expansion of at most 29 rows."""
    none = F.slice(_specs(WHOLE), 1, 0)
    every = F.concat(_specs(WHOLE), F.when(F.col("has_text"), _specs(TEXT_ONLY)).otherwise(none), F.when(F.col("has_rows"), _specs(COMPOSITE)).otherwise(none))
    return candidates.select(*keys, F.posexplode(every).alias("i", "v")).select(*keys, (F.col("i") + 1).alias("attempt"), "v.*")


def row_variants(candidates: DataFrame, *keys: str) -> DataFrame:
    """keys, row, attempt, name, layout, picture, characters (null: any): the variants of each row of a plate of two rows or more; on
    a plate known to have two, the first row is also read as letters, the second as digits. candidates: keys, rows (how many row
    pictures there are), layout, profile."""
    two = hint_layout(F.col("layout"), F.col("profile")) == "two_row"
    none = F.slice(_row_specs(ROW), 1, 0)
    each = candidates.where("rows >= 2").select(*keys, two.alias("_two"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row"))
    own = F.when(F.col("_two") & (F.col("row") == 1), _row_specs(TOP_ROW, LETTERS)).when(F.col("_two") & (F.col("row") == 2), _row_specs(LOW_ROW, DIGITS)).otherwise(none)
    return each.select(*keys, "row", F.posexplode(F.concat(_row_specs(ROW), own)).alias("i", "v")).select(*keys, "row", (F.col("i") + 1).alias("attempt"), "v.*")
