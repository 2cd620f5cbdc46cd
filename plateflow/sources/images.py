"""Sources: image files, annotations and manifests. All are lazy scans of Spark's own readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.operators.evaluate import first_annotation

ANNOTATIONS = "image_name string, vehicle_type string, plate_category string, expected_text string, expected_state string, bbox_x int, bbox_y int, bbox_w int, bbox_h int, notes string"


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, name (without folder and ending), length, content of jpg, jpeg, png and bmp files, folders searched deeply.
    A selection that leaves out content never reads it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp)$"))
    return found.select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), "length", "content")


#: What is wrong with a file that gives no picture.
MISSING, UNREADABLE, BROKEN = "there is no such file or folder", "the file cannot be read", "the file is not a whole picture"


def whole_picture(content: Column) -> Column:
    """Whether bytes begin and end as a whole jpg, png or bmp file does (a bmp file holds its own length)."""
    part = lambda at, n: F.hex(F.substring(content, at, n))
    last = lambda n: F.hex(F.substring(content, -n, n))
    jpg = (part(1, 3) == "FFD8FF") & (last(2) == "FFD9")
    png = (part(1, 8) == "89504E470D0A1A0A") & (last(8) == "49454E44AE426082")
    length = F.conv(F.concat(*(part(i, 1) for i in (6, 5, 4, 3))), 16, 10).cast("long")
    bmp = (part(1, 2) == "424D") & (length <= F.length(content))
    return F.coalesce(jpg | png | bmp, F.lit(False))


def read_pictures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, name, length, content, error of the files of read_images, and of each path given that is not there: a file that is
    missing, cannot be read or is broken off is a row with its error and no content, and the others go on (Spark's scan does not list files of no length). paths: files or
    folders."""
    out = spark.createDataFrame([], "path string, name string, length long, content binary, error string")
    for path in [paths] if isinstance(paths, str) else paths:
        try:
            listed = read_images(spark, path).drop("content")
        except AnalysisException:
            out = out.unionByName(spark.createDataFrame([(path, path.rpartition("/")[2].rpartition(".")[0], None, None, MISSING)], out.schema))
            continue
        # A file that fails while it is read is left out by the scan and missed afterwards.
        scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)
        both = listed.join(scan.select("path", "content"), "path", "left")
        error = F.when(F.col("content").isNull(), UNREADABLE).when(~whole_picture(F.col("content")), BROKEN)
        out = out.unionByName(both.withColumn("error", error).withColumn("content", F.when(F.col("error").isNull(), F.col("content"))))
    return out


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=ANNOTATIONS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image_path, expected_text; other columns are left out. Raises ValueError at once if one of the two is missing."""
    found = spark.read.csv(path, header=True)
    if missing := [c for c in ("image_path", "expected_text") if c not in found.columns]:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    return found.select("image_path", "expected_text")


def image_paths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """read_images without the content; raises ValueError at once if there is no image."""
    found = read_images(spark, paths).drop("content")
    if found.isEmpty():
        raise ValueError("there is no image of a supported kind")
    return found


def annotated_images(spark: SparkSession, paths: str | list[str], annotations: str) -> DataFrame:
    """Images (without their content) with the first annotation of their name, null where there is none. The order in the file is
    that of Spark's reading of it."""
    rows = read_annotations(spark, annotations).withColumnRenamed("image_name", "name").withColumn("_line", F.monotonically_increasing_id())
    return first_annotation(read_images(spark, paths).drop("content"), rows, "name", "_line").drop("_line")
