"""Small dimensions: registration rules, plate profiles, detector scales and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (name, category, matcher, token, priority).
RULES = [
    ("Military", "Military", "pattern", "^Z[A-Z0-9]+$", 100),
    ("Diplomatic Corps", "Diplomatic", "pattern", "^[0-9]{1,3}DC[0-9A-Z]*$", 95),
    ("International Islamic University Malaysia", "Institution Series", "prefix", "IIUM", 94),
    ("Putrajaya", "Federal Territory", "prefix", "F", 90),
    ("Kuala Lumpur", "Federal Territory", "prefix", "V", 90),
    ("Kuala Lumpur", "Federal Territory", "prefix", "W", 90),
    ("Labuan", "Federal Territory", "prefix", "L", 90),
    ("Perak", "State Series", "prefix", "A", 80),
    ("Selangor", "State Series", "prefix", "B", 80),
    ("Pahang", "State Series", "prefix", "C", 80),
    ("Kelantan", "State Series", "prefix", "D", 80),
    ("Johor", "State Series", "prefix", "J", 80),
    ("Kedah", "State Series", "prefix", "K", 80),
    ("Melaka", "State Series", "prefix", "M", 80),
    ("Negeri Sembilan", "State Series", "prefix", "N", 80),
    ("Pulau Pinang", "State Series", "prefix", "P", 80),
    ("Perlis", "State Series", "prefix", "R", 80),
    ("Sabah", "State Series", "prefix", "S", 80),
    ("Terengganu", "State Series", "prefix", "T", 80),
    ("Sarawak", "State Series", "prefix", "Q", 80),
]

# Fixed values: (name, then target, least and most of aspect, width ratio, height ratio, area ratio).
PROFILES = [
    ("single_line", (4.6, 2.6, 7.2), (0.24, 0.10, 0.62), (0.075, 0.025, 0.14), (0.016, 0.0015, 0.075)),
    ("compact_plate", (2.0, 1.0, 3.4), (0.20, 0.07, 0.32), (0.090, 0.025, 0.18), (0.012, 0.0008, 0.032)),
    ("two_row", (1.8, 1.0, 3.2), (0.20, 0.08, 0.38), (0.12, 0.04, 0.22), (0.013, 0.001, 0.042)),
]
MEASURES = ("aspect", "width_ratio", "height_ratio", "area_ratio")

# Branches of the detector, in the order in which ties are broken.
BRANCHES = ("edge_full", "edge_priority", "dark_priority", "text_priority", "text_dark_priority", "mser_text")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "rule_seq int, name string, category string, matcher string, token string, priority int")


def branches(spark: SparkSession, scales: tuple[float, ...]) -> DataFrame:
    """scale_seq, scale, branch_seq, branch: the passes over an image in order."""
    return spark.createDataFrame([(i, s, j, b) for i, s in enumerate(scales) for j, b in enumerate(BRANCHES)], "scale_seq int, scale double, branch_seq int, branch string")
