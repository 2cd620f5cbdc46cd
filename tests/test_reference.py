"""The plate operators: each query against its SQL, and the semantics that are easy to get wrong."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plateflow import mask_queries  # noqa: F401  adds its queries to the others
from plateflow.functions import arrays, geometry, layout, text
from plateflow.operators import attempts, detect, evaluate, repair, rerank
from plateflow.queries import QUERIES, SQL
from plateflow.settings import DEFAULTS, settings
from plateflow.sources import images

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = duck.sql(SQL[name])
    assert columns == sorted(expected.columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({SQL[name]})").fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("plate", "state"), [("BPK1234", "Selangor"), ("KAA9876", "Kedah"), ("Z1234", "Military"), ("Z", "Unknown"), ("12DC88", "Diplomatic Corps"), ("SJ230R", "Sabah"), ("IIUM6763", "International Islamic University Malaysia"), ("", "Unknown"), ("bpk1234", "Unknown")])
def test_state(spark, plate, state):
    assert one(spark, text.identify_state(text.norm(F.lit(plate))))["name"] == state


def test_norm_deletes_lower_case(spark):
    assert one(spark, text.norm(F.lit("bpK 12-34"))) == "K1234"
    assert one(spark, text.norm(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    ("plate", "confidence", "layout", "attempted", "repaired"),
    [("8PKI23O", 0.42, "two_row", [], "BPK1230"), ("SJ230R", 0.91, "single_line", [], "SJ230R"), ("LTI6763", 0.48, "single_line", ["LTI6763", "LLUN6763"], "IIUM6763"), ("VEB55", 0.58, "two_row", [], "VEB55"), ("", 0.1, "two_row", ["", "BPK1230"], "")],
)
def test_repair_goldens(spark, plate, confidence, layout, attempted, repaired):
    df = spark.createDataFrame([(1, plate, attempted)], "k int, t string, a array<string>").withColumn("gain", text.least_gain(F.lit(confidence), F.lit(layout)))
    r = repair.repaired(df, "k", "t", "gain", "a").first()
    assert (r["text"], r["changed"], r["label"]) == (repaired, repaired != plate, "pattern_repair" if repaired != plate else "")


def test_repair_bonus_goes_by_the_matched_rule(spark):
    # By hand: a pattern rule's token has several characters, so Z and DC plates gain .22 as IIUM ones do; a one-letter prefix none.
    bonus = lambda t: one(spark, text.prefix_bonus(text.rule_number(F.lit(t))))
    assert [bonus(t) for t in ("ZA1234", "12DC88", "IIUM6763", "BPK1234", "?")] == [0.22, 0.22, 0.22, 0.0, 0.0]
    df = spark.createDataFrame([(1, "2A1234")], "k int, t string").withColumn("gain", F.lit(0.03))
    r = repair.repaired(df, "k", "t", "gain").first()
    assert r["text"] == "ZA1234" and math.isclose(r["score"], 0.9578 + 0.22, abs_tol=1e-9)


def test_boxes(spark):
    a, b = geometry.box(0, 0, 10, 10), geometry.box(5, 0, 10, 10)
    assert math.isclose(one(spark, geometry.iou(a, b)), 1 / 3)
    assert one(spark, geometry.iou(geometry.box(0, 0, 0, 0), geometry.box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.overlap(a, geometry.box(2, 2, 2, 2))) == 1
    assert one(spark, geometry.union_box(F.array(a, b))).asDict() == {"x": 0, "y": 0, "w": 15, "h": 10}


def test_runs(spark):
    mask = F.array(*(F.lit(bool(x)) for x in (1, 1, 0, 1, 0, 0, 1)))
    assert [tuple(r) for r in one(spark, arrays.runs(mask))] == [(1, 2), (4, 4), (7, 7)]
    assert [tuple(r) for r in one(spark, arrays.merge_runs(arrays.runs(mask), 1))] == [(1, 4), (7, 7)]
    assert one(spark, arrays.runs(F.array().cast("array<boolean>"))) == []
    assert one(spark, arrays.merge_runs(arrays.runs(F.array(F.lit(False))), 1)) == []


def test_nms_keeps_the_earlier_of_equals(spark):
    rows = [(1, 2, (0.0, 0.0, 10.0, 10.0), 0.5), (1, 1, (0.0, 0.0, 10.0, 10.0), 0.5), (1, 3, (50.0, 0.0, 10.0, 10.0), 0.1)]
    c = spark.createDataFrame(rows, "image int, seq int, box struct<x:double,y:double,w:double,h:double>, score double")
    assert [e["seq"] for e in detect.nms(c).first()["kept"]] == [1, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    assert sorted(r["name"] for r in images.read_images(spark, str(tmp_path)).collect()) == ["a", "b"]
    (tmp_path / "m.csv").write_text("image_path,expected_text,more\na.jpg,BPK1234,1\n")
    assert [tuple(r) for r in images.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("a.jpg", "BPK1234")]
    (tmp_path / "n.csv").write_text("image_name,expected_text\na.jpg,BPK1234\n")
    with pytest.raises(ValueError, match="image_path"):
        images.read_manifest(spark, str(tmp_path / "n.csv"))


def test_first_annotation_and_match(spark):
    a = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "name string, line int, expected string")
    i = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted((r["name"], r["expected"]) for r in evaluate.first_annotation(i, a, "name", "line").collect()) == [("a", "y"), ("b", None)]
    m = spark.createDataFrame([("B 1", "B1"), ("", ""), ("B1", None)], "e string, r string")
    assert [r["matched"] for r in evaluate.matched(m, "e", "r").collect()] == [True, False, False]


ATTEMPTS = "cand int, seq int, name string, source string, layout string, text string, conf double, success boolean"
HINTS = "cand int, layout string, profile string, rows array<struct<text:string,conf:double>>"


def read(spark, tries, layout="", profile="single_line", rows=None):
    a = spark.createDataFrame([(1, i, f"n{i}", *x, True) for i, x in enumerate(tries)], ATTEMPTS)
    return attempts.recognised(a, spark.createDataFrame([(1, layout, profile, rows)], HINTS)).first()


def pick(spark, tries):
    a = spark.createDataFrame([(1, i, f"n{i}", *x, True) for i, x in enumerate(tries)], ATTEMPTS)
    return attempts.chosen(a, spark.createDataFrame([(1, "", "single_line", None)], HINTS)).first()["text"]


def test_a_weak_suffix_goes_if_two_attempts_lack_it(spark):
    # By hand: 1.15 + .12 for the first; 1.16 for the others, which is no less than 1.27 - .12.
    tries = [("text_only", "Line", "BPK1234R", 0.35), ("full_plate", "Block", "BPK1234", 0.12), ("full_plate", "Block", "bpBPK1234", 0.12)]
    r = read(spark, tries)
    assert (r["text"], r["variant"], r["pattern"]) == ("BPK1234", "n1+trim_weak_suffix", "L3-D4-S0")
    # The choice alone: one attempt without it is too few, and a better reading of the letter is believed.
    assert pick(spark, tries) == "BPK1234" and pick(spark, tries[:2]) == "BPK1234R"
    assert pick(spark, [("text_only", "Line", "BPK1234R", 0.36), *tries[1:]]) == "BPK1234R"


def test_a_supported_attempt_wins_on_two_rows(spark):
    tries = [("row_composite", "Line", "BPK1234", 0.9), ("text_only", "Line", "BPX1234", 0.3), ("text_only_trimmed", "Line", "BPX1234", 0.3)]
    r = read(spark, tries, "two_row")
    assert (r["text"], r["variant"]) == ("BPX1234", "n1+attempt_support")
    assert read(spark, tries)["text"] == "BPK1234"
    assert read(spark, tries[:2], "two_row")["text"] == "BPK1234"


def test_rows_are_joined_and_mixed(spark):
    rows = [("BPK", 0.8), ("1234", 0.6)]
    r = read(spark, [("full_plate", "Line", "BP", 0.5)], "two_row", rows=rows)
    assert (r["text"], r["variant"]) == ("BPK1234", "rowwise_combo") and math.isclose(r["confidence"], 0.7)
    # Letters of the best attempt and digits of the second row make a better text than the rows themselves.
    r = read(spark, [("text_only", "Block", "BPK", 0.9)], "two_row", rows=[("", 0.0), ("1234", 0.9)])
    assert (r["text"], r["variant"]) == ("BPK1234", "hybrid_two_row")
    assert read(spark, [("text_only", "Line", "", 0.9)])["text"] == ""


def test_refinement_trims(spark):
    got = lambda t, c: tuple(one(spark, text.refined(F.lit(t), F.lit(c))))
    assert got("BK1234XY", 0.9) == ("BK1234X", "trim_tail")
    # Trimmed to eight characters, it gains .24 * .18 by another one: more than .02 at equal priority.
    assert got("BPK1234XY", 0.9) == ("PK1234X", "trim_head")
    assert got("BPK1234X", 0.2) == ("BPK1234", "trim_weak_suffix")
    assert got("BPK1234", 0.2) == ("BPK1234", "")
    assert got("YV1234", 0.9) == ("V1234", "trim_head")
    assert got("", 0.9) == ("", "")


def test_settings_are_laid_over_the_defaults(spark):
    own = settings({"detection": {"valid": {"width_ratio": (0.5, 0.6)}, "keep": 3}, "report": 7})
    assert own["detection"]["valid"] == {**DEFAULTS["detection"]["valid"], "width_ratio": (0.5, 0.6)}
    assert (own["detection"]["keep"], own["report"], DEFAULTS["detection"]["keep"], own["reranking"]) == (3, 7, 40, DEFAULTS["reranking"])
    row = spark.createDataFrame([(0.01, 0.55, 0.1, 0.5, 0.05)], "area_ratio double, width_ratio double, height_ratio double, extent double, solidity double")
    assert detect.valid(row, own).count() == 0  # solidity is under .10
    assert detect.valid(row.withColumn("solidity", F.lit(0.1)), own).count() == 1


def test_layout_of_two_rows(spark):
    boxes = F.array(*(geometry.box(20 + 30 * i, y, 12, 20) for y in (10, 60) for i in range(3)))
    e = one(spark, layout.layout_evidence(boxes, 100.0))
    assert (e["count"], e["rows"], e["layout"], e["density"]) == (6, 2, "two_row", 1.0) and math.isclose(e["two"], 1.0)
    e = one(spark, layout.layout_evidence(F.slice(boxes, 1, 3), 100.0))
    # One row: even middles, heights and gaps all count 1.
    assert (e["rows"], e["layout"], e["single"], e["alignment"]) == (1, "single_line", 1.0, 1.0)
    assert one(spark, layout.layout_evidence(F.slice(boxes, 1, 0), 100.0))["layout"] == "unknown"


def test_clamped_confidences(spark):
    assert one(spark, text.clamp_confidence(F.array(F.lit(50.0), F.lit(120.0), F.lit(-3.0)))) == [0.5, 1.0, 0.0]
    assert one(spark, text.clamp_confidence(F.array(F.lit(0.5), F.lit(1.0)))) == [0.5, 1.0]


def test_candidates_of_branches_are_united_and_completed(spark):
    a = spark.createDataFrame([(1, 1, "edge_full")], "image int, seq int, branch string")
    both = rerank.normalised(detect.united(a, a.withColumn("seq", F.lit(2))))
    assert both.count() == 2 and {both.first()[k] for k in ("profile", "layout")} == {"unknown"} and both.first()["empty"] == 1.0


def test_images_by_path_must_exist(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    assert images.image_paths(spark, str(tmp_path)).count() == 1
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no image"):
        images.image_paths(spark, str(tmp_path / "none"))


def test_images_with_their_annotations(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "l.csv").write_text("image_name,vehicle_type,plate_category,expected_text,expected_state,bbox_x,bbox_y,bbox_w,bbox_h,notes\na,car,x,BPK1234,Selangor,1,2,3,4,\na,car,x,SECOND,Selangor,1,2,3,4,\n")
    found = images.annotated_images(spark, str(tmp_path), str(tmp_path / "l.csv")).orderBy("name").collect()
    assert [(r["name"], r["expected_text"]) for r in found] == [("a", "BPK1234"), ("b", None)]


def test_end_to_end(spark):
    from plateflow import recognition

    box = lambda x: (float(x), 0.0, 40.0, 20.0)
    candidates = spark.createDataFrame([(1, 1, box(0), 0.95, "edge_full", 0.1), (1, 2, box(200), 0.60, "text_priority", 0.9), (2, 1, box(0), 0.5, "edge_full", 0.5)], "image int, seq int, box struct<x:double,y:double,w:double,h:double>, score double, branch string, character_texture double").withColumns({"framing": F.lit(0.5), "left_margin": F.lit(0.1), "empty": F.lit(0.0)})
    tried = spark.createDataFrame([(1, 2, 1, "full_1", "full_plate", "Line", "bpBPK 1234", 0.9, True), (1, 1, 1, "full_1", "full_plate", "Line", "", 0.9, True)], "image int, seq int, attempt int, name string, source string, layout string, text string, conf double, success boolean")
    hints = spark.createDataFrame([(1, 1, "", "single_line", None), (1, 2, "", "single_line", None)], "image int, seq int, layout string, profile string, rows array<struct<text:string,conf:double>>")
    pictures = spark.createDataFrame([(1, "a.png", None), (2, "b.png", None), (3, "c.png", None), (4, "d.png", "unreadable")], "image int, path string, error string")
    # A candidate with a text outranks an empty one of greater detector score; without text, candidate or image each has its status.
    found = {r["imagePath"]: r for r in recognition.results(pictures, candidates, tried, hints).collect()}
    assert {k: (r["status"], r["plateText"], r["stateName"]) for k, r in found.items()} == {"a.png": ("ok", "BPK1234", "Selangor"), "b.png": ("ocr_failed", "", "Unknown"), "c.png": ("plate_not_found", "", "Unknown"), "d.png": ("error", "", "Unknown")}
    both = {r["seq"]: r for r in recognition.evaluated(candidates, tried, hints).where("image = 1").collect()}
    assert both[2]["final_score"] > both[1]["final_score"] and "Regex=exact" in both[2]["reason"] and "State=Selangor" in both[2]["reason"]


def test_repair_makes_candidates_without_folds(spark):
    x = spark.createDataFrame([(1, "8PK12E4", 0.015, "kept"), (2, "", 0.015, "empty"), (3, "LLUN123", 0.015, "token")], "k int, t string, gain double, more string")
    found = repair.repaired(x, "k", "t", "gain", None, "more")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Texts are dealt before they are read, and a reading is no lambda's work: a text's own scores are made once.
    assert "RepartitionByExpression" in plan and "filter(array(" not in plan
    by = {r["k"]: r for r in found.collect()}
    assert len(by) == 3 and [by[k]["more"] for k in (1, 2, 3)] == ["kept", "empty", "token"]
    assert by[2]["text"] == "" and not by[2]["changed"] and by[1]["changed"] and by[1]["original"] == "8PK12E4"


def test_split_rows_makes_each_mask_once(spark):
    from plateflow import mask_queries

    x = mask_queries.split_rows(spark, "/root/testdata/sf0.001")
    plan = x._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # A filter on the rows made them, and the mask, again below.
    assert not [line for line in plan if "Filter" in line and "lambda" in line]
    assert 0 < x.count() < 500


def test_attempts_are_rated_as_rows(spark):
    x = [("full_plate", "Line", "BPK1234", 0.8), ("text_only", "Block", "BPK123", 0.7)]
    a = spark.createDataFrame([(1, i, f"n{i}", *y, True) for i, y in enumerate(x)], ATTEMPTS)
    h = spark.createDataFrame([(1, "two_row", "two_row", [("BPK", 0.9), ("1234", 0.9)])], HINTS)
    found = attempts.recognised(a, h)
    # What a text is worth lies in an attempt before they meet, made in generated code.
    entry = attempts.gathered(a.withColumnRenamed("seq", "attempt"), h, "cand").schema["_a"].dataType.elementType
    assert {"score", "one", "two", "weight", "p", "d", "s", "ordered"} <= set(entry.names)
    r = found.first()
    assert (r["text"], r["variant"], r["layout"]) == ("BPK1234", "rowwise_combo", "two_row")


def test_refinement_in_columns_is_that_of_the_expression(spark):
    given = [(t, c) for t in ("", "BPK1234", "BPK1234XY", "BPK1234X", "YBPK1234", "YF123QQ", "XXZ12", "12DC88AB", "ABCDE1") for c in (0.2, 0.6, None)]
    x = spark.createDataFrame(given, "text string, conf double")
    for suffix in (True, False):
        both = attempts.refined(x, "text", F.col("conf"), suffix).withColumn("r", text.refined(F.col("text"), F.col("conf"), suffix)).collect()
        assert [(r["_text"], r["_label"]) for r in both] == [(r["r"]["text"], r["r"]["label"]) for r in both]


def test_readings_are_those_of_all_splits(spark):
    given = ["", "B", "8PK12E4", "BPK1234X", "0125678", "QQ11QQ", "ABCDEFGHIJ", "12345678901", "A1", "OIZSG8TBX"]

    def every(t):
        above, below = t.translate(str.maketrans(*text.LETTERS_FOR)), t.translate(str.maketrans(*text.DIGITS_FOR))
        return sorted({t} | {above[:p] + below[p : p + d] + above[p + d :] for p in range(1, 5) for d in range(1, 5) for s in (0, 1) if p + d + s == len(t)})

    x = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.repair_candidates(F.col("t")).alias("all"), text.readings(F.col("t"), text.as_letters(F.col("t")), text.as_digits(F.col("t"))).alias("own"))
    rows = x.collect()
    assert {r["t"]: r["all"] for r in rows} == {t: every(t) for t in given}
    # The text itself comes first, so that what it carries goes with one row.
    assert all(r["own"][0] == r["t"] for r in rows)


def test_what_is_carried_goes_with_one_row(spark):
    x = spark.createDataFrame([(1, "8PK12E4", ["8PK12E4", "BPK1234"], "kept"), (2, "", ["", "BPK1234"], "empty")], "k int, t string, others array<string>, more string")
    rows = repair.candidates(x, "k", "t", "others", "more", once=("more",)).collect()
    assert sorted((r["k"], r["candidate"]) for r in rows if r["more"] is not None) == [(1, "8PK12E4"), (2, "")] and len(rows) > 4


def test_unread_records_are_not_collected(spark):
    from plateflow import queries

    found = queries.end_to_end(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Nobody reads the records of the other candidates, so they are not collected.
    assert "collect_list(struct(a" not in plan


def test_rows_are_read_in_the_order_of_their_candidates(spark):
    from plateflow import queries

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.row_readings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # Lines and orders are dealt and sorted once each; nothing behind them holds more than one candidate.
    assert plan.count("Exchange hashpartitioning") == plan.count("Sort [") == 2 and "ObjectHashAggregate" not in plan


def test_best_rows_of_odd_readings(spark):
    rows = [
        (1, 3, 1, "plain", "C", 0.1, False), (1, 1, 1, "plain", "A", 0.2, False), (1, 2, 1, "plain", "B", 0.3, False), (1, 2, 2, "plain", "D", 0.3, False),
        (2, None, 1, "plain", "N", 0.5, False), (2, 1, 1, "plain", None, 0.9, False), (2, 1, 2, "plain", "K", None, False), (2, None, 2, "plain", "M", 0.6, False),
        (None, 1, 1, "raw", "8X1", 0.4, True), (None, 2, 7, "raw", "I2", 0.4, True), (None, 2, 3, "raw", "", 0.9, True),
    ]
    x = spark.createDataFrame(rows, "cand long, row int, seq int, name string, text string, conf double, two_row boolean")
    got = {r["cand"]: [tuple(e) for e in r["rows"]] for r in attempts.best_rows(x).collect()}
    # The earlier of equals; rows without a number come first; no text counts -1, no confidence less than that.
    assert got == {1: [("A", 0.2), ("B", 0.3), ("C", 0.1)], 2: [("M", 0.6), ("", 0.9)], None: [("BXI", 0.4), ("12", 0.4)]}
    assert attempts.best_rows(x.limit(0)).collect() == []


def odd_texts(n=600):
    import random

    random.seed(7)
    made = ["".join(random.choice(s) for s in (random.choice(["ABZIFGX0123489", "IUMLV1N", "OQDUILTZSGB0125678", "Z", "12D"]) for _ in range(random.randint(0, 11)))) for _ in range(n)]
    return [*made, "ABX1234", "AB1234R", "8PK12E4", "ZA1234", "12DC88", "IIUM6763", "LLUN6763", "A", "", "ABCDEFGHIJ", "12345678901"]


def test_readings_that_cannot_win_are_not_made(spark):
    from itertools import product

    x = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(product(odd_texts(), (0.005, 0.03)))], "k int, t string, gain double")
    t, c = F.col("t"), F.col("candidate")
    x = x.withColumn("least", F.when(t.isNotNull(), text.repair_score(t, text.shape(t), text.shape(t), text.rule_number(t)) + F.col("gain")))
    every = repair.candidates(x, "k", "t", None, "least")
    score = lambda o: text.repair_score(c, text.shape(c), text.shape(o), text.rule_number(c)) + text.prefix_bonus(text.rule_number(c))
    winners = every.where((score(F.col("text")) > F.col("least")) & (c != F.col("text"))).select("k", "candidate").distinct()
    made = repair.candidates(x, "k", "t", None, least="least").select("k", "candidate")
    assert winners.count() > 200 and winners.subtract(made).count() == 0
    # Nothing is over what `most` says, and the text itself is made once.
    over = every.where((score(F.col("text")) > text.most(F.col("text"))) & (c != F.col("text")))
    assert over.count() == 0 and made.groupBy("k", "candidate").count().where("count > 1").count() == 0
    plain = spark.createDataFrame([(1, "ABX1234", 0.015)], "k int, t string, gain double").withColumn("least", F.lit(1.1))
    assert [r["candidate"] for r in repair.candidates(plain, "k", "t", None, least="least").collect()] == ["ABX1234"]


def test_rules_by_first_letter_are_those_by_priority(spark):
    import re

    from plateflow.plans.dims import RULES

    def first(t):
        return next((k for k, (_, _, matcher, token, _) in enumerate(RULES) if (re.search(token, t) if matcher == "pattern" else t.startswith(token))), None)

    given = [*odd_texts(), *(a + b for a in text.LETTERS + text.DIGITS + "é?" for b in ("", "1", "A1234"))]
    x = spark.createDataFrame([(t,) for t in given], "t string").select("t", text.rule_number(F.col("t")).alias("n"), text.shape(F.col("t")).alias("s"))
    rows = x.select("t", "n", text.exact(F.col("s")).alias("exact"), text.partial(F.col("s")).alias("partial")).collect()
    assert [r["n"] for r in rows] == [first(r["t"]) for r in rows]
    plain = [r for r in rows if re.fullmatch("[A-Z0-9]*", r["t"])]
    assert [(r["exact"], r["partial"]) for r in plain] == [(bool(re.search(text.EXACT, r["t"])), bool(re.search(text.PARTIAL, r["t"]))) for r in plain]


def test_without_hints_plates_have_one_row(spark):
    from plateflow import recognition

    box = lambda x: (float(x), 0.0, 40.0, 20.0)
    candidates = spark.createDataFrame([(1, 1, box(0), 0.9), (1, 2, box(5), 0.8), (2, 1, box(0), 0.5), (3, 1, box(0), 0.5)], "image int, seq int, box struct<x:double,y:double,w:double,h:double>, score double").withColumns({"framing": F.lit(0.5), "left_margin": F.lit(0.1)})
    rows = [(1, 1, 0, "8PK1234", 0.6, True), (1, 1, 1, "BPK1234", 0.6, True), (1, 2, 0, "PK123", 0.9, True), (1, 2, 1, "PK123R", 0.3, True), (2, 1, 0, "LLUN6763", None, True), (2, 1, 1, "bpW99", None, False), (4, 1, 0, "B1", 0.5, True)]
    tried = spark.createDataFrame(rows, "image int, seq int, attempt int, text string, conf double, success boolean").withColumns({"name": F.concat(F.lit("n"), "attempt"), "source": F.lit("row_composite"), "layout": F.lit("Line")})
    hints = candidates.select("image", "seq", F.lit("").alias("layout"), F.lit("single_line").alias("profile"), F.lit(None).cast("array<struct<text:string,conf:double>>").alias("rows"))
    without, given = (recognition.evaluated(candidates, tried, h) for h in (None, hints))
    assert "rowwise_combo" not in without._jdf.queryExecution().optimizedPlan().toString()
    rows = without.collect()
    assert len(rows) == 4 and sorted(map(str, rows)) == sorted(map(str, given.select(*without.columns).collect()))
