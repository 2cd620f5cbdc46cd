"""Recognition from files to results: settings, success, padding, ties, errors and a user's reader, worked out by hand."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateflow import recognition
from plateflow.functions import arrays, masks
from plateflow.operators import attempts, detect, regions, rerank
from plateflow.plans import variants
from plateflow.settings import settings
from plateflow.sources import images, ocr

BOX = "struct<x:double,y:double,w:double,h:double>"
CANDIDATES = f"image int, seq int, box {BOX}, score double, branch string, framing double, left_margin double"
ATTEMPTS = "image int, seq int, attempt int, name string, source string, layout string, text string, conf double, success boolean, chars array<double>"
HINTS = "image int, seq int, layout string, profile string, rows array<struct<text:string,conf:double>>"


def run(spark, candidates, tried, own=None, size=recognition.ENDLESS, f=recognition.evaluated):
    c = spark.createDataFrame([(1, i + 1, tuple(map(float, b)), s, "edge_full", 0.5, 0.1) for i, (b, s) in enumerate(candidates)], CANDIDATES)
    a = spark.createDataFrame([(1, seq, k, f"n{k}", "full_plate", "Line", t, conf, ok, chars) for k, (seq, t, conf, ok, chars) in enumerate(tried)], ATTEMPTS)
    h = spark.createDataFrame([(1, i + 1, "", "single_line", None) for i in range(len(candidates))], HINTS)
    if f is recognition.results:
        return f(spark.createDataFrame([(1, "a.png")], "image int, path string"), c, a, h, own or settings(), size).first()
    return {r["seq"]: r for r in f(c, a, h, own or settings(), size).collect()}


def test_overlap_counts_between_padded_boxes(spark):
    # 100 by 40 each, 25 in common: .25 of the smaller box; with .35 on each side 170 by 68, 95 in common: .56, over .42.
    out = run(spark, [((100, 100, 100, 40), 0.9), ((175, 100, 100, 40), 0.9)], [(1, "BPK1234", 0.9, True, None), (2, "BPK123", 0.9, True, None)])
    assert out[1]["reason"].endswith(", Adj=overlap_fuller_text_bonus(0.08)") and out[2]["reason"].endswith(", Adj=overlap_substring_penalty(-0.16)")
    assert math.isclose(out[2]["final_score"], out[2]["before"] - 0.16) and out[1]["raw_box"].w == 100 and out[1]["box"].w == 170
    apart = run(spark, [((100, 100, 100, 40), 0.9), ((260, 100, 100, 40), 0.9)], [(1, "BPK1234", 0.9, True, None), (2, "BPK123", 0.9, True, None)])
    assert "Adj" not in apart[1]["reason"]


def test_padding_ends_at_the_image_and_reaches_the_least_height(spark):
    out = run(spark, [((10, 10, 100, 20), 0.9)], [], size=(120, 40))
    # x: floor(10 - 35) < 1; 10 + 100 + 35 > 120; 34 high, so one more on each side.
    assert tuple(out[1]["box"]) == (1, 2, 119, 36) or tuple(out[1]["box"])[3] >= 36


@pytest.mark.parametrize(("text", "suffix", "read"), [("BPK1234X", False, "BPK1234"), ("BPK1234X", True, "PK1234X"), ("BK1234X", True, "BK1234X")])
def test_the_suffix_setting_reaches_recognition(spark, text, suffix, read):
    own = settings({"classification": {"suffix_letter": suffix}})
    assert run(spark, [((0, 0, 100, 40), 0.9)], [(1, text, 0.9, True, None)], own)[1]["text"] == read
    a = spark.createDataFrame([(1, 0, "n", "full_plate", "Line", text, 0.9, True)], "cand int, seq int, name string, source string, layout string, text string, conf double, success boolean")
    h = spark.createDataFrame([(1, "", "single_line", None)], "cand int, layout string, profile string, rows array<struct<text:string,conf:double>>")
    assert attempts.recognised(a, h, own).first()["text"] == read


def test_a_reading_without_success_fails(spark):
    assert run(spark, [((0, 0, 100, 40), 0.9)], [(1, "BPK1234", 0.9, False, None)], f=recognition.results)["status"] == "ocr_failed"
    ok = run(spark, [((0, 0, 100, 40), 0.9)], [(1, "BPK1234", 0.9, True, None)], f=recognition.results)
    assert (ok["status"], ok["plateText"], ok["messages"], ok["score"], ok["way"]) == ("ok", "BPK1234", [recognition.DONE, "candidate 1 was chosen by its text"], 0.9, "ocr")
    assert tuple(ok["box"]) == (0, 0, 100, 40)


def test_characters_decide_the_recognition_score(spark):
    out = run(spark, [((0, 0, 100, 40), 0.9), ((500, 0, 100, 40), 0.8), ((900, 0, 100, 40), 0.7)], [(1, "BPK1234", 0.9, True, [0.5] * 6 + [1.2]), (2, "BPK1234", 0.6, True, [0.1, 0.1]), (3, "", 0.4, True, None)])
    assert math.isclose(out[1]["recognition"], 4 / 7) and math.isclose(out[2]["recognition"], 0.6) and math.isclose(out[3]["recognition"], 0.4)
    assert [c["label"] for c in out[1]["characters"]] == list("BPK1234") and out[1]["characters"][6]["score"] == 1.0


def test_equal_scores_go_by_the_score_before(spark):
    # Both are cut at 1, so the one that was better before the adjustment comes first, whatever its detector score.
    own = settings({"reranking": {"fuller_bonus": 5.0, "substring_penalty": -5.0}})
    out = run(spark, [((0, 0, 100, 40), 0.95), ((5, 0, 100, 40), 0.60)], [(1, "BPK12", 0.5, True, None), (2, "BPK1234", 0.9, True, None)], own)
    assert out[1]["final_score"] == out[2]["final_score"] == 1.0 and out[2]["before"] > out[1]["before"]
    got = run(spark, [((0, 0, 100, 40), 0.95), ((5, 0, 100, 40), 0.60)], [(1, "BPK12", 0.5, True, None), (2, "BPK1234", 0.9, True, None)], own, f=recognition.results)
    assert got["plateText"] == "BPK1234" and [e["candidate"] for e in got["evaluated"]] == [2, 1]


PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 20 + b"\x00\x00\x00\x00IEND\xaeB`\x82"


def test_one_file_does_not_touch_the_others(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.png").write_bytes(PNG)
    (tmp_path / "in" / "cut.png").write_bytes(PNG[:-6])
    (tmp_path / "in" / "b.bmp").write_bytes(b"BM" + (12).to_bytes(4, "little") + b"123456")
    found = images.read_pictures(spark, [f"{tmp_path}/in", f"{tmp_path}/gone.png"])
    said = {r["name"]: r["error"] for r in found.collect()}
    assert said == {"good": None, "cut": images.BROKEN, "b": None, "gone": images.MISSING}
    pictures = found.withColumn("image", F.when(F.col("name") == "good", 1).otherwise(2)).select("image", "path", "error")
    c = spark.createDataFrame([(1, 1, (0.0, 0.0, 90.0, 30.0), 0.9, "edge_full", 0.5, 0.1)], CANDIDATES)
    a = spark.createDataFrame([(1, 1, 1, "n1", "full_plate", "Line", "BPK1234", 0.9, True, None)], ATTEMPTS)
    h = spark.createDataFrame([(1, 1, "", "single_line", None)], HINTS)
    out = {re.search(r"(\w+)\.\w+$", r["imagePath"])[1]: (r["status"], r["plateText"], r["messages"]) for r in recognition.results(pictures, c, a, h).collect()}
    assert out["good"][:2] == ("ok", "BPK1234") and out["b"][0] == "plate_not_found" and out["gone"] == ("error", "", [images.MISSING]) and out["cut"] == ("error", "", [images.BROKEN])


def test_a_users_reader(spark):
    def reader(content, layout, characters):
        if content == b"bad":
            raise RuntimeError("no such font")
        return f" {content.decode()}{characters or ''} ", 90.0 if layout == "Line" else 0.5, [99.0, 50.0] if layout == "Line" else None

    rows = [(1, b"ok", "Line", None), (2, b"bad", "Line", None), (3, None, "Block", None), (4, b"x", "Block", "12"), (5, b" ", "Block", None)]
    p = spark.createDataFrame(rows, "seq int, content binary, layout string, characters string").repartition(2)
    out = {r["seq"]: (r["text"], r["conf"], r["chars"], r["success"], r["message"]) for r in ocr.attempts_from(p, reader).collect()}
    assert out == {1: ("ok", 0.9, [0.99, 0.5], True, None), 2: ("", 0.0, None, False, "no such font"), 3: ("", 0.0, None, False, ocr.NOTHING), 4: ("x12", 0.5, None, True, None), 5: ("", 0.5, None, False, None)}


def test_from_pictures_to_results(spark):
    def reader(content, layout, characters):
        return content.decode().split("|")[0], float(content.decode().split("|")[1]), None

    c = spark.createDataFrame([(k, 1, (0.0, 0.0, 90.0, 30.0), 0.9, "edge_full", 0.5, 0.1) for k in (1, 2)], CANDIDATES)
    h = spark.createDataFrame([(k, 1, "", "single_line", None) for k in (1, 2)], HINTS)
    plan = variants.plate_variants(c.select("image", "seq", F.lit(False).alias("has_text"), F.lit(False).alias("has_rows")), "image", "seq")
    seen = F.when((F.col("image") == 1) & (F.col("name") == "gray_line"), "BPK1234|0.9").when(F.col("image") == 1, "8PK|0.2").otherwise("no number").cast("binary")
    out = {r["imagePath"]: r for r in recognition.from_pictures(spark.createDataFrame([(1, "a.png"), (2, "b.png")], "image int, path string"), c, plan.withColumn("content", seen), h, reader).collect()}
    assert (out["a.png"]["status"], out["a.png"]["plateText"], out["a.png"]["variant"]) == ("ok", "BPK1234", "gray_line")
    assert (out["b.png"]["status"], out["b.png"]["messages"][0]) == ("ocr_failed", recognition.NO_TEXT)


def test_a_plate_is_read_51_times_at_most(spark):
    c = spark.createDataFrame([(1, True, True, 2, "two_row", ""), (2, False, False, 1, "", "single_line")], "id int, has_text boolean, has_rows boolean, rows int, layout string, profile string")
    whole = {r["id"]: r["count"] for r in variants.plate_variants(c, "id").groupBy("id").count().collect()}
    rows = {r["id"]: r["count"] for r in variants.row_variants(c, "id").groupBy("id").count().collect()}
    assert whole == {1: 29, 2: 11} and rows == {1: 22}


def test_detection_keeps_whole_candidates(spark):
    names = [f.name for f in recognition_candidates(spark).schema]
    out = detect.detected(recognition_candidates(spark), settings({"reranking": {"evaluate": 2}}))
    assert set(names) < set(out.columns) and [(r["seq"], r["rank"]) for r in out.orderBy("rank").collect()] == [(1, 1), (3, 2)]


def recognition_candidates(spark):
    from plateflow.queries import _candidates

    x = _candidates(spark, "/root/testdata/sf0.001").where("image = 1").limit(1)
    good = {"extent": 0.5, "solidity": 0.5, "area_ratio": 0.01, "width_ratio": 0.2, "height_ratio": 0.1}
    one = x.withColumns({k: F.lit(v) for k, v in good.items()})
    box = lambda v: F.struct(F.lit(float(v)).alias("x"), F.lit(0.0).alias("y"), F.lit(90.0).alias("w"), F.lit(30.0).alias("h"))
    made = lambda seq, at, empty: one.withColumns({"seq": F.lit(seq), "box": box(at), "empty": F.lit(float(empty))})
    # The second overlaps the first and is worse; the fourth is worst; the fifth is not valid.
    return made(1, 0, 0.0).unionByName(made(2, 5, 0.1)).unionByName(made(3, 300, 0.2)).unionByName(made(4, 600, 0.9)).unionByName(made(5, 900, 0.0).withColumn("extent", F.lit(0.01)))


def test_components_touch_at_corners():
    mask = np.array([[1, 1, 0, 0, 1], [0, 0, 1, 0, 1], [0, 0, 0, 0, 0], [1, 0, 0, 0, 1], [0, 1, 0, 1, 0], [0, 0, 1, 0, 0]], bool)
    rows = [(y, a, b) for y in range(6) for a, b in _islands(mask[y])]
    y, first, last = (np.array(x) for x in zip(*rows, strict=True))
    # Two above that never meet; a V below that meets at its foot.
    assert regions.labels_of(y, first, last).tolist() == [1, 2, 1, 2, 3, 3, 3, 3, 3]


def _islands(row):
    on = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
    return [(int(a), int(b) - 1) for a, b in on.reshape(-1, 2)]


def test_regions_of_empty_and_full_masks(spark):
    m = spark.createDataFrame([(1, [[False, False]]), (2, [[True, True], [True, True]]), (3, [])], "id int, mask array<array<boolean>>")
    out = [(r["id"], r["area"], tuple(r["box"]), r["extent"]) for r in regions.regions(regions.mask_runs(m, "id"), "id").collect()]
    assert out == [(2, 4, (0.5, 0.5, 2.0, 2.0), 1.0)]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_percentiles(spark):
    v = F.array(*(F.lit(float(x)) for x in (4, 1, 3, 2)))
    # The i-th of four stands for 12.5, 37.5, 62.5 and 87.5 percent.
    assert [one(spark, arrays.percentile(v, p)) for p in (0, 12.5, 25, 50, 87.5, 100)] == [1, 1, 1.5, 2.5, 4, 4]
    assert one(spark, arrays.percentile(F.array().cast("array<double>"), 50)) is None


def test_bands_of_plain_masks(spark):
    flags = lambda rows: F.array(*(F.array(*(F.lit(c == "#") for c in r)) for r in rows))
    two = flags(["..........", ".########.", ".########.", "..........", "..........", ".########.", ".########.", ".........."])
    f = one(spark, masks.framing(F.lit("A1"), F.lit("two_row"), two, masks.column_profile(two)))
    # Margins of .1 count fully, spans of .8 count 1 - .24 / .34, five rows apart and even heights count fully.
    assert (f["label"], f["left"], f["right"]) == ("two_row_band", 0.1, 0.1) and math.isclose(f["score"], (3 + 1 - 0.24 / 0.34) / 4)
    single = flags(["..........", ".########."])
    assert one(spark, masks.framing(F.lit("A1"), F.lit("two_row"), single, masks.column_profile(single)))["label"] == "fallback_single_band"
    blank = flags(["....", "...."])
    assert one(spark, masks.framing(F.lit("A1"), F.lit("single_line"), blank, masks.column_profile(blank)))["label"] == "no_text_band"
    assert one(spark, masks.framing(F.lit("A1"), F.lit("two_row"), blank, masks.column_profile(blank)))["label"] == "two_row_no_band"
    assert tuple(one(spark, masks.framing(F.lit(""), F.lit("two_row"), two, masks.column_profile(two)))) == (0.3, "unknown", 0.0, 0.0)
    assert one(spark, masks.two_row_band(blank, masks.column_profile(blank)))["score"] == 0.22
    assert one(spark, masks.best_crop(blank, F.array().cast(f"array<{BOX}>"))) is None


def test_final_scores_are_generated_code_and_unread_parts_are_not_made(spark):
    rows = [("BPK1234", 0.9, 0.7, 0.5, 0.4, 0.1), ("", 0.2, 0.1, 0.9, 0.2, 0.0), ("12", 0.3, 0.9, 0.1, 0.9, 0.0)]
    x = spark.createDataFrame(rows, "text string, detector double, evidence double, recognition double, framing double, left_margin double")
    plan = rerank.with_final_score(x).select("final_score")._jdf.queryExecution().optimizedPlan().toString()
    # Nothing but values that are there already passes a lambda, and the reason's formatting falls away.
    assert "format_string" not in plan and "RLIKE(lambda" not in plan and "regexp_replace(lambda" not in plan and "StartsWith(lambda" not in plan
    found = [(round(r["final_score"], 6), r["reason"].split(", ")[3:5]) for r in rerank.with_final_score(x).collect()]
    assert [w for _, w in found] == [["Regex=exact", "Struct=P3-D4-S0"], ["Regex=none", "Struct=empty"], ["Regex=none", "Struct=P0-D2-S0"]]
    assert found[1][0] == 0.0 and found[0][0] > 0.8


def test_overlaps_are_judged_from_flat_entries(spark):
    rows = [(1, 1, (0.0, 0.0, 10.0, 10.0), "BPK1234", 0.9), (1, 2, (1.0, 1.0, 4.0, 4.0), "PK123", 0.9), (1, 3, (50.0, 0.0, 10.0, 10.0), "PK12", 0.5), (1, 4, (0.0, 0.0, 10.0, 10.0), None, 0.4), (1, 5, (0.0, 0.0, 0.0, 0.0), "PK1", 0.3)]
    out = rerank.adjusted(spark.createDataFrame(rows, f"image int, seq int, box {BOX}, text string, score double"))
    # A step of a fold costs what its nodes cost: boxes lie open in the entries, no struct in a struct is opened for each pair.
    assert ".box." not in out.select("score")._jdf.queryExecution().optimizedPlan().toString()
    assert {r["seq"]: (round(r["score"], 6), r["reason"].count("Adj=")) for r in out.collect()} == {1: (0.98, 1), 2: (0.74, 1), 3: (0.5, 0), 4: (0.4, 0), 5: (0.3, 0)}
