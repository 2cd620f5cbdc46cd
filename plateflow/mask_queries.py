"""Queries over plates' masks: profiles, rows of text, bands, framing, crops and components, each with the same in SQL.

A made-up mask of 24 rows by 48 columns, and six boxes in it, come from each vector of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateflow.functions import arrays, layout, masks, rectify
from plateflow.operators import detect, regions
from plateflow.plans import variants
from plateflow.plans.dims import PROFILES
from plateflow.queries import CANDIDATES, IOU, _candidates, _double, _final_sql, _t, query
from plateflow.settings import DEFAULTS

HIGH, WIDE = 24, 48


def plate_masks(spark: SparkSession, d: str) -> DataFrame:
    """id, v, mask, boxes, expected (that the plate has two rows)."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    # Each entry is compared once for a vector; a row of the mask is a window of the flags, with those of its columns.
    on = lambda n, place, least: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("v", place(i).cast("int")) > least)
    e = e.withColumns({"_on": on(64, lambda i: i, -0.06), "_across": on(WIDE, lambda i: 20 + F.floor((i + 1) / 6), -0.12)}).withColumn("_twice", F.concat("_on", "_on"))

    def row(y):
        own, down = F.slice("_twice", (1 + 3 * y) % 64 + 1, F.lit(WIDE)), F.get("_on", F.floor(y / 5).cast("int"))
        both = F.zip_with(own, "_across", lambda a, b: a & b)
        return F.when(down, both).when(~down, F.array_repeat(F.lit(False), WIDE)).otherwise(F.transform(both, lambda a: a & F.lit(None).cast("boolean")))

    mask = F.transform(F.sequence(F.lit(1), F.lit(HIGH)), row)
    i = F.col("id")
    box = lambda k: F.struct(*(v.cast("double").alias(n) for n, v in (("x", 2 + (i * 7 + k * 8) % 40 + F.lit(0.5)), ("y", 1 + (i + k * 5) % 18 + F.lit(0.5)), ("w", 3 + (i + k) % 4), ("h", 4 + (i * 3 + k) % 5))))
    return e.select("id", "v", mask.alias("mask"), F.transform(F.sequence(F.lit(1), 1 + (i % 6).cast("int")), box).alias("boxes"), (i % 2 == 0).alias("expected"))


PX = f"""px AS (SELECT id, y, x, v[1 + (x + 3 * y) % 64] > -0.06 AND v[1 + y // 5] > -0.06 AND v[21 + x // 6] > -0.12 AS o, i.id % 2 = 0 AS expected
  FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) i, (SELECT unnest(range(1, {HIGH + 1})) AS y), (SELECT unnest(range(1, {WIDE + 1})) AS x)),
bx AS (SELECT vec_id AS id, k, (2 + (vec_id * 7 + k * 8) % 40)::DOUBLE + 0.5 AS x, (1 + (vec_id + k * 5) % 18)::DOUBLE + 0.5 AS y, (3 + (vec_id + k) % 4)::DOUBLE AS w, (4 + (vec_id * 3 + k) % 5)::DOUBLE AS h, vec_id % 2 = 0 AS expected
  FROM (SELECT vec_id, unnest(range(1, 2 + vec_id % 6)) AS k FROM embeddings))"""
_UNION = "floor(min(x)) AS x1, floor(min(y)) AS y1, greatest(1, ceil(max(x + w)) - floor(min(x))) AS w, greatest(1, ceil(max(y + h)) - floor(min(y))) AS h"
ALL = f"roi AS (SELECT id, 1 AS k, any_value(expected) AS expected, count(*) AS boxes, {_UNION} FROM bx GROUP BY id)"


def _profile(rois: str, name: str) -> str:
    """name: of each part (id, k) of a mask the share that is on of its i-th row."""
    return f"""{name} AS (SELECT r.id, r.k, p.y - r1 + 1 AS i, avg(o::INT) AS v FROM (SELECT id, k, greatest(1, round(y1)) AS r1, least({HIGH}, round(y1 + h)) AS r2, greatest(1, round(x1)) AS c1, least({WIDE}, round(x1 + w)) AS c2 FROM {rois}) r
  JOIN px p ON p.id = r.id AND p.y BETWEEN r1 AND r2 AND p.x BETWEEN c1 AND c2 GROUP BY r.id, r.k, p.y, r1)"""


def _runs(of: str, least: float, share: str, name: str) -> str:
    """name: runs (a to z) of the entries of a profile (id, k, i, v) that reach share of the mean of those above 0."""
    return f"""{name}_t AS (SELECT id, k, greatest({least}, {share} * avg(v) FILTER (WHERE v > 0)) AS t FROM {of} GROUP BY id, k),
{name}_g AS (SELECT s.id, s.k, i, i - row_number() OVER (PARTITION BY s.id, s.k ORDER BY i) AS g FROM {of} s JOIN {name}_t t ON s.id = t.id AND s.k = t.k WHERE v > 0 AND v >= t - {arrays.ROUNDING:.12f}),
{name} AS (SELECT id, k, min(i) AS a, max(i) AS z, max(i) - min(i) + 1 AS len FROM {name}_g GROUP BY id, k, g)"""


def _two(runs: str, name: str) -> str:
    """name: the two longest runs a1 to z1 and a2 to z2 of each (id, k) that has two."""
    return f"""{name}_w AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY len DESC, a) AS place FROM {runs}),
{name} AS (SELECT id, k, min(a) AS a1, arg_min(z, a) AS z1, max(a) AS a2, arg_max(z, a) AS z2, greatest(0, 1 - (max(len) - min(len))::DOUBLE / greatest(sum(len), 1)) AS balance, max(a) - arg_min(z, a) AS apart FROM {name}_w WHERE place <= 2 GROUP BY id, k HAVING count(*) = 2)"""


def _bands(rois: str, share: str, name: str) -> str:
    """name: the two tallest bands of text rows of each part of a mask, by its smoothed profile; n: the part's rows."""
    return f"""{_profile(rois, name + "_p")}, {name}_n AS (SELECT id, k, count(*) AS n, count(*) FILTER (WHERE v > 0) AS pos, greatest(1, floor(count(*) / 14)) AS half FROM {name}_p GROUP BY id, k),
{name}_s AS (SELECT a.id, a.k, a.i, avg(b.v) AS v FROM {name}_p a JOIN {name}_n n ON a.id = n.id AND a.k = n.k JOIN {name}_p b ON a.id = b.id AND a.k = b.k AND b.i BETWEEN a.i - half AND a.i + half GROUP BY a.id, a.k, a.i),
{_runs(name + "_s", 0.02, share, name + "_r")}, {_two(name + "_r", name + "_2")},
{name} AS (SELECT t.*, n FROM {name}_2 t JOIN {name}_n n ON t.id = n.id AND t.k = n.k WHERE pos >= 2)"""


def _split(boxes: str, rois: str, bands: str, name: str) -> str:
    """name: boxes (id, k, y, h, expected) of each part with whether they lie below, where its bands divide them."""
    return f"""{name}_h AS (SELECT b.*, b.y + b.h / 2 > floor((z1 + a2) / 2) + y1 - 1 AS below FROM {boxes} b JOIN {rois} r ON b.id = r.id AND b.part = r.k JOIN {bands} p ON p.id = r.id AND p.k = r.k),
{name}_c AS (SELECT id, part, any_value(expected) AS e, count(*) AS n, count(*) FILTER (WHERE below) AS low FROM {name}_h GROUP BY id, part),
{name} AS (SELECT h.* FROM {name}_h h JOIN {name}_c c ON h.id = c.id AND h.part = c.part WHERE low >= CASE WHEN e THEN 1 ELSE 2 END AND n - low >= CASE WHEN e THEN 1 ELSE 2 END AND (e OR n >= 4))"""


BY_BANDS = f"{PX}, {ALL}, b1 AS (SELECT *, 1 AS part FROM bx), {_bands('roi', str(rectify.DIVIDES), 'dv')}, {_split('b1', 'roi', 'dv', 'sp')}"


@query(_double(f"WITH {BY_BANDS} SELECT id, part IS NOT NULL AS two, coalesce(top, boxes)::INT AS top, coalesce(low, 0)::INT AS bottom FROM roi LEFT JOIN (SELECT id, part, count(*) FILTER (WHERE NOT below) AS top, count(*) FILTER (WHERE below) AS low FROM sp GROUP BY id, part) USING (id)"))
def projection_split(spark, d):
    x = plate_masks(spark, d).select("id", rectify.projection_split(F.col("boxes"), F.col("mask"), F.col("expected")).alias("s"))
    return x.select("id", F.col("s.two").alias("two"), F.size("s.top").alias("top"), F.size("s.bottom").alias("bottom"))


def _projected_rows(rois: str, name: str) -> str:
    """name: of each part its two rows (y1, h of row 1 and 2) by the projection, and the score."""
    share = f"CASE WHEN any_value(id % 2) = 0 THEN {rectify.EXPECTED} ELSE {rectify.UNEXPECTED} END"
    return f"""{_bands(rois, share, name + "_b")}, {name}_m AS (SELECT p.*, r.x1, r.y1, r.w, greatest(1, round(0.06 * n)) AS pad, greatest(8, round(0.24 * r.h)) AS tall, floor((z1 + a2) / 2) AS mid FROM {name}_b p JOIN {rois} r ON p.id = r.id AND p.k = r.k),
{name}_1 AS (SELECT *, greatest(1, a1 - pad) AS t1, greatest(greatest(1, a1 - pad) + tall - 1, mid) AS t2 FROM {name}_m),
{name}_2f AS (SELECT *, least(n, greatest(t2 + 1, mid + 1 - pad)) AS f1, least(n, greatest(least(n, greatest(t2 + 1, mid + 1 - pad)) + tall - 1, z2 + pad)) AS f2, least(n - 1, greatest(t2 + 1, a2)) AS g1 FROM {name}_1),
{name} AS (SELECT *, CASE WHEN f2 <= f1 THEN g1 ELSE f1 END AS l1, CASE WHEN f2 <= f1 THEN least(n, greatest(g1 + 1, z2 + pad)) ELSE f2 END AS l2, greatest(0, least(1, (balance + least(1, apart / greatest(0.08 * n, 1)) + least(1, w / greatest({WIDE} * 0.10, 1))) / 3)) AS score FROM {name}_2f)"""


@query(_double(f"WITH {PX}, {ALL}, {_projected_rows('roi', 'pr')}, u AS (SELECT id, 1 AS row, x1, greatest(1, y1 + t1 - 1) AS y, w, greatest(2, t2 - t1 + 1) AS h, score FROM pr UNION ALL SELECT id, 2, x1, greatest(1, y1 + l1 - 1), w, greatest(2, l2 - l1 + 1), score FROM pr) SELECT id, row::INT AS row, greatest(1, x1)::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, round(score::DOUBLE, 6) AS score FROM u"))
def projection_rows(spark, d):
    x = plate_masks(spark, d).select("id", rectify.projection_rows(F.col("boxes"), F.col("mask"), F.col("expected")).alias("p"))
    return x.select("id", F.posexplode("p.rows").alias("i", "b"), F.round("p.score", 6).alias("score")).select("id", (F.col("i") + 1).alias("row"), "b.*", "score")


def _direct(boxes: str, name: str) -> str:
    """name: boxes (id, part) of each part with whether they lie below, where the widest gap divides them."""
    return f"""{name}_o AS (SELECT *, row_number() OVER q AS n, y + h / 2 - lag(y + h / 2) OVER q AS gap, count(*) OVER (PARTITION BY id, part) AS every, avg(h) OVER (PARTITION BY id, part) AS mh FROM {boxes} WINDOW q AS (PARTITION BY id, part ORDER BY y + h / 2, k)),
{name}_g AS (SELECT id, part, max(gap) AS gap FROM {name}_o GROUP BY id, part), {name}_cut AS (SELECT o.id, o.part, min(n) AS n FROM {name}_o o JOIN {name}_g g ON o.id = g.id AND o.part = g.part AND o.gap = g.gap GROUP BY o.id, o.part),
{name} AS (SELECT o.id, o.k, o.x, o.y, o.w, o.h, o.part, o.n >= c.n AS below FROM {name}_o o JOIN {name}_g g ON o.id = g.id AND o.part = g.part JOIN {name}_cut c ON o.id = c.id AND o.part = c.part WHERE every >= 4 AND g.gap >= greatest(0.45 * mh, 0.10 * {HIGH}) AND c.n - 1 >= 2 AND every - c.n + 1 >= 2)"""


def _rows(boxes: str, rois: str, name: str) -> str:
    """name: boxes with below by the widest gap, else by projection; none of a part that has one row. Needs dv, the bands of rois."""
    return f"""{_direct(boxes, name + "_d")}, {_split(boxes, rois, "dv", name + "_q")},
{name} AS (SELECT id, part, k, x, y, w, h, below, true AS direct FROM {name}_d UNION ALL SELECT id, part, k, x, y, w, h, below, false FROM {name}_q q WHERE NOT EXISTS (SELECT 1 FROM {name}_d e WHERE e.id = q.id AND e.part = q.part))"""


@query(_double(f"WITH {PX}, {ALL}, b1 AS (SELECT *, 1 AS part FROM bx), {_bands('roi', str(rectify.DIVIDES), 'dv')}, {_rows('b1', 'roi', 'rw')} SELECT id, count(*) FILTER (WHERE NOT below)::INT AS top, count(*) FILTER (WHERE below)::INT AS bottom, round(sum(CASE WHEN below THEN x ELSE -x END), 6) AS sides FROM rw GROUP BY id"))
def split_rows(spark, d):
    x = plate_masks(spark, d).select("id", rectify.rows_of(F.col("boxes"), F.col("mask"), F.col("expected")).alias("r"))
    # As a generator, since a filter would be pushed below the rows and make them, and the mask for each use of it, again for itself.
    x = x.select("id", F.explode_outer(F.when(F.col("r.two"), F.array("r"))).alias("r")).where("r IS NOT NULL")
    each = lambda k: arrays.total(F.transform(k, lambda b: b["x"]))
    return x.select("id", F.size("r.top").alias("top"), F.size("r.bottom").alias("bottom"), F.round(each("r.bottom") - each("r.top"), 6).alias("sides"))


CLUSTERS = f"""{PX}, lim AS (SELECT id, greatest(4, 0.85 * median(w)) AS lim FROM bx GROUP BY id), cf AS (SELECT bx.*, CASE WHEN x - max(x + w) OVER (PARTITION BY bx.id ORDER BY x, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > lim THEN 1 ELSE 0 END AS new FROM bx JOIN lim ON bx.id = lim.id),
cl AS (SELECT * EXCLUDE expected, true AS expected, 1 + sum(new) OVER (PARTITION BY id ORDER BY x, k ROWS UNBOUNDED PRECEDING) AS part FROM cf), croi AS (SELECT id, part AS k, count(*) AS boxes, sum(w * h) AS filled, {_UNION} FROM cl GROUP BY id, part),
{_bands('croi', str(rectify.DIVIDES), 'cb')}, {_split('cl', 'croi', 'cb', 'cs')},
cr AS (SELECT r.id, r.k, 0.28 * least(1.0, boxes / 6) + 0.24 * least(1.0, filled / greatest(r.w * r.h, 1)) + 0.20 * greatest(0.0, 1 - abs(r.w / {WIDE} - 0.30) / 0.32) + 0.14 * greatest(0.0, 1 - abs(r.h / {HIGH} - 0.48) / 0.40) + 0.08 * greatest(0.0, 1 - abs(r.x1 + r.w / 2 - {WIDE / 2}) / greatest(0.55 * {WIDE}, 1))
  + 0.06 * CASE WHEN EXISTS (SELECT 1 FROM cs WHERE cs.id = r.id AND cs.part = r.k) THEN 1.0 ELSE 0.28 END AS score FROM croi r),
cw AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS place FROM cr),
pick AS (SELECT cl.id, cl.k, cl.x, cl.y, cl.w, cl.h, cl.id % 2 = 0 AS expected, 1 AS part FROM cl LEFT JOIN cw ON cl.id = cw.id AND cw.place = 1 WHERE cl.id % 2 = 1 OR cl.id % 6 < 2 OR cl.part = cw.k)"""


@query(_double(f"WITH {CLUSTERS} SELECT id, array_to_string(list(x ORDER BY x), ',') AS xs FROM pick GROUP BY id"))
def best_cluster(spark, d):
    x = plate_masks(spark, d).select("id", rectify.best_cluster(F.col("boxes"), F.col("mask"), F.col("expected")).alias("b"))
    return x.select("id", F.array_join(F.transform(F.sort_array(F.transform("b", lambda b: b["x"])), lambda v: v.cast("string")), ",").alias("xs"))


def _row_stats(of: str, key: str, name: str) -> str:
    """Of each row of boxes its count, spreads of middles and heights, mean height, evenness of gaps, and sides."""
    return f"""{name} AS (SELECT {key}, count(*) AS n, avg(h) AS mh, coalesce(stddev_samp(h), 0) AS sh, coalesce(stddev_samp(y + h / 2), 0) AS sc, min(x) AS x1, max(x + w) AS x2, min(y) AS y1, max(y + h) AS y2,
  CASE WHEN count(*) <= 2 THEN 0.75 WHEN count(gap) FILTER (WHERE gap >= 0) = 0 THEN 0.25 ELSE least(1.0, greatest(0.0, 1 - coalesce(stddev_samp(gap) FILTER (WHERE gap >= 0), 0) / (avg(gap) FILTER (WHERE gap >= 0) + 1))) END AS gc
  FROM (SELECT *, x - lag(x + w) OVER (PARTITION BY {key} ORDER BY x, k) AS gap FROM {of}) GROUP BY {key})"""


_CNT = lambda n, a, b: f"CASE WHEN {n} BETWEEN {a} AND {b} THEN 1.0 WHEN {n} <= 1 THEN 0.0 ELSE greatest(0.15, 0.85 - 0.12 * least(abs({n} - {a}), abs({n} - {b}))) END"
_LESS = lambda v, lim: f"greatest(0.0, 1 - ({v}) / {lim})"
_CLAMP = lambda v: f"least(1.0, greatest(0.0, {v}))"
_KEPT = lambda r: _CLAMP(f"({_LESS(r + '.sc', f'(0.10 * {HIGH})')} + {_LESS(r + '.sh', r + '.mh')} + {r}.gc) / 3")
_SIDES = _CLAMP("""(greatest(0.0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) / least(t.x2 - t.x1, b.x2 - b.x1) + greatest(0.0, 1 - abs((t.x1 + t.x2) / 2 - (b.x1 + b.x2) / 2) / (0.22 * (a.x2 - a.x1))) + greatest(0.0, 1 - abs((t.x2 - t.x1) - (b.x2 - b.x1)) / greatest(t.x2 - t.x1, b.x2 - b.x1)) + least(1.0, (t.x2 - t.x1) / (0.42 * (a.x2 - a.x1)), (b.x2 - b.x1) / (0.42 * (a.x2 - a.x1)))) / 4""")
_PADDED = lambda x1, y1, w, h, p: f"greatest(1, floor({x1} - {w} * {p})) AS x, greatest(1, floor({y1} - {h} * {p})) AS y, least({WIDE}, ceil({x1} + {w} + {w} * {p})) AS xe, least({HIGH}, ceil({y1} + {h} + {h} * {p})) AS ye"


@query(_double(f"""WITH {CLUSTERS}, proi AS (SELECT id, 1 AS k, count(*) AS boxes, {_UNION} FROM pick GROUP BY id), {_bands('proi', str(rectify.DIVIDES), 'dv')}, {_rows('pick', 'proi', 'rw')}, {_projected_rows('proi', 'pr')},
{_row_stats('pick', 'id', 'sa')}, {_row_stats('(SELECT * FROM rw WHERE NOT below)', 'id', 'st')}, {_row_stats('(SELECT * FROM rw WHERE below)', 'id', 'sb')},
sd AS (SELECT a.id, {_CLAMP(f"({_CNT('a.n', 4, 9)} + {_LESS('abs(t.n - b.n)::DOUBLE', 'a.n')} + {_KEPT('t')} + {_KEPT('b')} + {_LESS('abs(t.mh - b.mh)', 'a.mh')} + {_SIDES}) / 6")} AS direct FROM sa a JOIN st t ON a.id = t.id JOIN sb b ON a.id = b.id),
ss AS (SELECT a.id, {_CLAMP(f"({_CNT('a.n', 3, 8)} + {_LESS('a.sc', f'(0.14 * {HIGH})')} + {_LESS('a.sh', 'a.mh')} + a.gc) / 4")} AS single FROM sa a),
ch AS (SELECT r.id, CASE WHEN direct >= 0.50 THEN 'boxes' WHEN p.score >= 0.50 THEN 'bands' ELSE 'one' END AS how, CASE WHEN direct >= 0.50 THEN direct WHEN p.score >= 0.50 THEN p.score ELSE single END AS layout_score, r.x1, r.y1, r.w, r.h,
  {_CLAMP(f"(greatest(0.0, 1 - abs(r.w / {WIDE} - 0.68) / 0.42) + greatest(0.0, 1 - abs(r.h / {HIGH} - 0.42) / 0.28)) / 2")} AS coverage FROM proi r LEFT JOIN sd ON r.id = sd.id LEFT JOIN ss ON r.id = ss.id LEFT JOIN pr p ON p.id = r.id),
ub AS (SELECT id, below, {_UNION} FROM rw GROUP BY id, below), rr AS (SELECT u.id, below::INT + 1 AS row, {_PADDED('x1', 'y1', 'w', 'h', '(0.04 + 0.5 * 0.06)')} FROM ub u WHERE id IN (SELECT id FROM ch WHERE how = 'boxes') UNION ALL SELECT id, 1, {_PADDED('x1', 'y1', 'w', 'h', '(0.04 + 0.5 * 0.06)')} FROM ch WHERE how = 'one'),
ra AS (SELECT id, row, x, y, greatest(1, xe - x) AS w, greatest(1, ye - y) AS h FROM rr UNION ALL SELECT id, 1, greatest(1, x1), greatest(1, y1 + t1 - 1), w, greatest(2, t2 - t1 + 1) FROM pr WHERE id IN (SELECT id FROM ch WHERE how = 'bands') UNION ALL SELECT id, 2, greatest(1, x1), greatest(1, y1 + l1 - 1), w, greatest(2, l2 - l1 + 1) FROM pr WHERE id IN (SELECT id FROM ch WHERE how = 'bands')),
rl AS (SELECT id, array_to_string(list(concat_ws('/', x::INT, y::INT, w::INT, h::INT) ORDER BY row), ' ') AS rows FROM ra GROUP BY id)
SELECT ch.id, CASE WHEN how = 'one' THEN 'single_line' ELSE 'two_row' END AS layout, CASE WHEN how = 'one' THEN 1 ELSE 2 END::INT AS count, rows, round({_CLAMP("(layout_score + coverage + (ch.id % 11)::DOUBLE / 10) / 3")}, 6) AS score,
  greatest(1, floor(x1 - w * 0.03))::DOUBLE AS text_x, greatest(1, least({WIDE}, ceil(x1 + w + w * 0.10)) - greatest(1, floor(x1 - w * 0.03)))::DOUBLE AS text_w FROM ch JOIN rl ON ch.id = rl.id"""))
def mask_description(spark, d):
    x = rectify.with_description(plate_masks(spark, d).withColumn("contrast", (F.col("id") % 11) / 10)).withColumnRenamed("description", "d")
    row = lambda b: F.concat_ws("/", *(b[k].cast("int").cast("string") for k in "xywh"))
    return x.select("id", "d.layout", "d.count", F.array_join(F.transform("d.rows", row), " ").alias("rows"), F.round("d.score", 6).alias("score"), F.col("d.text_box.x").alias("text_x"), F.col("d.text_box.w").alias("text_w"))


_COLS = "cp AS (SELECT id, 1 AS k, x AS i, avg(o::INT) AS v FROM px WHERE y BETWEEN 5 AND 21 GROUP BY id, x)"
_EDGE = f"""{_runs('cp', 0.03, '0.45', 'cr')}, e1 AS (SELECT id, (min(a) - 1)::DOUBLE / {WIDE} AS l, ({WIDE} - max(z))::DOUBLE / {WIDE} AS r, (max(z) - min(a) + 1)::DOUBLE / {WIDE} AS s FROM cr GROUP BY id)"""
_ROWS2 = f"""rp AS (SELECT id, 1 AS k, y AS i, avg(o::INT) AS v FROM px GROUP BY id, y), {_runs('rp', 0.02, '0.55', 'rr')}, {_two('rr', 'r2')},
bc AS (SELECT t.id, 'top' AS band, x, bool_or(o) AS o FROM r2 t JOIN px p ON t.id = p.id AND y BETWEEN a1 AND z1 GROUP BY t.id, x UNION ALL SELECT t.id, 'low', x, bool_or(o) FROM r2 t JOIN px p ON t.id = p.id AND y BETWEEN a2 AND z2 GROUP BY t.id, x),
bm AS (SELECT id, band, (min(x) - 1)::DOUBLE / {WIDE} AS l, ({WIDE} - max(x))::DOUBLE / {WIDE} AS r, (max(x) - min(x) + 1)::DOUBLE / {WIDE} AS s FROM bc WHERE o GROUP BY id, band),
e2 AS (SELECT r2.id, balance, apart, t.l AS tl, t.r AS tr, t.s AS ts, b.l AS bl, b.r AS br, b.s AS bs FROM r2 JOIN bm t ON r2.id = t.id AND t.band = 'top' JOIN bm b ON r2.id = b.id AND b.band = 'low'), seen AS (SELECT id, bool_or(o) AS o FROM px GROUP BY id)"""
_FOUR = lambda f: "(" + " + ".join(f(c) for c in ("tl", "tr", "bl", "br")) + ") / 4"
_SHORT = lambda c, lim: f"greatest(0.0, ({lim} - {c}) / {lim})"


@query(_double(f"""WITH {PX}, {_COLS}, {_EDGE}, {_ROWS2},
one AS (SELECT s.id, CASE WHEN l IS NULL THEN 0.30 ELSE {_CLAMP('0.40 * (0.5 * least(1.0, l / 0.05) + 0.5 * least(1.0, r / 0.05)) + 0.25 * greatest(0.0, 1 - abs(l - r) / 0.18) + 0.35 * greatest(0.0, 1 - abs(s - 0.62) / 0.24)')} END AS score,
  CASE WHEN l IS NULL THEN 0.0 ELSE {_CLAMP(f"0.30 * {_SHORT('l', '0.025')} + 0.50 * {_SHORT('r', '0.025')} + 0.20 * greatest(0.0, (s - 0.82) / 0.18)")} END AS clip, s.o FROM seen s LEFT JOIN e1 ON s.id = e1.id),
two AS (SELECT id, {_CLAMP(f"(balance + least(1.0, apart / greatest(0.10 * {HIGH}, 1)) + (greatest(0.0, 1 - abs(ts - 0.58) / 0.32) + greatest(0.0, 1 - abs(bs - 0.58) / 0.32)) / 2 + {_FOUR(lambda c: f'least(1.0, {c} / 0.03)')}) / 4")} AS score, {_CLAMP(_FOUR(lambda c: _SHORT(c, '0.015')))} AS clip FROM e2)
SELECT one.id, round(one.score, 6) AS single, round(one.clip, 6) AS single_clip, round(CASE WHEN two.score IS NOT NULL THEN two.score WHEN NOT one.o THEN 0.22 ELSE 0.65 * one.score END, 6) AS two, round(CASE WHEN two.score IS NOT NULL THEN two.clip WHEN NOT one.o THEN 0.0 ELSE one.clip END, 6) AS two_clip FROM one LEFT JOIN two ON one.id = two.id"""))
def text_bands(spark, d):
    x = plate_masks(spark, d).withColumn("p", masks.column_profile(F.slice("mask", 5, 17)))
    s = x.select("id", masks.single_band(F.col("p")).alias("a"), masks.two_row_band(F.col("mask"), F.col("p")).alias("b"))
    return s.select("id", F.round("a.score", 6).alias("single"), F.round("a.clip", 6).alias("single_clip"), F.round("b.score", 6).alias("two"), F.round("b.clip", 6).alias("two_clip"))


@query(_double(f"""WITH {PX}, {_COLS}, {_EDGE}, {_ROWS2},
one AS (SELECT s.id, s.o, CASE WHEN e1.l IS NULL THEN 0.30 ELSE {_CLAMP('0.45 * least(1.0, e1.l / 0.025) * least(1.0, e1.r / 0.025) + 0.30 * greatest(0.0, 1 - abs(e1.l - e1.r) / 0.12) + 0.25 * greatest(0.0, 1 - abs(e1.s - 0.62) / 0.28)')} END AS score, CASE WHEN e1.l IS NULL THEN 'no_text_band' ELSE 'text_band' END AS label, coalesce(e1.l, 0.0) AS l, coalesce(e1.r, 0.0) AS r FROM seen s LEFT JOIN e1 ON s.id = e1.id),
two AS (SELECT id, {_CLAMP(f"({_FOUR(lambda c: f'least(1.0, {c} / 0.02)')} + (greatest(0.0, 1 - abs(ts - 0.56) / 0.34) + greatest(0.0, 1 - abs(bs - 0.56) / 0.34)) / 2 + least(1.0, apart / greatest(0.08 * {HIGH}, 1)) + balance) / 4")} AS score, (tl + bl) / 2 AS l, (tr + br) / 2 AS r FROM e2),
f AS (SELECT o.id, CASE WHEN o.id % 7 = 0 THEN {{'s': 0.30, 'n': 'unknown', 'l': 0.0, 'r': 0.0}} WHEN o.id % 2 = 1 THEN {{'s': o.score, 'n': o.label, 'l': o.l, 'r': o.r}} WHEN t.score IS NOT NULL THEN {{'s': t.score, 'n': 'two_row_band', 'l': t.l, 'r': t.r}} WHEN NOT o.o THEN {{'s': 0.25, 'n': 'two_row_no_band', 'l': 0.0, 'r': 0.0}}
  ELSE {{'s': 0.65 * o.score, 'n': 'fallback_single_band', 'l': o.l, 'r': o.r}} END AS f FROM one o LEFT JOIN two t ON o.id = t.id)
SELECT id, round(f.s::DOUBLE, 6) AS score, f.n AS label, round(f.l::DOUBLE, 6) AS "left", round(f.r::DOUBLE, 6) AS "right" FROM f"""))
def framing_scores(spark, d):
    x = plate_masks(spark, d).withColumn("p", masks.column_profile(F.slice("mask", 5, 17)))
    f = masks.framing(F.when(F.col("id") % 7 == 0, "").otherwise("A1"), F.when(F.col("expected"), "two_row").otherwise("single_line"), F.col("mask"), F.col("p"))
    return x.select("id", f.alias("f")).select("id", F.round("f.score", 6).alias("score"), "f.label", F.round("f.left", 6).alias("left"), F.round("f.right", 6).alias("right"))


@query(_double(f"""WITH {PX}, cp AS (SELECT id, 1 AS k, x AS i, avg(o::INT) AS v FROM px GROUP BY id, x), {_runs('cp', 0.02, '0.40', 'c1')}, cm AS (SELECT *, CASE WHEN a - lag(z) OVER (PARTITION BY id ORDER BY a) - 1 <= greatest(2, round(0.08 * {WIDE})) THEN 0 ELSE 1 END AS new FROM c1),
cg AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a) AS g FROM cm), cc AS (SELECT id, g AS k, min(a) AS x1, max(z) AS x2 FROM cg GROUP BY id, g HAVING max(z) - min(a) + 1 >= 3),
rp AS (SELECT c.id, c.k, y AS i, avg(o::INT) AS v, sum(o::INT) AS filled FROM cc c JOIN px p ON c.id = p.id AND x BETWEEN x1 AND x2 GROUP BY c.id, c.k, y), {_runs('rp', 0.02, '0.35', 'rr')}, ry AS (SELECT id, k, min(a) AS y1, max(z) AS y2 FROM rr GROUP BY id, k),
fl AS (SELECT ry.id, ry.k, sum(filled) AS filled FROM ry JOIN rp ON rp.id = ry.id AND rp.k = ry.k AND i BETWEEN y1 AND y2 GROUP BY ry.id, ry.k), nb AS (SELECT c.id, c.k, count(*) AS n FROM cc c JOIN bx ON bx.id = c.id AND bx.x + bx.w / 2 BETWEEN x1 AND x2 GROUP BY c.id, c.k),
rt AS (SELECT c.id, c.k, x1, x2, y1, y2, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h, filled, coalesce(n, 0) AS n FROM cc c JOIN ry ON c.id = ry.id AND c.k = ry.k JOIN fl ON c.id = fl.id AND c.k = fl.k LEFT JOIN nb ON c.id = nb.id AND c.k = nb.k),
sc AS (SELECT *, 0.34 * least(1.0, n / 4) + 0.24 * greatest(0.0, 1 - abs(w / {WIDE} - 0.55) / 0.45) + 0.20 * greatest(0.0, 1 - abs(h / {HIGH} - 0.58) / 0.40) + 0.22 * least(1.0, filled / (w * h) / 0.42) - CASE WHEN x1 = 1 OR x2 = {WIDE} THEN 0.10 ELSE 0 END AS score FROM rt),
pk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, x1) AS place FROM sc), pd AS (SELECT id, greatest(1, x1 - 2) AS x, greatest(1, y1 - 2) AS y, least({WIDE}, x2 + 2) AS xe, least({HIGH}, y2 + 2) AS ye FROM pk WHERE place = 1)
SELECT id, x::DOUBLE AS x, y::DOUBLE AS y, greatest(2, xe - x + 1)::DOUBLE AS w, greatest(2, ye - y + 1)::DOUBLE AS h FROM pd"""))
def row_crops(spark, d):
    return plate_masks(spark, d).select("id", F.explode(F.array_compact(F.array(masks.best_crop(F.col("mask"), F.col("boxes"))))).alias("b")).select("id", "b.*")


@query(_double("""WITH s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY v) AS i, v, count(*) OVER (PARTITION BY id) AS n FROM (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v FROM embeddings)), p AS (SELECT id, n, greatest(1, least(n, n * 42 / 100 + 0.5)) AS p FROM s GROUP BY id, n)
SELECT p.id, round(a.v + (b.v - a.v) * (p - floor(p)), 9) AS dark FROM p JOIN s a ON a.id = p.id AND a.i = floor(p) JOIN s b ON b.id = p.id AND b.i = least(p.n, floor(p) + 1)"""))
def percentiles(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    return v.select("id", F.round(arrays.percentile(F.col("v"), 42), 9).alias("dark"))


def _squares(spark, d):
    """A mask of 8 rows by 8 columns of each vector."""
    v = F.transform("embedding", lambda c: c > 0)
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(v, 8 * y + 1, 8)).alias("mask"))


REGIONS = """RECURSIVE sq AS (SELECT vec_id AS id, y, x, embedding[8 * (y - 1) + x] > 0 AS o FROM embeddings, (SELECT unnest(range(1, 9)) AS y), (SELECT unnest(range(1, 9)) AS x)),
sg AS (SELECT id, y, x, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS g FROM sq WHERE o), sr AS (SELECT id, y, min(x) AS first, max(x) AS last, row_number() OVER (PARTITION BY id ORDER BY y, min(x)) AS n FROM sg GROUP BY id, y, g),
st AS (SELECT a.id, a.n AS a, b.n AS b FROM sr a JOIN sr b ON a.id = b.id AND abs(a.y - b.y) = 1 AND a.first <= b.last + 1 AND b.first <= a.last + 1),
rc AS (SELECT id, n AS a, n AS b FROM sr UNION SELECT r.id, r.a, s.b FROM rc r JOIN st s ON r.id = s.id AND r.b = s.a),
rt AS (SELECT id, a, min(b) AS root FROM rc GROUP BY id, a), lb AS (SELECT sr.*, dense_rank() OVER (PARTITION BY sr.id ORDER BY root) AS region FROM sr JOIN rt ON sr.id = rt.id AND sr.n = rt.a),
reg AS (SELECT id, region, sum(last - first + 1) AS area, min(first) AS x1, min(y) AS y1, max(last) - min(first) + 1 AS w, max(y) - min(y) + 1 AS h FROM lb GROUP BY id, region)"""


@query(_double(f"WITH {REGIONS} SELECT id, region::INT AS region, area::BIGINT AS area, x1 - 0.5 AS x, y1 - 0.5 AS y, w::DOUBLE AS w, h::DOUBLE AS h, round(area / (w * h), 6) AS extent FROM reg"))
def mask_regions(spark, d):
    x = regions.regions(regions.mask_runs(_squares(spark, d), "id"), "id")
    return x.select("id", "region", "area", "box.*", F.round("extent", 6).alias("extent"))


@query(_double(f"""WITH {REGIONS}, m AS (SELECT id, region, greatest(1.0, floor((x1 - 0.5) / 0.85)) AS x, greatest(1.0, floor((y1 - 0.5) / 0.85)) AS y, greatest(1.0, ceil(w / 0.85)) AS w, greatest(1.0, ceil(h / 0.85)) AS h FROM reg WHERE area >= 30),
n AS (SELECT id, region, x, y, CASE WHEN x + w > 640 THEN greatest(1.0, 640 - x) ELSE w END AS w, CASE WHEN y + h > 360 THEN greatest(1.0, 360 - y) ELSE h END AS h FROM m),
g AS (SELECT id, region, greatest(1.0, floor(x + w / 2 - w * 1.25 / 2)) AS x1, greatest(1.0, floor(y + h / 2 - h * 1.35 / 2)) AS y1, least(640.0, ceil(x + w / 2 + w * 1.25 / 2)) AS x2, least(360.0, ceil(y + h / 2 + h * 1.35 / 2)) AS y2 FROM n)
SELECT id, region::INT AS region, x1 AS x, y1 AS y, greatest(1.0, x2 - x1) AS w, greatest(1.0, y2 - y1) AS h FROM g"""))
def region_candidates(spark, d):
    x = regions.regions(regions.mask_runs(_squares(spark, d), "id"), "id").withColumns({"branch": F.lit("dark_priority"), "scale": F.lit(0.85)})
    return regions.candidate_boxes(x, (640, 360)).select("id", "region", "box.*")


_WITHIN = " AND ".join([f"{k} BETWEEN {a} AND {b}" for k, (a, b) in {**DEFAULTS["detection"]["valid"], "width_ratio": (0.02, 0.80)}.items()] + [f"{k} >= {a}" for k, a in DEFAULTS["detection"]["least"].items()])


@query(_double(f"""WITH {CANDIDATES}, s AS (SELECT image, seq, x, y, w, h, branch, greatest({', '.join(_final_sql(k).replace(', 6), ', ', 15), ') for k in range(len(PROFILES)))}) AS b FROM parts WHERE {_WITHIN}),
o AS (SELECT image, list({{'seq': seq, 'x': x, 'y': y, 'w': w, 'h': h, 'branch': branch, 'profile': b.profile, 'score': b.score}} ORDER BY round(b.score, 12) DESC, seq) AS c FROM s GROUP BY image),
r AS (SELECT image, list_reduce(list_transform(c, lambda e: [e]), lambda acc, e: CASE WHEN len(acc) >= 40 OR len(list_filter(acc, lambda a: {IOU('a', 'e[1]')} >= 0.6 * (a.w * a.h + e[1].w * e[1].h - {IOU('a', 'e[1]')}))) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM o),
u AS (SELECT image, unnest(k[1:10]) AS e, unnest(range(1, 1 + least(10, len(k)))) AS rank FROM r)
SELECT image, rank::INT AS rank, e.seq AS seq, e.branch AS branch, e.profile AS profile, round(e.score, 9) AS score FROM u"""))
def detect_candidates(spark, d):
    own = {**DEFAULTS, "detection": {**DEFAULTS["detection"], "valid": {**DEFAULTS["detection"]["valid"], "width_ratio": (0.02, 0.80)}}}
    x = detect.detected(_candidates(spark, d), own)
    return x.select("image", "rank", "seq", "branch", "profile", F.round("score", 9).alias("score"))


_VALUES = lambda specs: ", ".join(f"({i + 1}, " + ", ".join(f"'{v}'" for v in x) + ")" for i, x in enumerate(specs))


@query(f"""WITH c AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS t, c_custkey % 3 = 0 AS r FROM customer), a(n, name, layout, source, picture) AS (VALUES {_VALUES(variants.WHOLE)}), b(n, name, layout, source, picture) AS (VALUES {_VALUES(variants.TEXT_ONLY)}), e(n, name, layout, source, picture) AS (VALUES {_VALUES(variants.COMPOSITE)}),
u AS (SELECT id, n AS attempt, name, layout, source, picture FROM c, a UNION ALL SELECT id, {len(variants.WHOLE)} + n, name, layout, source, picture FROM c, b WHERE t UNION ALL SELECT id, {len(variants.WHOLE)} + CASE WHEN t THEN {len(variants.TEXT_ONLY)} ELSE 0 END + n, name, layout, source, picture FROM c, e WHERE r)
SELECT id, attempt::INT AS attempt, name, layout, source, picture FROM u""")
def plate_variants(spark, d):
    k = F.col("c_custkey")
    return variants.plate_variants(_t(spark, d, "customer").select(k.alias("id"), (k % 2 == 0).alias("has_text"), (k % 3 == 0).alias("has_rows")), "id")


@query(f"""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS rows, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS two FROM customer), x AS (SELECT id, two, unnest(range(1, rows + 1)) AS row FROM c WHERE rows >= 2), a(n, name, layout, picture) AS (VALUES {_VALUES(variants.ROW)}), b(n, name, layout, picture) AS (VALUES {_VALUES(variants.TOP_ROW)}), e(n, name, layout, picture) AS (VALUES {_VALUES(variants.LOW_ROW)}),
u AS (SELECT id, row, n, name, layout, picture, NULL AS characters FROM x, a UNION ALL SELECT id, row, {len(variants.ROW)} + n, name, layout, picture, '{variants.LETTERS}' FROM x, b WHERE two AND row = 1 UNION ALL SELECT id, row, {len(variants.ROW)} + n, name, layout, picture, '{variants.DIGITS}' FROM x, e WHERE two AND row = 2)
SELECT id, row::INT AS row, n::INT AS attempt, name, layout, picture, characters FROM u""")
def row_variants(spark, d):
    k = F.col("c_custkey")
    hints = _t(spark, d, "customer").select(k.alias("id"), (k % 4).cast("int").alias("rows"), F.when(k % 3 == 0, "two_row").otherwise("").alias("layout"), F.when(k % 5 == 0, "two_row").otherwise("single_line").alias("profile"))
    return variants.row_variants(hints, "id")


@query(_double("""WITH e AS (SELECT vec_id AS id, abs(embedding[1]::DOUBLE) AS ba, abs(embedding[2]::DOUBLE) AS bc, abs(embedding[3]::DOUBLE) AS bd, abs(embedding[4]::DOUBLE) AS da, abs(embedding[5]::DOUBLE) AS dc, abs(embedding[6]::DOUBLE) AS dd, abs(embedding[7]::DOUBLE) AS v, abs(embedding[8]::DOUBLE) AS g FROM embeddings),
p AS (SELECT *, 0.58 * ba + 0.42 * bc >= 0.58 * da + 0.42 * dc AS bright FROM e), q AS (SELECT id, bright, CASE WHEN bright THEN ba ELSE da END AS a, CASE WHEN bright THEN bc ELSE dc END AS c, (least(1.0, v / 0.10) + least(1.0, g / 0.12) + CASE WHEN bright THEN bd ELSE dd END) / 3 AS t FROM p)
SELECT id, round(t, 6) AS texture, round(c, 6) AS contrast, round(a, 6) AS alignment, round(1 - (t + c + a) / 3, 6) AS empty, CASE WHEN bright THEN 'single_line' ELSE 'two_row' END AS layout FROM q"""))
def text_evidence(spark, d):
    x = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: F.abs(c.cast("double"))).alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    side = lambda k, name, n: F.struct(at(k).alias("alignment"), at(k + 1).alias("contrast"), at(k + 2).alias("density"), F.lit(n).alias("count"), F.lit(name).alias("layout"), F.lit(n).alias("rows"), at(k).alias("single"), at(k).alias("two"))
    e = x.select("id", layout.text_evidence(side(0, "single_line", 1), side(3, "two_row", 2), at(6), at(7)).alias("e"))
    return e.select("id", *(F.round(f"e.{k}", 6).alias(k) for k in ("texture", "contrast", "alignment", "empty")), "e.layout")
