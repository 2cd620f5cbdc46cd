"""The reference's operators as queries over the driver's tables, each with the same in SQL.

No plates or images lie in those tables, so texts, boxes and attempts are derived from orders and lineitem, profiles from
embeddings, annotations from labels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow import recognition
from plateflow.functions import arrays, geometry, layout, text
from plateflow.operators import attempts, detect, evaluate, repair, rerank
from plateflow.plans.dims import BRANCHES, PROFILES, RULES, branches
from plateflow.settings import DEFAULTS, settings

LEADS, ALPHABET = "ABCDEFJKLMNPQRSTVWZI", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCALES = (0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(letters: str, n) -> F.Column:
    return F.substring(F.lit(letters), (1 + n).cast("int"), F.lit(1))


def plates(spark: SparkSession, d: str) -> DataFrame:
    """k, t: a made-up plate for each order."""
    k = F.col("o_orderkey")
    t = F.concat(_pick(LEADS, k % 20), _pick(ALPHABET, F.col("o_custkey") % 26), F.when(k % 3 == 0, "X").otherwise(""), ((k * 7919) % 10000).cast("string"), F.when(k % 7 == 0, "R").otherwise(""))
    return _t(spark, d, "orders").select(k.alias("k"), t.alias("t"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """image, seq, x, y, w, h, score, box: made-up candidates for each order."""
    by = Window.partitionBy("image").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    c = lambda e, n: e.cast("double").alias(n)
    lines = _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "image").withColumn("seq", F.row_number().over(by))
    rows = lines.select("image", "seq", c(F.col("l_partkey") % 40, "x"), c(F.col("l_suppkey") % 20, "y"), c(F.col("l_quantity") * 6, "w"), c(F.col("l_quantity") * 2, "h"), c(F.floor("l_extendedprice") / 100000, "score"))
    return rows.withColumn("box", F.struct("x", "y", "w", "h"))


def tries(spark: SparkSession, d: str) -> DataFrame:
    """cand, seq, source, text, conf: made-up attempts at reading each order's plate."""
    sources = F.array(*(F.lit(x) for x in attempts.SUPPORT))
    lines = boxes(spark, d).select(F.col("image").alias("cand"), "seq", "w")
    t = F.when(F.col("seq") % 3 == 0, F.translate("t", "0125", "OIZS")).when(F.col("seq") % 3 == 1, F.col("t")).otherwise(F.substring("t", 1, 5))
    joined = lines.join(plates(spark, d), F.col("cand") == F.col("k"))
    return joined.select("cand", "seq", F.get(sources, (F.col("seq") % 6).cast("int")).alias("source"), t.alias("text"), F.round(F.col("w") / 300, 6).alias("conf"))


def masks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("v")).withColumn("m", F.transform("v", lambda v: v > 0))


P = f"""plates AS (SELECT o_orderkey AS k, concat(substr('{LEADS}', 1 + (o_orderkey % 20)::INT, 1), substr('{ALPHABET}', 1 + (o_custkey % 26)::INT, 1),
  CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE '' END, ((o_orderkey * 7919) % 10000)::VARCHAR, CASE WHEN o_orderkey % 7 = 0 THEN 'R' ELSE '' END) AS t FROM orders)"""
B = """boxes AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)::INT AS seq,
  (l_partkey % 40)::DOUBLE AS x, (l_suppkey % 20)::DOUBLE AS y, (l_quantity * 6)::DOUBLE AS w, (l_quantity * 2)::DOUBLE AS h, floor(l_extendedprice)::DOUBLE / 100000 AS score FROM lineitem)"""
_SOURCES = "[" + ", ".join(f"'{x}'" for x in attempts.SUPPORT) + "]"
A = f"""{P}, {B}, tries AS (SELECT image AS cand, seq, {_SOURCES}[1 + seq % 6] AS source,
  CASE WHEN seq % 3 = 0 THEN translate(t, '0125', 'OIZS') WHEN seq % 3 = 1 THEN t ELSE substr(t, 1, 5) END AS text, round(w / 300, 6) AS conf FROM boxes JOIN plates ON image = k)"""
M = "masks AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings)"


def _shape(t: str) -> dict[str, str]:
    rest = f"regexp_replace({t}, '^[A-Z]*[0-9]*', '')"
    return {"p": f"length(regexp_extract({t}, '^([A-Z]*)', 1))", "d": f"length(regexp_extract({t}, '^[A-Z]*([0-9]*)', 1))", "s": f"length(regexp_replace({rest}, '[^A-Z]', '', 'g'))", "o": f"length({rest}) = length(regexp_replace({rest}, '[^A-Z]', '', 'g'))"}


def _rule(t: str, place: int, other: str) -> str:
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    whens = " ".join(f"WHEN {f"regexp_matches({t}, '{r[3]}')" if r[2] == 'pattern' else f"starts_with({t}, '{r[3]}')"} THEN {quoted(r[place])}" for r in RULES)
    return f"CASE {whens} ELSE {other} END"


def _norm(c: str) -> str:
    return f"upper(regexp_replace(coalesce({c}, ''), '[^A-Z0-9]', '', 'g'))"


S = _shape("t")
SHAPED = f"{P}, shaped AS (SELECT k, t, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o, length(t) AS n FROM plates)"
LZ = "(o AND d >= 2 AND regexp_matches(t, '^[A-Z]*0'))"
EXACT, PARTIAL = f"regexp_matches(t, '{text.EXACT}')", f"regexp_matches(t, '{text.PARTIAL}')"
IOU = lambda a, b: f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
QUERIES, SQL = {}, {}


def _double(sql: str) -> str:
    """sql with its decimal numbers as doubles, as Spark has them."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.:'])", r"\1::DOUBLE", sql)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT c_custkey AS k, {_norm('c_name')} AS t FROM customer UNION ALL SELECT n_nationkey, {_norm('n_name')} FROM nation")
def norm_text(spark, d):
    names = _t(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("t"))
    return names.unionByName(_t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("t"))).select("k", text.norm(F.col("t")).alias("t"))


@query(f"WITH {SHAPED} SELECT k, t, p::INT AS p, d::INT AS d, s::INT AS s, o AS ordered FROM shaped")
def text_shape(spark, d):
    return plates(spark, d).withColumn("x", text.shape(F.col("t"))).select("k", "t", "x.*")


@query(f"WITH {P} SELECT k, t, {_rule('t', 0, chr(39) + 'Unknown' + chr(39))} AS name, {_rule('t', 1, chr(39) + 'Unknown' + chr(39))} AS category, {_rule('t', 4, '0')}::INT AS priority, {_rule('t', 4, '0')} > 0 AS matched FROM plates")
def state_first_match(spark, d):
    return plates(spark, d).withColumn("x", text.identify_state(F.col("t"))).select("k", "t", "x.*")


@query(f"WITH {P} SELECT {_rule('t', 0, chr(39) + 'Unknown' + chr(39))} AS name, count(*)::BIGINT AS plates FROM plates GROUP BY 1")
def state_counts(spark, d):
    return plates(spark, d).select(text.identify_state(F.col("t"))["name"].alias("name")).groupBy("name").agg(F.count("*").alias("plates"))


_ANY = " OR ".join(f"starts_with(t, '{r[3]}')" for r in RULES)
_LETTERS = "length(regexp_replace(t, '[^A-Z]', '', 'g'))"
LENGTH = "CASE WHEN n = 0 THEN 0.0 WHEN n BETWEEN 4 AND 8 THEN greatest(0.35, 1 - 0.22 * abs(n - 6.5)) ELSE greatest(0, 0.55 - 0.18 * abs(n - 6.5)) END"
COMPOSITION = f"""(CASE WHEN n = 0 THEN 0.0 WHEN {_LETTERS} BETWEEN 1 AND 4 AND n - {_LETTERS} BETWEEN 3 AND 4 AND n BETWEEN 5 AND 8 THEN 1.0 WHEN {_LETTERS} >= 1 AND n > {_LETTERS} THEN 0.55
  WHEN n = {_LETTERS} THEN 0.15 ELSE 0.10 END * CASE WHEN n BETWEEN 4 AND 8 THEN 1.0 ELSE 0.75 END)"""
STRUCTURE = f"""CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.42 * CASE p WHEN 0 THEN 0.0 WHEN 1 THEN 0.42 WHEN 2 THEN 0.75 WHEN 3 THEN 1.0 WHEN 4 THEN 0.88 ELSE greatest(0.15, 0.80 - 0.12 * abs(p - 3)) END
  + 0.28 * CASE d WHEN 0 THEN 0.0 WHEN 1 THEN 0.20 WHEN 2 THEN 0.35 WHEN 3 THEN 0.82 WHEN 4 THEN 1.0 ELSE greatest(0.15, 0.85 - 0.15 * abs(d - 4)) END + 0.12 * CASE s WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.05 END
  + CASE WHEN o THEN 0.10 ELSE 0 END + 0.08 * least(1.0, n / 4.0) - CASE WHEN {LZ} THEN 0.35 ELSE 0 END)) END"""


@query(f"WITH {SHAPED} SELECT k, round((CASE WHEN n = 0 THEN 0.0 WHEN {EXACT} THEN 1.0 WHEN {PARTIAL} THEN 0.6 WHEN {_ANY} THEN 0.4 ELSE 0.05 END)::DOUBLE, 6) AS score FROM shaped")
def plate_regex_score(spark, d):
    return plates(spark, d).select("k", F.round(text.regex_score(F.col("t")), 6).alias("score"))


@query(f"WITH {SHAPED} SELECT k, round({COMPOSITION}::DOUBLE, 6) AS score FROM shaped")
def composition_score(spark, d):
    return plates(spark, d).select("k", F.round(text.composition_score(F.col("t")), 6).alias("score"))


@query(f"WITH {SHAPED} SELECT k, round(({LENGTH})::DOUBLE, 6) AS score FROM shaped")
def length_score(spark, d):
    return plates(spark, d).select("k", F.round(text.length_score(F.col("t")), 6).alias("score"))


@query(f"WITH {SHAPED} SELECT k, round(({STRUCTURE})::DOUBLE, 6) AS score FROM shaped")
def structure_score(spark, d):
    return plates(spark, d).select("k", F.round(text.structure_score(F.col("t")), 6).alias("score"))


@query(f"WITH {P} SELECT k, CASE WHEN {_rule('t', 4, '0')} > 0 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS score FROM plates")
def prefix_plausibility(spark, d):
    return plates(spark, d).select("k", text.prefix_plausibility(F.col("t")).alias("score"))


@query(f"WITH {P} SELECT k, translate(t, '0125678', 'OIZSGTB') AS letters, translate(t, 'OQDUILTZSGB', '00001112568') AS digits FROM plates")
def region_maps(spark, d):
    return plates(spark, d).select("k", text.as_letters(F.col("t")).alias("letters"), text.as_digits(F.col("t")).alias("digits"))


_ALIKE = " OR ".join(f"(contains('{g}', substr(a, i, 1)) AND contains('{g}', substr('IIUM', i, 1)))" for g in text.ALIKE)


@query(f"""WITH {P}, x AS (SELECT k, substr(t, 1, 4) AS a FROM plates), y AS (SELECT k, a, unnest(range(1, 1 + least(length(a), 4))) AS i FROM x)
SELECT k, round(least(1.0, greatest(0.0, (sum(CASE WHEN substr(a, i, 1) = substr('IIUM', i, 1) THEN 1.0 WHEN {_ALIKE} THEN 0.6 ELSE -0.2 END)::DOUBLE - 0.35 * (4 - max(length(a)))) / 4)), 6) AS score FROM y GROUP BY k""")
def visual_similarity(spark, d):
    return plates(spark, d).select("k", F.round(text.visual_similarity(F.substring("t", 1, 4), F.lit("IIUM")), 6).alias("score"))


@query(f"""WITH {P}, x AS (SELECT k, t AS a, translate(t, '0125678', 'OIZSGTB') || CASE WHEN k % 2 = 0 THEN 'X' ELSE '' END AS b FROM plates), y AS (SELECT *, unnest(range(1, 1 + least(length(a), length(b)))) AS i FROM x)
SELECT k, (sum((substr(a, i, 1) <> substr(b, i, 1))::INT) + max(abs(length(a) - length(b))))::INT AS edits FROM y GROUP BY k""")
def edit_count(spark, d):
    b = F.concat(text.as_letters(F.col("t")), F.when(F.col("k") % 2 == 0, "X").otherwise(""))
    return plates(spark, d).select("k", text.edit_count(F.col("t"), b).cast("int").alias("edits"))


_CANDS = f"""{P}, cands AS (SELECT DISTINCT k, t AS orig, c AS t FROM (SELECT k, t, t AS c FROM plates UNION ALL
  SELECT k, t, translate(substr(t, 1, p), '0125678', 'OIZSGTB') || translate(substr(t, p + 1, d), 'OQDUILTZSGB', '00001112568') || translate(substr(t, p + d + 1, s), '0125678', 'OIZSGTB')
  FROM plates, (SELECT unnest(range(1, 5)) AS p), (SELECT unnest(range(1, 5)) AS d), (SELECT unnest([0, 1]) AS s) WHERE p + d + s = length(t)))"""


@query(f"WITH {_CANDS} SELECT k, string_agg(t, ',' ORDER BY t) AS candidates FROM cands GROUP BY k")
def repair_candidates(spark, d):
    return plates(spark, d).select("k", F.array_join(text.repair_candidates(F.col("t")), ",").alias("candidates"))


_O = _shape("orig")
_REPAIR = f"""(0.42 * CASE WHEN {EXACT} THEN 1.0 WHEN {PARTIAL} THEN 0.55 ELSE 0 END + 0.24 * greatest(0, 1 - 0.18 * abs(length(t) - 7)) + 0.14 * least(1.0, ({_rule('t', 4, '0')}) / 100.0)
  + 0.20 * greatest(0, greatest(0, CASE WHEN o THEN 0.22 ELSE 0 END + CASE WHEN p BETWEEN 1 AND 4 THEN 0.16 ELSE 0 END + CASE WHEN d BETWEEN 1 AND 4 THEN 0.16 ELSE 0 END + CASE WHEN s <= 1 THEN 0.08 ELSE 0 END
    + CASE WHEN p BETWEEN 2 AND 3 THEN 0.20 ELSE 0 END + CASE WHEN d BETWEEN 3 AND 4 THEN 0.18 ELSE 0 END + CASE WHEN s = 0 THEN 0.08 ELSE 0 END - CASE WHEN {LZ} THEN 0.35 ELSE 0 END)
    - CASE WHEN {_O['o']} AND {_O['p']} >= 3 AND {_O['d']} > 0 AND {_O['d']} < 3 AND p < {_O['p']} THEN 0.18 ELSE 0 END))::DOUBLE"""
_BONUS = f"CASE WHEN length({_rule('t', 3, chr(39) * 2)}) > 1 THEN CASE WHEN ({_rule('t', 4, '0')}) >= 90 THEN 0.22 ELSE 0.18 END ELSE 0 END"


def _repair_sql(cands: str) -> str:
    return f"""WITH {cands}, f AS (SELECT k, orig, t, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o,
  list_sum(list_transform(range(1, 1 + least(length(t), length(orig))), lambda i: (substr(t, i, 1) <> substr(orig, i, 1))::INT)) + abs(length(t) - length(orig)) AS edits FROM cands),
g AS (SELECT k, orig, t, {_REPAIR} + CASE WHEN t = orig THEN 0 ELSE {_BONUS} - 0.015 * edits END AS score FROM f),
h AS (SELECT k, orig, list_prepend({{'t': orig, 'score': max(CASE WHEN t = orig THEN score END)}}, list({{'t': t, 'score': score}} ORDER BY t)) AS c FROM g GROUP BY k, orig),
r AS (SELECT k, orig, list_reduce(c, lambda acc, x: CASE WHEN x.t <> orig AND x.score > acc.score + 0.005 THEN x ELSE acc END) AS best FROM h)
SELECT k, best.t AS text, round(best.score, 6) AS score, best.t <> orig AS changed FROM r"""


def _repaired(spark, d, attempted=None):
    x = plates(spark, d).withColumn("gain", text.least_gain(F.lit(0.42), F.lit("two_row")))
    x = x.withColumn("attempted", attempted) if attempted is not None else x
    return repair.repaired(x, "k", "t", "gain", "attempted" if attempted is not None else None).select("k", "text", F.round("score", 6).alias("score"), "changed")


@query(_repair_sql(_CANDS))
def repair_fold(spark, d):
    return _repaired(spark, d)


# Every third plate has also been read as another one with digits for letters, every fifth as one that begins like a longer token.
_OTHERS = "(SELECT k, t AS orig, t AS src FROM plates UNION ALL SELECT k, t, translate(t, 'BSZ', '852') FROM plates WHERE k % 3 = 0 UNION ALL SELECT k, t, 'LLUN' || (k % 9000 + 1000)::VARCHAR FROM plates WHERE k % 5 = 0)"
_TAIL, _HEAD = "regexp_extract(src, '([0-9]{1,4}[A-Z]?)$', 1)", "substr(src, 1, length(src) - length(regexp_extract(src, '([0-9]{1,4}[A-Z]?)$', 1)))"
_LIKE = " OR ".join(f"(contains('{g}', substr(a, i, 1)) AND contains('{g}', substr('IIUM', i, 1)))" for g in text.ALIKE)
_MORE = f"""{P}, src AS (SELECT DISTINCT * FROM {_OTHERS}), heads AS (SELECT k, orig, src, {_HEAD} AS head, {_TAIL} AS tail FROM src),
  win AS (SELECT k, orig, src, tail, j, substr(head, j, 4) AS a FROM (SELECT *, unnest(range(1, 1 + greatest(1, length(head) - 3))) AS j FROM heads WHERE head <> '' AND tail <> '')),
  sim AS (SELECT k, orig, src, tail, j, least(1.0, greatest(0.0, (sum(CASE WHEN substr(a, i, 1) = substr('IIUM', i, 1) THEN 1.0 WHEN {_LIKE} THEN 0.6 ELSE -0.2 END)::DOUBLE - 0.35 * (4 - max(length(a)))) / 4)) AS s
    FROM (SELECT *, unnest(range(1, 1 + length(a))) AS i FROM win) GROUP BY ALL),
  guided AS (SELECT DISTINCT k, orig, 'IIUM' || tail AS t FROM sim WHERE s >= 0.54),
  cands AS (SELECT DISTINCT k, orig, t FROM (SELECT k, orig, src AS t FROM src UNION ALL SELECT * FROM guided UNION ALL
    SELECT k, orig, translate(substr(src, 1, p), '0125678', 'OIZSGTB') || translate(substr(src, p + 1, d), 'OQDUILTZSGB', '00001112568') || translate(substr(src, p + d + 1, s), '0125678', 'OIZSGTB')
    FROM src, (SELECT unnest(range(1, 5)) AS p), (SELECT unnest(range(1, 5)) AS d), (SELECT unnest([0, 1]) AS s) WHERE p + d + s = length(src)))"""


@query(_repair_sql(_MORE))
def repair_attempted(spark, d):
    k, t = F.col("k"), F.col("t")
    others = F.array_compact(F.array(F.when(k % 3 == 0, F.translate(t, "BSZ", "852")), F.when(k % 5 == 0, F.concat(F.lit("LLUN"), (k % 9000 + 1000).cast("string")))))
    return _repaired(spark, d, others)


@query(f"WITH {_MORE} SELECT k, string_agg(DISTINCT t, ',' ORDER BY t) AS candidates FROM guided GROUP BY k")
def rule_candidates(spark, d):
    k, t = F.col("k"), F.col("t")
    others = F.array_compact(F.array(t, F.when(k % 3 == 0, F.translate(t, "BSZ", "852")), F.when(k % 5 == 0, F.concat(F.lit("LLUN"), (k % 9000 + 1000).cast("string")))))
    found = plates(spark, d).select("k", F.array_sort(F.array_distinct(F.flatten(F.transform(others, text.rule_candidates)))).alias("c"))
    return found.where(F.size("c") > 0).select("k", F.array_join("c", ",").alias("candidates"))


def _measured(spark, d):
    b = boxes(spark, d)
    return b.select("image", "seq", (F.col("w") / F.col("h") * (1 + F.col("x") / 20)).alias("aspect"), (F.col("w") / 640).alias("width_ratio"), (F.col("h") / 640).alias("height_ratio"), (F.col("w") * F.col("h") / 640 / 360).alias("area_ratio"), (F.col("x") / 40).alias("extent"), (F.col("y") / 20).alias("solidity"))


MEASURED = f"{B}, measured AS (SELECT image, seq, w / h * (1 + x / 20) AS aspect, w / 640 AS width_ratio, h / 640 AS height_ratio, w * h / 640 / 360 AS area_ratio, x / 40 AS extent, y / 20 AS solidity FROM boxes)"


@query(f"WITH {MEASURED} SELECT image, seq FROM measured WHERE " + " AND ".join([f"{k} BETWEEN {a} AND {b}" for k, (a, b) in DEFAULTS["detection"]["valid"].items()] + [f"{k} >= {a}" for k, a in DEFAULTS["detection"]["least"].items()]))
def candidate_validity(spark, d):
    return detect.valid(_measured(spark, d)).select("image", "seq")


_FIT = lambda v: f"CASE WHEN {v} < lo THEN greatest(0, 0.30 - (lo - {v}) / abs(lo)) WHEN {v} > hi THEN greatest(0, 0.30 - ({v} - hi) / abs(hi)) ELSE greatest(0.35, 1 - 0.9 * abs({v} - target) / (hi - lo)) END"
_FITS = ", ".join(f"({k}, '{p[0]}', " + ", ".join(f"{x}::DOUBLE" for m in p[1:] for x in m) + ")" for k, p in enumerate(PROFILES))
PREFIXES = ("as_", "wr_", "hr_", "ar_")
_NAMES = ", ".join(f"{m}{x}" for m in PREFIXES for x in ("t", "l", "h"))


def _fit_sql(v: str, m: str) -> str:
    return _FIT(v).replace("target", f"{m}t").replace("lo)", f"{m}l)").replace("hi)", f"{m}h)").replace("< lo", f"< {m}l").replace("> hi", f"> {m}h").replace("(lo -", f"({m}l -").replace("- hi)", f"- {m}h)").replace("(hi - ", f"({m}h - ")


@query(f"""WITH {MEASURED}, prof(n, profile, {_NAMES}) AS (VALUES {_FITS}),
s AS (SELECT image, seq, profile, n, round(({" + ".join(_fit_sql(v, m) for v, m in zip(("aspect", "width_ratio", "height_ratio", "area_ratio"), PREFIXES, strict=True))}) / 4, 6) AS geometry FROM measured, prof),
r AS (SELECT *, row_number() OVER (PARTITION BY image, seq ORDER BY geometry DESC, n) AS k FROM s) SELECT image, seq, profile, geometry FROM r WHERE k = 1""")
def profile_fit_argmax(spark, d):
    return detect.with_profile(_measured(spark, d)).select("image", "seq", "profile", "geometry")


@query(f"SELECT n_nationkey AS image, s.i::INT AS scale_seq, b.j::INT AS branch_seq, {list(BRANCHES)!r}[1 + b.j] AS branch FROM nation, (SELECT unnest(range(0, {len(SCALES)})) AS i) s, (SELECT unnest(range(0, {len(BRANCHES)})) AS j) b")
def branch_expand(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("image")).crossJoin(F.broadcast(branches(spark, SCALES))).select("image", "scale_seq", "branch_seq", "branch")


@query(f"""WITH {B}, e AS (SELECT image, seq, greatest(1.0, floor(x + w / 2 - w * 1.2 / 2)) AS x1, greatest(1.0, floor(y + h / 2 - h * 1.4 / 2)) AS y1, least(640.0, ceil(x + w / 2 + w * 1.2 / 2)) AS x2, least(360.0, ceil(y + h / 2 + h * 1.4 / 2)) AS y2 FROM boxes)
SELECT image, seq, x1 AS x, y1 AS y, greatest(1.0, x2 - x1) AS w, greatest(1.0, y2 - y1) AS h FROM e""")
def box_pad(spark, d):
    return boxes(spark, d).select("image", "seq", geometry.expand(F.col("box"), 1.2, 1.4, 640, 360).alias("b")).select("image", "seq", "b.*")


@query(f"""WITH {B}, m AS (SELECT image, seq, greatest(1.0, floor(x / 1.25)) AS x, greatest(1.0, floor(y / 1.25)) AS y, greatest(1.0, ceil(w / 1.25)) AS w, greatest(1.0, ceil(h / 1.25)) AS h FROM boxes)
SELECT image, seq, x, y, CASE WHEN x + w > 200 THEN greatest(1.0, 200 - x) ELSE w END AS w, CASE WHEN y + h > 60 THEN greatest(1.0, 60 - y) ELSE h END AS h FROM m""")
def box_map(spark, d):
    return boxes(spark, d).select("image", "seq", geometry.to_original(F.col("box"), F.lit(1.25), 200, 60).alias("b")).select("image", "seq", "b.*")


@query(f"""WITH {B}, p AS (SELECT a.image, a.seq AS a, b.seq AS b, {IOU('a', 'b')} AS i, a.w * a.h AS p, b.w * b.h AS q FROM boxes a JOIN boxes b ON a.image = b.image AND a.seq < b.seq),
o AS (SELECT image, a, b, greatest(CASE WHEN p + q - i <= 0 THEN 0 ELSE i / (p + q - i) END, i / greatest(least(p, q), 2.220446049250313e-16)) AS overlap FROM p) SELECT image, a, b, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.42""")
def iou_pairs(spark, d):
    return rerank.overlap_pairs(boxes(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH {B}, o AS (SELECT image, list({{'seq': seq, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY score DESC, seq) AS c FROM boxes GROUP BY image),
r AS (SELECT image, list_reduce(list_transform(c, lambda e: [e]), lambda acc, e: CASE WHEN len(acc) >= 40 OR len(list_filter(acc, lambda a: {IOU('a', 'e[1]')} >= 0.6 * (a.w * a.h + e[1].w * e[1].h - {IOU('a', 'e[1]')}))) > 0 THEN acc ELSE list_concat(acc, e) END) AS k FROM o)
SELECT image, list_transform(k, lambda e: e.seq)::VARCHAR AS kept FROM r""")
def nms(spark, d):
    return detect.nms(boxes(spark, d)).select("image", F.concat(F.lit("["), F.array_join(F.transform("kept", lambda e: e["seq"].cast("string")), ", "), F.lit("]")).alias("kept"))


@query(f"WITH {B}, r AS (SELECT image, seq, row_number() OVER (PARTITION BY image ORDER BY score DESC, seq)::INT AS rank FROM boxes) SELECT * FROM r WHERE rank <= 3")
def topk_candidates(spark, d):
    return detect.top_k(boxes(spark, d), 3).select("image", "seq", "rank")


def _texted(spark, d):
    return boxes(spark, d).join(plates(spark, d), F.col("image") == F.col("k")).select("image", "seq", "box", "score", F.substring(F.col("t"), F.lit(1), 2 + F.col("seq") % 5).alias("text"))


TEXTED = f"{P}, {B}, texted AS (SELECT image, seq, x, y, w, h, score, substr(t, 1, 2 + seq % 5) AS text FROM boxes JOIN plates ON image = k)"
def _adjusted(suffix: bool) -> str:
    """Deltas and reasons of each pair in order of score."""
    bad = lambda x, y: f"(starts_with({x}, {y}) AND regexp_matches({x}, '^[A-Z]*[0-9]*[A-Z]+$') AND regexp_matches({y}, '^[A-Z]{{1,4}}[0-9]{{1,4}}$'))"
    gain = lambda v, why: f"{{'d': {v}::DOUBLE, 'why': ', Adj={why}({v:.2f})'}}"
    longer = shorter = ""
    fuller, part = gain(0.08, "overlap_fuller_text_bonus"), gain(-0.16, "overlap_substring_penalty")
    if not suffix:
        longer, shorter = f"WHEN {bad('x', 'y')} THEN {gain(-0.18, 'overlap_forbidden_suffix_penalty')}", f"WHEN {bad('y', 'x')} THEN {gain(0.10, 'overlap_exact_base_bonus')}"
    return f"""{TEXTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, seq) AS r FROM texted),
p AS (SELECT a.image, a.seq, a.r AS a, b.r AS b, a.text AS x, b.text AS y, {IOU('a', 'b')} AS i, a.w * a.h AS p, b.w * b.h AS q FROM ranked a JOIN ranked b ON a.image = b.image AND a.seq <> b.seq),
o AS (SELECT *, CASE WHEN length(x) > length(y) AND contains(x, y) AND y <> '' THEN CASE {longer} WHEN true THEN {fuller} END WHEN length(y) > length(x) AND contains(y, x) AND x <> '' THEN CASE {shorter} WHEN true THEN {part} END END AS g
  FROM p WHERE greatest(CASE WHEN p + q - i <= 0 THEN 0 ELSE i / (p + q - i) END, i / greatest(least(p, q), 2.220446049250313e-16)) >= 0.42),
l AS (SELECT image, seq, list(g.d ORDER BY b) AS ds, string_agg(g.why, '' ORDER BY b) AS reason FROM o WHERE g IS NOT NULL GROUP BY image, seq),
adj AS (SELECT x.image, x.seq, round(CASE WHEN ds IS NULL THEN score ELSE list_reduce(list_prepend(score, ds), lambda acc, v: least(1.0, greatest(0.0, acc + v))) END, 6) AS score, coalesce(reason, '') AS reason FROM texted x LEFT JOIN l ON x.image = l.image AND x.seq = l.seq)"""


ADJUSTED = _adjusted(True)


def _moved(x):
    return x.select("image", "seq", F.round("score", 6).alias("score"), "reason")


@query(f"WITH {ADJUSTED} SELECT * FROM adj")
def overlap_adjust(spark, d):
    return _moved(rerank.adjusted(_texted(spark, d)))


@query(f"WITH {_adjusted(False)} SELECT * FROM adj")
def overlap_adjust_no_suffix(spark, d):
    return _moved(rerank.adjusted(_texted(spark, d), settings({"classification": {"suffix_letter": False}})))


@query(f"WITH {ADJUSTED}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, seq) AS k FROM adj) SELECT image, seq, score FROM r WHERE k = 1")
def rerank_select(spark, d):
    return rerank.selected(_moved(rerank.adjusted(_texted(spark, d))))


_T = A.replace("tries AS (", "raw AS (") + f", shaped AS (SELECT *, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o, length(t) AS n FROM (SELECT cand, seq, source, {_norm('text')} AS t, conf FROM raw))"
_ATTEMPT = f"""CASE WHEN n = 0 THEN -1 ELSE conf + CASE WHEN {EXACT} THEN 0.40 WHEN {PARTIAL} THEN 0.22 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]') THEN 0.18 ELSE 0 END
  + CASE WHEN o THEN 0.12 ELSE 0 END + CASE WHEN p BETWEEN 2 AND 3 THEN 0.16 WHEN p = 1 THEN 0.04 ELSE 0 END + CASE WHEN d BETWEEN 3 AND 4 THEN 0.10 WHEN d >= 1 THEN 0.03 ELSE 0 END - 0.06 * s
  + CASE WHEN s = 0 AND o AND p BETWEEN 1 AND 4 AND d BETWEEN 1 AND 4 THEN 0.08 ELSE 0 END - 0.10 * abs(n - 7) - CASE WHEN n < 5 THEN 0.18 ELSE 0 END - CASE WHEN p <= 1 AND n <= 5 THEN 0.16 ELSE 0 END
  - CASE WHEN p = 0 AND regexp_matches(t, '[0-9]') THEN 0.12 ELSE 0 END - CASE WHEN {LZ} THEN 0.12 ELSE 0 END END"""


@query(f"WITH {_T}, sc AS (SELECT cand, seq, t AS text, round(({_ATTEMPT})::DOUBLE, 6) AS score FROM shaped), r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, seq) AS k FROM sc) SELECT cand, seq, text, score FROM r WHERE k = 1")
def attempt_argmax(spark, d):
    return attempts.best_attempt(tries(spark, d))


_W = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in attempts.SUPPORT.items()) + " ELSE 0.35 END"


@query(f"WITH {_T} SELECT cand, t AS text, round(sum({_W})::DOUBLE, 6) AS support, count(*)::BIGINT AS votes FROM shaped WHERE t <> '' GROUP BY cand, t")
def attempt_support_vote(spark, d):
    return attempts.support_vote(tries(spark, d))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS k FROM labels) l ON d.doc_id = l.doc_id AND l.k = 1")
def annotation_left_first(spark, d):
    images = _t(spark, d, "documents").select("doc_id")
    return evaluate.first_annotation(images, _t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "quality").fillna(-1)


@query(f"WITH {_T}, sc AS (SELECT cand, seq, t, round(({_ATTEMPT})::DOUBLE, 6) AS score FROM shaped), r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, seq) AS k FROM sc) SELECT {_rule('plates.t', 0, chr(39) + 'Unknown' + chr(39))} AS state, count(*)::BIGINT AS n, (count(*) FILTER (WHERE r.t = plates.t))::BIGINT AS matched FROM r JOIN plates ON r.cand = plates.k WHERE r.k = 1 GROUP BY 1")
def evaluation_match(spark, d):
    both = attempts.best_attempt(tries(spark, d)).join(plates(spark, d), F.col("cand") == F.col("k"))
    return evaluate.matched(both, "t", "text").groupBy(text.identify_state(F.col("t"))["name"].alias("state")).agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"))


RUNS = f"{M}, e AS (SELECT id, i, v[i] > 0 AS m FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM masks)), g AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM e WHERE m), runs AS (SELECT id, min(i)::INT AS first, max(i)::INT AS last FROM g GROUP BY id, g)"


@query(f"WITH {RUNS} SELECT * FROM runs")
def run_islands(spark, d):
    return masks(spark, d).select("id", F.explode(arrays.runs(F.col("m"))).alias("r")).select("id", "r.*")


@query(f"WITH {RUNS}, f AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY id ORDER BY first) - 1 <= 1 THEN 0 ELSE 1 END AS new FROM runs), c AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY first) AS c FROM f) SELECT id, min(first) AS first, max(last) AS last FROM c GROUP BY id, c")
def merge_runs(spark, d):
    return masks(spark, d).select("id", F.explode(arrays.merge_runs(arrays.runs(F.col("m")), 1)).alias("r")).select("id", "r.*")


@query(f"WITH {M}, e AS (SELECT id, i, v[i] AS x FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM masks)) SELECT id, (i - 1)::INT AS pos, round(avg(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM e")
def moving_average(spark, d):
    return masks(spark, d).select("id", F.posexplode(arrays.moving_average(F.col("v"), 2)).alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {B.replace("(l_partkey % 40)", "(l_partkey % 400)")}, m AS (SELECT image, greatest(4, 0.85 * median(w / 8)) AS lim FROM boxes GROUP BY image),
f AS (SELECT b.image, seq, x, CASE WHEN x - max(x + w / 8) OVER (PARTITION BY b.image ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > lim THEN 1 ELSE 0 END AS new FROM boxes b JOIN m ON b.image = m.image)
SELECT image, seq, (1 + sum(new) OVER (PARTITION BY image ORDER BY x, seq ROWS UNBOUNDED PRECEDING))::INT AS cluster FROM f""")
def horizontal_clusters(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.row_number().over(by).alias("seq"), (F.col("l_partkey") % 400).cast("double").alias("x"), (F.col("l_quantity") * 6).cast("double").alias("w"))
    return detect.horizontal_clusters(rows.withColumn("w", F.col("w") / 8), "image").select("image", "seq", "cluster")


@query(f"WITH {B} SELECT image, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY image")
def union_box(spark, d):
    return boxes(spark, d).groupBy("image").agg(geometry.union_box(F.collect_list("box")).alias("b")).select("image", "b.*")


@query(f"""WITH {B}, l AS (SELECT image, (x * 9 + 90) % 180 - 90 AS angle, w AS length FROM boxes), u AS (SELECT * FROM l WHERE length >= 18 AND abs(angle) <= 12), a AS (SELECT image, sum(angle * length) / sum(length) AS mean FROM u GROUP BY image)
SELECT u.image, round(max(mean), 6) AS angle, round(sum(CASE WHEN abs(angle - mean) <= 2.5 THEN length ELSE 0 END) / sum(length), 6) AS confidence FROM u JOIN a ON a.image = u.image GROUP BY u.image""")
def weighted_angle(spark, d):
    return detect.skew(boxes(spark, d).select("image", (F.col("x") * 9).alias("angle"), F.col("w").alias("length")), "image")


_BEST = f"{_T}, sc AS (SELECT cand, seq, t, round(({_ATTEMPT})::DOUBLE, 6) AS score FROM shaped), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY score DESC, seq) AS r FROM sc) WHERE r = 1)"


def _images(spark, d):
    """An image for each order and some more without any candidate; some cannot be read."""
    k = F.col("o_orderkey")
    own = _t(spark, d, "orders").select(k.alias("image"))
    none = own.where("image % 50 = 0").select((-F.col("image")).alias("image"))
    return own.unionByName(none).select("image", F.concat(F.lit("images/"), F.col("image").cast("string"), F.lit(".png")).alias("path"), F.when(F.pmod("image", F.lit(97)) == 3, "unreadable").alias("error"))


IMAGES = "images AS (SELECT image, concat('images/', image, '.png') AS path, image > 0 AND image % 97 = 3 OR image < 0 AND (image % 97 + 97) % 97 = 3 AS failed FROM (SELECT o_orderkey AS image FROM orders UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 50 = 0))"
RESULTS = f"{_BEST}, {IMAGES}, results AS (SELECT path AS \"imagePath\", CASE WHEN failed THEN 'error' WHEN t IS NULL THEN 'plate_not_found' WHEN t <> '' AND cand % 11 <> 0 THEN 'ok' ELSE 'ocr_failed' END AS status, CASE WHEN failed OR t IS NULL THEN '' ELSE t END AS \"plateText\", CASE WHEN failed OR t IS NULL THEN 0 ELSE score END AS confidence FROM images LEFT JOIN best ON image = cand)"


def _results(spark, d):
    return evaluate.results(_images(spark, d), attempts.best_attempt(tries(spark, d)).select(F.col("cand").alias("image"), "text", "score", (F.col("cand") % 11 != 0).alias("success")))


@query(f"""WITH {RESULTS} SELECT "imagePath", status, "plateText", {_rule('"plateText"', 0, chr(39) + 'Unknown' + chr(39))} AS "stateName", confidence FROM results""")
def summary_projection(spark, d):
    return _results(spark, d)


@query(f"""WITH {RESULTS} SELECT path AS "ImagePath", {_norm('m.t')} AS "ExpectedText", {_norm('"plateText"')} AS "RecognizedText", coalesce(status, 'plate_not_found') AS "Status", coalesce(profile, '') AS "DetectedProfile", '' AS "DetectedLayout", coalesce(variant, '') AS "SelectedVariant",
  coalesce(confidence, 0) AS "Confidence", {_norm('m.t')} = {_norm('"plateText"')} AS "Matched"
FROM (SELECT concat('images/', k, '.png') AS path, t FROM plates UNION ALL SELECT 'images/none.png', 'B 1') m LEFT JOIN (SELECT *, CASE WHEN status = 'ok' THEN 'single_line' END AS profile, CASE WHEN status = 'ok' THEN 'block' END AS variant FROM results) ON "imagePath" = path""")
def evaluation_rows(spark, d):
    manifest = plates(spark, d).select(F.concat(F.lit("images/"), F.col("k").cast("string"), F.lit(".png")).alias("image_path"), F.col("t").alias("expected_text"))
    manifest = manifest.unionByName(spark.sql("SELECT 'images/none.png' AS image_path, 'B 1' AS expected_text"))
    ok = F.col("status") == "ok"
    found = _results(spark, d).withColumns({"profile": F.when(ok, "single_line"), "layout": F.lit(None).cast("string"), "variant": F.when(ok, "block")})
    return evaluate.evaluation(manifest, found)


@query(f"""WITH {B.replace("(l_suppkey % 20)", "(l_suppkey % 200)")}, c AS (SELECT image, seq, h, y + h / 2 AS cy FROM boxes),
g AS (SELECT image, h, row_number() OVER w - 1 AS n, cy - lag(cy) OVER w AS gap FROM c WINDOW w AS (PARTITION BY image ORDER BY cy, seq)),
m AS (SELECT image, count(*) AS a, avg(h) AS h, max(gap) AS gap FROM g GROUP BY image),
f AS (SELECT m.image, a, m.h, m.gap, min(n) AS top FROM m JOIN g ON m.image = g.image AND m.gap = g.gap GROUP BY ALL)
SELECT image, top::INT AS n_top, round(gap, 6) AS gap FROM f WHERE a >= 4 AND gap >= greatest(0.45 * h, 28.8) AND top >= 2 AND a - top >= 2""")
def gap_split(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.row_number().over(by).alias("seq"), (F.col("l_suppkey") % 200).cast("double").alias("y"), (F.col("l_quantity") * 2).cast("double").alias("h"))
    return detect.gap_split(rows, "image", 360)


_REFINE = f"""(0.42 * CASE WHEN {EXACT} THEN 1.0 WHEN {PARTIAL} THEN 0.55 ELSE 0 END + 0.24 * greatest(0, 1 - 0.18 * abs(n - 7)) + 0.14 * least(1.0, ({_rule('t', 4, '0')}) / 100.0)
  + 0.20 * greatest(0, CASE WHEN o THEN 0.30 ELSE 0 END + CASE WHEN p BETWEEN 1 AND 4 THEN 0.25 ELSE 0 END + CASE WHEN d BETWEEN 1 AND 4 THEN 0.25 ELSE 0 END + CASE WHEN s <= 1 THEN 0.20 ELSE 0 END - CASE WHEN {LZ} THEN 0.35 ELSE 0 END))::DOUBLE"""


@query(f"WITH {SHAPED} SELECT k, round({_REFINE}, 6) AS score FROM shaped")
def refinement_score(spark, d):
    return plates(spark, d).select("k", F.round(text.refinement_score(F.col("t")), 6).alias("score"))


FINAL = f"""{TEXTED}, sh AS (SELECT image, seq, t, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o, length(t) AS n, least(1.0, score) AS det, x / 40 AS ev, least(1.0, w / 300) AS rec, y / 20 AS frame, seq % 5 / 100 AS left_m FROM (SELECT * EXCLUDE text, text AS t FROM texted)),
sc AS (SELECT *, (CASE WHEN n = 0 THEN 0.0 WHEN {EXACT} THEN 1.0 WHEN {PARTIAL} THEN 0.6 WHEN {_ANY} THEN 0.4 ELSE 0.05 END)::DOUBLE AS regex, {COMPOSITION}::DOUBLE AS comp, ({LENGTH})::DOUBLE AS len, ({STRUCTURE})::DOUBLE AS struct,
  (CASE WHEN n = 0 THEN 0 WHEN {_rule('t', 4, '0')} > 0 THEN 1 ELSE 0.05 END)::DOUBLE AS prefix, least(1.0, greatest(0.0, (0.35 - rec) / 0.35))::DOUBLE AS weak FROM sh),
tr AS (SELECT *, greatest(0.12, least(1.0, greatest(0.18, least(1.0, 0.20 + 0.80 * rec)) * (0.30 + 0.70 * prefix) * (1 - 0.55 * weak))) AS trust, CASE WHEN prefix = 1 THEN 1.0 WHEN n > 0 THEN 0.2 ELSE 0 END::DOUBLE AS state FROM sc),
fin AS (SELECT image, seq, (0.20 * det + 0.16 * ev + 0.12 * rec + 0.19 * least(1.0, trust * (0.85 * regex + 0.15 * rec)) + 0.11 * least(1.0, trust * (0.85 * state + 0.15 * rec)) + 0.06 * least(1.0, trust * comp) + 0.03 * least(1.0, trust * len) + 0.10 * least(1.0, trust * struct) + 0.03 * frame)
  + (CASE WHEN regex = 1 THEN 0.10 WHEN regex = 0.6 THEN 0.04 ELSE 0 END + CASE WHEN comp >= 0.85 THEN 0.08 ELSE 0 END + weak * (0.14 * det + 0.08 * ev))
  - (CASE WHEN n = 0 THEN 0.55 ELSE 0 END + CASE WHEN ev < 0.25 THEN 0.24 ELSE 0 END + CASE WHEN comp < 0.25 THEN 0.16 WHEN comp < 0.55 THEN 0.10 ELSE 0 END + CASE WHEN n > 0 AND NOT regexp_matches(t, '[A-Z]') THEN 0.12 ELSE 0 END + CASE WHEN n > 0 AND len < 0.35 THEN 0.08 ELSE 0 END
  + CASE WHEN p <= 1 AND d >= 3 AND left_m < 0.02 THEN 0.12 ELSE 0 END + CASE WHEN n > 0 AND d BETWEEN 1 AND 2 THEN 0.14 ELSE 0 END + CASE WHEN n > 0 AND frame < 0.35 THEN 0.08 ELSE 0 END + CASE WHEN n > 0 AND prefix < 0.20 THEN 0.18 ELSE 0 END) AS f FROM tr)"""


@query(f"WITH {_double(FINAL)} SELECT image, seq, round(least(1.0, greatest(0.0, f))::DOUBLE, 6) AS final_score FROM fin")
def rerank_score(spark, d):
    x = _texted(spark, d).withColumns({"detector": F.col("score"), "evidence": F.col("box.x") / 40, "recognition": F.col("box.w") / 300, "framing": F.col("box.y") / 20, "left_margin": F.col("seq") % 5 / 100})
    return rerank.with_final_score(x).select("image", "seq", F.round("final_score", 6).alias("final_score"))


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    """image, boxes: made-up characters of a plate of 240 by 100 pixels for each order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    c = lambda e, n: e.cast("double").alias(n)
    w, h = F.col("l_quantity") % 17 + 4, F.col("l_quantity") % 12 + 15
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.struct(F.row_number().over(by).alias("seq"), c(F.col("l_partkey") % 200, "x"), c(F.col("l_suppkey") % 3 * 30 + F.col("l_partkey") % 7, "y"), c(w, "w"), c(h, "h"), c(w * h * (F.col("l_partkey") % 4 + 1) / 16, "area")).alias("b"))
    return rows.groupBy("image").agg(F.sort_array(F.collect_list("b")).alias("boxes"))


GLYPHS = """glyphs AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)::INT AS seq,
  (l_partkey % 200)::DOUBLE AS x, (l_suppkey % 3 * 30 + l_partkey % 7)::DOUBLE AS y, (l_quantity % 17 + 4)::DOUBLE AS w, (l_quantity % 12 + 15)::DOUBLE AS h, ((l_quantity % 17 + 4) * (l_quantity % 12 + 15) * (l_partkey % 4 + 1))::DOUBLE / 16 AS area FROM lineitem)"""


def _characters(limits: dict) -> str:
    ratio = {"area": "area / 24000", "height": "h / 100", "width": "w / 240", "aspect": "w / h"}
    return f"{GLYPHS}, chars AS (SELECT *, y + h / 2 AS cy FROM glyphs WHERE " + " AND ".join(f"{ratio[k]} BETWEEN {a} AND {b}" for k, (a, b) in limits.items()) + ")"


def _gaps(of: str, key: str, name: str, tie: str = "seq") -> str:
    """A row of boxes and how even it is: spreads of middles (sc) and heights (sh), mean height (mh), gaps (gc), sides."""
    return f"""{name} AS (SELECT {key}, count(*) AS n, avg(h) AS mh, coalesce(stddev_samp(h), 0) AS sh, coalesce(stddev_samp(cy), 0) AS sc, min(x) AS x1, max(x + w) AS x2, min(y) AS y1, max(y + h) AS y2, sum(w * h) AS filled,
  CASE WHEN count(*) <= 2 THEN 0.75 WHEN count(gap) FILTER (WHERE gap >= 0) = 0 THEN 0.25 ELSE least(1.0, greatest(0.0, 1 - coalesce(stddev_samp(gap) FILTER (WHERE gap >= 0), 0) / (avg(gap) FILTER (WHERE gap >= 0) + 1))) END AS gc
  FROM (SELECT *, x - lag(x + w) OVER (PARTITION BY {key} ORDER BY x, {tie}) AS gap FROM {of}) GROUP BY {key})"""


def _count(n: str, low: int, high: int) -> str:
    return f"CASE WHEN {n} BETWEEN {low} AND {high} THEN 1.0 WHEN {n} <= 1 THEN 0.0 ELSE greatest(0.15, 0.85 - 0.12 * least(abs({n} - {low}), abs({n} - {high}))) END"


def _rows_sql(limits: dict, least: float) -> str:
    """rowed: of each image all its characters (a.), those of the top row (t.) and the bottom row (b.), the gap, whether there are two."""
    return f"""{_characters(limits)}, {_gaps("chars", "image", "alls")},
o AS (SELECT *, row_number() OVER w - 1 AS k, cy - lag(cy) OVER w AS step FROM chars WINDOW w AS (PARTITION BY image ORDER BY cy, seq)),
m AS (SELECT image, max(step) AS gap FROM o GROUP BY image), cuts AS (SELECT o.image, max(gap) AS gap, min(k) AS cut FROM o JOIN m ON o.image = m.image AND step = gap GROUP BY o.image),
two AS (SELECT cuts.* FROM cuts JOIN alls ON cuts.image = alls.image WHERE n >= 4 AND gap >= greatest(0.45 * mh, {least} * 100) AND cut >= 2 AND n - cut >= 2),
half AS (SELECT o.*, k >= cut AS below FROM o JOIN two ON o.image = two.image), {_gaps("half", "image, below", "halves", "k")},
rowed AS (SELECT a.image, a, t, b, two.gap, two.image IS NOT NULL AS is_two FROM alls a LEFT JOIN two ON a.image = two.image LEFT JOIN halves t ON a.image = t.image AND NOT t.below LEFT JOIN halves b ON a.image = b.image AND b.below)"""


_EVEN = lambda x, limit: f"greatest(0.0, 1 - {x} / {limit})"
_COMPACT = lambda r: f"least(1.0, greatest(0.0, ({_EVEN(r + '.sc', '10.0')} + {_EVEN(r + '.sh', r + '.mh')} + {r}.gc) / 3))"
_ACROSS = f"""least(1.0, greatest(0.0, (greatest(0.0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) / least(t.x2 - t.x1, b.x2 - b.x1) + greatest(0.0, 1 - abs((t.x1 + (t.x2 - t.x1) / 2) - (b.x1 + (b.x2 - b.x1) / 2)) / (0.22 * (a.x2 - a.x1)))
  + {_EVEN('abs((t.x2 - t.x1) - (b.x2 - b.x1))', 'greatest(t.x2 - t.x1, b.x2 - b.x1)')} + least(1.0, (t.x2 - t.x1) / (0.42 * (a.x2 - a.x1)), (b.x2 - b.x1) / (0.42 * (a.x2 - a.x1)))) / 4))"""
_BALANCE, _HEIGHTS = _EVEN("abs(t.n - b.n)::DOUBLE", "a.n"), _EVEN("abs(t.mh - b.mh)", "a.mh")
_SINGLE = lambda slack: f"least(1.0, greatest(0.0, ({_count('a.n', 3, 8)} + {_EVEN('a.sc', slack)} + {_EVEN('a.sh', 'a.mh')} + a.gc) / 4))"


@query(_double(f"""WITH {_rows_sql(layout.CHARACTER, 0.08)}, e AS (SELECT image, a.n AS n, is_two, {_SINGLE('16.0')} AS single,
  CASE WHEN is_two THEN least(1.0, greatest(0.0, ({_count('a.n', 4, 9)} + {_BALANCE} + ({_COMPACT('t')} + {_COMPACT('b')}) / 2 + {_HEIGHTS} + least(1.0, gap / (0.55 * a.mh)) + {_ACROSS}) / 6)) ELSE 0.08 * {_count('a.n', 4, 9)} END AS two FROM rowed),
f AS (SELECT *, is_two AND two >= 0.56 AND two > single + 0.10 AS wins FROM e)
SELECT g.image, coalesce(n, 0)::INT AS count, round(coalesce(single, 0), 6) AS single, round(CASE WHEN n IS NULL THEN 0 ELSE least(1.0, two) END, 6) AS two, CASE WHEN n IS NULL THEN 0 WHEN is_two THEN 2 ELSE 1 END::INT AS rows,
  CASE WHEN n IS NULL THEN 'unknown' WHEN wins THEN 'two_row' ELSE 'single_line' END AS layout, round(coalesce(CASE WHEN wins THEN two ELSE single END, 0), 6) AS alignment, round(CASE WHEN n IS NULL THEN 0 WHEN wins THEN {_count('n', 4, 9)} ELSE {_count('n', 3, 8)} END::DOUBLE, 6) AS density
FROM (SELECT DISTINCT image FROM glyphs) g LEFT JOIN f ON g.image = f.image"""))
def layout_evidence(spark, d):
    x = glyphs(spark, d).select("image", layout.character_boxes(F.col("boxes"), "area", 240.0, 100.0).alias("c"))
    e = x.withColumn("e", layout.layout_evidence(F.col("c"), 100.0)).select("image", "e.*")
    return e.select("image", "count", "rows", "layout", *(F.round(k, 6).alias(k) for k in ("single", "two", "alignment", "density")))


@query(_double(f"""WITH {_rows_sql(layout.RECTIFIED, 0.10)} SELECT image, is_two, round({_SINGLE('14.0')}, 9) AS single, round(CASE WHEN is_two THEN least(1.0, greatest(0.0, ({_count('a.n', 4, 9)} + {_BALANCE} + {_COMPACT('t')} + {_COMPACT('b')} + {_HEIGHTS} + {_ACROSS}) / 6)) END, 9) AS two,
  round(least(1.0, greatest(0.0, (greatest(0.0, 1 - abs((a.x2 - a.x1) / 240 - 0.68) / 0.42) + greatest(0.0, 1 - abs((a.y2 - a.y1) / 100 - 0.42) / 0.28)) / 2)), 9) AS coverage,
  round(0.28 * least(1.0, a.n / 6) + 0.24 * least(1.0, a.filled / ((a.x2 - a.x1) * (a.y2 - a.y1))) + 0.20 * greatest(0.0, 1 - abs((a.x2 - a.x1) / 240 - 0.30) / 0.32) + 0.14 * greatest(0.0, 1 - abs((a.y2 - a.y1) / 100 - 0.48) / 0.40) + 0.08 * greatest(0.0, 1 - abs(a.x1 + (a.x2 - a.x1) / 2 - 120) / 132) + 0.06 * CASE WHEN is_two THEN 1.0 ELSE 0.28 END, 9) AS cluster FROM rowed"""))
def mask_layout(spark, d):
    x = glyphs(spark, d).select("image", layout.character_boxes(F.col("boxes"), "area", 240.0, 100.0, layout.RECTIFIED).alias("c")).where(F.size("c") > 0)
    x, c = x.withColumn("r", layout.split_rows(F.col("c"), 100.0, 0.10)), F.col("c")
    two = F.when(F.col("r.two"), layout.two_row_mask_score(F.col("r.top"), F.col("r.bottom"), c, 100.0))
    made = {"single": layout.single_row_score(c, 100.0, 0.14), "two": two, "coverage": layout.coverage_score(c, 240.0, 100.0), "cluster": layout.cluster_score(c, 240.0, 100.0, F.col("r.two"))}
    return x.select("image", F.col("r.two").alias("is_two"), *(F.round(v, 9).alias(k) for k, v in made.items()))


def _candidates(spark, d):
    """Candidates with all that the pixels would give, made up."""
    b, seq = boxes(spark, d), F.col("seq")
    x, y, w, h = (F.col(k) for k in "xywh")
    two = (seq % 3 == 0)
    return b.select(
        "image", "seq", "box", (w / h).alias("aspect"), (w / 640).alias("width_ratio"), (h / 360).alias("height_ratio"), (w * h / (640 * 360)).alias("area_ratio"),
        F.get(F.array(*(F.lit(k) for k in BRANCHES)), (seq % 6).cast("int")).alias("branch"), (seq / 4).alias("scale"), F.when(two, "two_row").otherwise("single_line").alias("layout"), F.when(two, 2).otherwise(1).alias("rows"),
        ((x * 10 + w / 2) / 640).alias("centre_x"), ((y * 15 + h / 2) / 360).alias("centre_y"), geometry.boundary_penalty(F.col("box"), 640, 360).alias("boundary"), (x / 40).alias("extent"), (y / 20).alias("solidity"), (h / 100).alias("edge_density"), (w / 200).alias("contrast"),
        (x / 80).alias("character_texture"), (y / 40).alias("plate_contrast"), (x / 50).alias("alignment"), (y / 25).alias("single_alignment"), (w / 150 - 0.5).alias("two_alignment"), (seq % 12).alias("text_count"),
        geometry.coverage_score(F.when(seq % 4 != 0, seq), seq + x, F.lit(45)).alias("coverage"), geometry.split_penalty(F.array_repeat(w, (seq % 3).cast("int") + 1), F.lit(False)).alias("split"), (seq / 10).alias("empty"), (x / 45).alias("single_band"), (y / 22).alias("two_band"), (w / 600).alias("single_clip"), (h / 300).alias("two_clip"),
    )


_SIDE = lambda margin, limit: f"greatest(0.0, ({limit} - greatest(0.0, {margin})) / {limit})"
_BRANCH = "CASE branch " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in geometry.BRANCH_SCORES.items()) + " ELSE 0.86 END"
CANDIDATES = f"""{B}, cand AS (SELECT image, seq, x, y, w, h, w / h AS aspect, w / 640 AS width_ratio, h / 360 AS height_ratio, w * h / (640 * 360) AS area_ratio, {list(BRANCHES)!r}[1 + seq % 6] AS branch, seq::DOUBLE / 4 AS scale, seq % 3 = 0 AS two_layout,
  (x * 10 + w / 2) / 640 AS cx, (y * 15 + h / 2) / 360 AS cy, least(1.0, greatest(0.0, {_SIDE('x - 1', '13.0')}, {_SIDE('640 - (x + w)', '13.0')}, 0.7 * {_SIDE('y - 1', '8.0')}, 0.7 * {_SIDE('360 - (y + h)', '8.0')})) AS boundary, x / 40 AS extent, y / 20 AS solidity, h / 100 AS edge, least(1.0, w / 200) AS contrast,
  x / 80 AS texture, y / 40 AS pc, x / 50 AS alignment, least(1.0, y / 25) AS sa, least(1.0, greatest(0.0, w / 150 - 0.5)) AS ta, seq % 12 AS n, CASE WHEN seq % 4 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((x + 1) / 45 - 0.25) / 0.55)) END AS coverage,
  CASE seq % 3 WHEN 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.7 * (1 - w / (w * (1 + seq % 3))) + 0.3 * (w / (w * (1 + seq % 3))))) END AS split, seq::DOUBLE / 10 AS empty, x / 45 AS sb, y / 22 AS tb, w / 600 AS scl, h / 300 AS tcl FROM boxes),
parts AS (SELECT *, greatest(0.70, {_BRANCH} - 0.10 * abs(scale - 1.0)) AS branch_score, (CASE WHEN cx < 0.05 OR cx > 0.95 THEN 0.0 ELSE greatest(0.15, 1 - abs(cx - 0.50) / (0.95 - 0.05)) END + CASE WHEN cy < 0.18 OR cy > 0.96 THEN 0.0 ELSE greatest(0.15, 1 - abs(cy - 0.76) / (0.96 - 0.18)) END) / 2 AS position,
  (CASE WHEN extent <= 0.22 THEN greatest(0.0, extent / 0.22) WHEN extent >= 0.78 THEN greatest(0.0, 1 - (extent - 0.78) / (1 - 0.78)) ELSE 1.0 END + CASE WHEN solidity <= 0.18 THEN greatest(0.0, solidity / 0.18) WHEN solidity >= 0.85 THEN greatest(0.0, 1 - (solidity - 0.85) / (1 - 0.85)) ELSE 1.0 END) / 2 AS shape,
  (CASE WHEN edge <= 0.04 THEN greatest(0.0, edge / 0.04) WHEN edge >= 0.32 THEN greatest(0.0, 1 - (edge - 0.32) / (1 - 0.32)) ELSE 1.0 END + contrast + texture) / 3 AS tex FROM cand)"""


@query(_double(f"""WITH {CANDIDATES}, off AS (SELECT *, CASE WHEN n < 5 THEN 5 - n WHEN n > 8 THEN n - 8 ELSE 0 END AS o1, CASE WHEN n < 4 THEN 4 - n WHEN n > 9 THEN n - 9 ELSE 0 END AS o2 FROM parts)
SELECT image, seq, round(branch_score, 6) AS branch, round(position, 6) AS position, round(boundary, 6) AS boundary, round(coverage, 6) AS coverage, round(split, 6) AS split, round(shape, 6) AS shape, [1.0, 0.58, 0.28, 0.10][1 + least(o1, 3)]::DOUBLE AS one_row_count, [1.0, 0.58, 0.28, 0.10][1 + least(o2, 3)]::DOUBLE AS two_row_count,
  CASE WHEN two_layout THEN 0.30 ELSE 1.0 END::DOUBLE AS one_row_layout, CASE WHEN two_layout THEN 1.0 ELSE 0.0 END::DOUBLE AS two_row_layout, greatest(2.0, round(greatest(30 * 1.5 * 0.35, w * 10 * h * 10 * 0.00008 * 1.5))) AS least_pixels FROM off"""))
def detector_scores(spark, d):
    c = lambda k: F.col(k)
    x = _candidates(spark, d)
    shape = layout.mean([geometry.threshold_score(c("extent"), 0.22, 0.78), geometry.threshold_score(c("solidity"), 0.18, 0.85)])
    position = layout.mean([geometry.axis_score(c("centre_x"), *DEFAULTS["detection"]["centre"]["horizontal"]), geometry.axis_score(c("centre_y"), *DEFAULTS["detection"]["centre"]["vertical"])])
    made = {"branch": geometry.branch_score(c("branch"), c("scale")), "position": position, "boundary": c("boundary"), "coverage": c("coverage"), "split": c("split"), "shape": shape}
    both = lambda f, *a: (f(*a, F.lit(False)), f(*a, F.lit(True)))
    (n1, n2), (l1, l2) = both(geometry.component_count_score, c("text_count")), both(geometry.layout_match_score, c("layout"), c("rows"))
    return x.select("image", "seq", *(F.round(v, 6).alias(k) for k, v in made.items()), n1.alias("one_row_count"), n2.alias("two_row_count"), l1.alias("one_row_layout"), l2.alias("two_row_layout"), geometry.area_threshold(c("box.w") * 10, c("box.h") * 10, 1.5).alias("least_pixels"))


def _final_sql(k: int) -> str:
    name, *limits = PROFILES[k]
    two = name == "two_row"
    fits = [_FIT(v).replace("target", f"{t}").replace("lo)", f"{lo})").replace("hi)", f"{hi})").replace("< lo", f"< {lo}").replace("> hi", f"> {hi}").replace("(lo -", f"({lo} -").replace("- hi)", f"- {hi})").replace("(hi - ", f"({hi} - ") for v, (t, lo, hi) in zip(("aspect", "width_ratio", "height_ratio", "area_ratio"), limits, strict=True)]
    a, w, h, r = fits
    low, high = (4, 9) if two else (5, 8)
    count = f"[1.0, 0.58, 0.28, 0.10][1 + least(CASE WHEN n < {low} THEN {low} - n WHEN n > {high} THEN n - {high} ELSE 0 END, 3)]"
    match = "CASE WHEN two_layout THEN 1.0 ELSE 0.0 END" if two else "CASE WHEN two_layout THEN 0.30 ELSE 1.0 END"
    split = "0.40 * split" if two else "CASE WHEN two_layout THEN 0.40 * split ELSE split END"
    return f"""{{'score': round(0.16 * (({a} + {w} + {h} + {r}) / 4) + 0.07 * shape + 0.10 * tex + 0.08 * branch_score + 0.18 * ((texture + pc + greatest({'ta' if two else 'sa'}, 0.70 * alignment)) / 3) + 0.10 * {count} + 0.08 * coverage + 0.07 * position + 0.08 * (({w} + {h} + {a}) / 3)
  + 0.10 * {'tb' if two else 'sb'} + 0.06 * {match} - 0.04 * empty - 0.04 * ({split}) - 0.08 * {'tcl' if two else 'scl'} - 0.14 * boundary, 6), 'k': {-k}, 'profile': '{name}'}}"""


@query(_double(f"WITH {CANDIDATES}, s AS (SELECT image, seq, greatest({', '.join(_final_sql(k) for k in range(len(PROFILES)))}) AS b FROM parts) SELECT image, seq, b.profile AS profile, b.score AS score FROM s"))
def candidate_score(spark, d):
    return detect.scored(_candidates(spark, d)).select("image", "seq", "profile", F.round("score", 6).alias("score"))


@query(_double(f"WITH {CANDIDATES}, s AS (SELECT image, seq, aspect, two_layout, branch, greatest({', '.join(_final_sql(k) for k in range(len(PROFILES)))}) AS b FROM parts), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY b.score DESC, seq)::INT AS rank FROM s) "
  'SELECT image, rank AS "Rank", b.score AS "Score", branch AS "Branch", b.profile AS "Profile", CASE WHEN two_layout THEN \'two_row\' ELSE \'single_line\' END AS "Layout", round(aspect, 6) AS "Aspect" FROM r WHERE rank <= 5'))  # fmt: skip
def detection_report(spark, d):
    x = detect.report(detect.scored(_candidates(spark, d)).withColumn("score", F.round("score", 6)), settings({"report": {"detection": 5}}))
    return x.select("image", "Rank", "Score", "Branch", "Profile", "Layout", F.round("Aspect", 6).alias("Aspect"))


@query(f"WITH {B} SELECT image, max(score) AS best, count(*)::BIGINT AS n FROM boxes GROUP BY image")
def detection_summary(spark, d):
    return detect.summary(boxes(spark, d))


_EXPAND = "CASE branch " + " ".join(f"WHEN '{k}' THEN {{'a': {a}::DOUBLE, 'b': {b}::DOUBLE}}" for k, (a, b) in DEFAULTS["detection"]["expand"].items()) + " END"


@query(f"""WITH {B}, e AS (SELECT *, {_EXPAND} AS f FROM (SELECT *, {list(BRANCHES)!r}[1 + seq % 6] AS branch FROM boxes)), g AS (SELECT image, seq, branch, greatest(1.0, floor(x + w / 2 - w * f.a / 2)) AS x1, greatest(1.0, floor(y + h / 2 - h * f.b / 2)) AS y1, least(640.0, ceil(x + w / 2 + w * f.a / 2)) AS x2, least(360.0, ceil(y + h / 2 + h * f.b / 2)) AS y2 FROM e)
SELECT image, seq, branch, x1 AS x, y1 AS y, greatest(1.0, x2 - x1) AS w, greatest(1.0, y2 - y1) AS h FROM g""")
def branch_growth(spark, d):
    b = boxes(spark, d).withColumn("branch", F.get(F.array(*(F.lit(k) for k in BRANCHES)), (F.col("seq") % 6).cast("int")))
    return b.select("image", "seq", "branch", geometry.expand_for_branch(F.col("box"), F.col("branch"), DEFAULTS["detection"]["expand"], 640, 360).alias("b")).select("image", "seq", "branch", "b.*")


@query(f"""WITH {B}, p AS (SELECT image, seq, greatest(1.0, floor(x - w * 0.35)) AS x1, greatest(1.0, floor(y - h * 0.35)) AS y1, least(640.0, ceil(x + w + w * 0.35)) AS x2, least(360.0, ceil(y + h + h * 0.35)) AS y2, greatest(1.0, floor(x - w * 0.03)) AS tx, least(640.0, ceil(x + w + w * 0.10)) AS tx2 FROM boxes),
q AS (SELECT *, greatest(1.0, x2 - x1) AS w, greatest(1.0, y2 - y1) AS h FROM p), r AS (SELECT *, greatest(1.0, y1 - floor((36 - h) / 2)) AS gy, least(360.0, y1 + h - 1 + ceil((36 - h) / 2)) AS gy2 FROM q)
SELECT image, seq, x1 AS x, w, CASE WHEN h < 36 THEN gy ELSE y1 END AS y, CASE WHEN h < 36 THEN greatest(1.0, gy2 - gy + 1) ELSE h END AS h, tx AS text_x, greatest(1.0, tx2 - tx) AS text_w FROM r""")
def padded_boxes(spark, d):
    s = DEFAULTS["rectification"]
    plate = geometry.at_least_high(geometry.pad(F.col("box"), *(DEFAULTS["detection"]["padding"],) * 3, 640, 360), s["min_crop_height"], 360)
    of_text = geometry.pad(F.col("box"), s["left"], s["right"], s["vertical"], 640, 360)
    return boxes(spark, d).select("image", "seq", plate.alias("b"), of_text.alias("t")).select("image", "seq", "b.*", F.col("t.x").alias("text_x"), F.col("t.w").alias("text_w"))


@query(_double(f"WITH {B} SELECT image, seq, greatest(1.0, floor(0.15 * (w * 10))) AS x, greatest(1.0, floor(0.45 * (h * 10))) AS y, greatest(1.0, least(w * 10, ceil(0.85 * (w * 10))) - greatest(1.0, floor(0.15 * (w * 10)))) AS w, greatest(1.0, least(h * 10, ceil(0.95 * (h * 10))) - greatest(1.0, floor(0.45 * (h * 10)))) AS h FROM boxes"))
def region_boxes(spark, d):
    return boxes(spark, d).select("image", "seq", geometry.region_box(DEFAULTS["detection"]["region"], F.col("w") * 10, F.col("h") * 10).alias("b")).select("image", "seq", "b.*")


@query(f"WITH {B} SELECT image, seq FROM boxes WHERE w / 3 / h BETWEEN 0.12 AND 2.00")
def mser_filter(spark, d):
    b = boxes(spark, d).select("image", "seq", F.struct("x", "y", (F.col("w") / 3).alias("w"), "h").alias("box"))
    return detect.mser_regions(b, settings({"detection": {"mser_aspect": (0.12, 2.00)}})).select("image", "seq")


@query(f"WITH {M}, e AS (SELECT id, v[i] > 0 AS m, i, len(v) AS n FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM masks)), b AS (SELECT id, max(n) AS n, min(i) FILTER (WHERE m) AS a, max(i) FILTER (WHERE m) AS z FROM e GROUP BY id) SELECT id, coalesce(round((a - 1) / n, 6), 0) AS \"left\", coalesce(round((n - z) / n, 6), 0) AS \"right\", coalesce(round((z - a + 1) / n, 6), 0) AS span FROM b")
def band_margins(spark, d):
    return masks(spark, d).select("id", geometry.band_margins(F.col("m")).alias("b")).select("id", *(F.round(f"b.{k}", 6).alias(k) for k in ("left", "right", "span")))


_PREFIX = "length(regexp_replace(regexp_extract(t, '^([^0-9]*)', 1), '[^A-Z]', '', 'g'))"
_DIGITS = "length(regexp_extract(t, '([0-9]+)', 1))"


@query(f"""WITH {SHAPED} SELECT k, CASE WHEN {_PREFIX} BETWEEN 1 AND 4 AND {_DIGITS} BETWEEN 1 AND 4 THEN concat('L', {_PREFIX}, '-D', {_DIGITS}, '-S', n - {_PREFIX} - {_DIGITS}) ELSE 'unparsed' END AS pattern, regexp_replace(t, '^([A-Z]{{1,4}}[0-9]{{1,4}})[A-Z]$', '\\1') AS canonical,
  CASE WHEN {EXACT} THEN 'exact' WHEN {PARTIAL} THEN 'partial' WHEN {_ANY} THEN 'prefix' ELSE 'none' END AS regex_label, concat('P', p, '-D', d, '-S', s) AS structure_label, CASE WHEN n BETWEEN 4 AND 8 THEN 'expected' ELSE 'out_of_range' END AS length_label FROM shaped""")
def text_labels(spark, d):
    t = F.col("t")
    return plates(spark, d).select("k", text.pattern_label(t).alias("pattern"), text.canonical(t, suffix=False).alias("canonical"), text.regex_label(t).alias("regex_label"), text.structure_label(t).alias("structure_label"), text.length_label(t).alias("length_label"))


def _refined(t: str) -> str:
    """Score, priority and shape of a text column, as a struct."""
    return "{" + f"'t': {t}, 'score': {_REFINE}, 'priority': {_rule('t', 4, '0')}, 'p': p, 's': s" + "}"


def _stage(of: str, t: str, name: str) -> str:
    inner = f"SELECT *, length(t) AS n, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o FROM (SELECT k, {t} AS t, conf{'' if of == 'texts' else ', a, label'} FROM {of})"
    return f"{name} AS (SELECT k, conf, {'' if of == 'texts' else 'a, label, '}{_refined('t')} AS b FROM ({inner}))"


_CUT = "substr(a.t, 1, greatest(length(a.t) - 1, 0)::BIGINT)"


@query(_double(f"""WITH {P}, texts AS (SELECT k, t || CASE k % 4 WHEN 0 THEN 'XY' WHEN 1 THEN 'Q' ELSE '' END AS t, (k % 10)::DOUBLE / 10 AS conf FROM (SELECT k, CASE WHEN k % 5 = 0 THEN 'Y' || t ELSE t END AS t FROM plates)), {_stage('texts', 't', 'start')},
s0 AS (SELECT k, conf, b AS a, '' AS label FROM start), {_stage('s0', _CUT, 't1')}, s1 AS (SELECT k, conf, CASE WHEN a.s > 1 AND b.score > a.score + 0.06 THEN b ELSE a END AS a, CASE WHEN a.s > 1 AND b.score > a.score + 0.06 THEN 'trim_tail' ELSE '' END AS label FROM t1),
{_stage('s1', _CUT, 't2')}, w2 AS (SELECT *, a.s = 1 AND conf <= 0.25 AND regexp_matches(b.t, '^[A-Z]{{1,4}}[0-9]{{1,4}}$') AND b.score >= a.score - 0.02 AS go FROM t2), s2 AS (SELECT k, conf, CASE WHEN go THEN b ELSE a END AS a, CASE WHEN go THEN 'trim_weak_suffix' ELSE label END AS label FROM w2),
{_stage('s2', 'substr(a.t, 2)', 't3')}, w3 AS (SELECT *, a.p >= 2 AND CASE WHEN b.priority > a.priority THEN b.score > a.score + 0.04 WHEN b.priority = a.priority THEN b.score > a.score + 0.02 ELSE false END AS go FROM t3)
SELECT k, CASE WHEN go THEN b.t ELSE a.t END AS text, CASE WHEN go THEN 'trim_head' ELSE label END AS label FROM w3"""))
def refined_text(spark, d):
    k, t = F.col("k"), F.col("t")
    x = plates(spark, d).withColumn("t", F.concat(F.when(k % 5 == 0, "Y").otherwise(""), t, F.when(k % 4 == 0, "XY").when(k % 4 == 1, "Q").otherwise("")))
    return x.withColumn("r", text.refined(t, k % 10 / 10)).select("k", "r.*")


_KINDS = ("letters_prepared", "digits_binary", "plain", "digits_prepared", "letters_binary", "raw")


def _row_readings(spark, d):
    """Two rows' readings for each plate, made of its attempts."""
    seq = F.col("seq")
    return tries(spark, d).select("cand", (seq % 2 + 1).cast("int").alias("row"), "seq", F.get(F.array(*(F.lit(x) for x in _KINDS)), (seq % 6).cast("int")).alias("name"), F.when(seq % 2 == 0, F.substring("text", 1, 3)).otherwise(F.substring("text", 3, 5)).alias("text"), "conf", (F.col("cand") % 2 == 0).alias("two_row"))


_N = {"n": "length(t)", "l": "length(regexp_replace(t, '[^A-Z]', '', 'g'))", "g": "length(regexp_replace(t, '[^0-9]', '', 'g'))"}
ROWS = f"""{A}, raw AS (SELECT cand, seq % 2 + 1 AS row, seq, {list(_KINDS)!r}[1 + seq % 6] AS name, {_norm('CASE WHEN seq % 2 = 0 THEN substr(text, 1, 3) ELSE substr(text, 3, 5) END')} AS t, conf, cand % 2 = 0 AS two FROM tries),
rd AS (SELECT * EXCLUDE t, CASE WHEN NOT two THEN t WHEN row = 1 THEN regexp_replace(translate(t, '0125678', 'OIZSGTB'), '[^A-Z]', '', 'g') ELSE regexp_replace(translate(t, 'OQDUILTZSGB', '00001112568'), '[^0-9]', '', 'g') END AS t FROM raw),
rs AS (SELECT *, CASE WHEN t = '' THEN -1 ELSE conf + CASE WHEN two AND row = 1 THEN CASE WHEN {_N['l']} = {_N['n']} THEN 0.35 ELSE 0 END + CASE WHEN {_N['n']} BETWEEN 1 AND 4 THEN 0.16 ELSE 0 END - CASE WHEN {_N['n']} > 4 THEN 0.18 ELSE 0 END - CASE WHEN {_N['g']} > 0 THEN 0.20 ELSE 0 END
    WHEN two THEN CASE WHEN {_N['g']} = {_N['n']} THEN 0.40 ELSE 0 END + CASE WHEN {_N['n']} BETWEEN 1 AND 4 THEN 0.24 ELSE 0 END - CASE WHEN {_N['n']} > 4 THEN 0.20 ELSE 0 END - CASE WHEN {_N['l']} > 0 THEN 0.24 ELSE 0 END ELSE 0 END END
  + CASE WHEN two THEN CASE WHEN row = 1 AND contains(name, 'letters') THEN 0.08 WHEN row = 2 AND contains(name, 'digits') THEN 0.10 ELSE 0 END + CASE WHEN contains(name, 'prepared') THEN 0.03 WHEN contains(name, 'binary') THEN 0.02 ELSE 0 END ELSE 0 END AS score FROM rd),
rb AS (SELECT *, row_number() OVER (PARTITION BY cand, row ORDER BY score DESC, seq) AS k FROM rs)"""


@query(_double(f"WITH {ROWS} SELECT cand, string_agg(t, '/' ORDER BY row) AS rows, round(sum(conf), 6) AS conf FROM rb WHERE k = 1 GROUP BY cand"))
def row_readings(spark, d):
    x = attempts.best_rows(_row_readings(spark, d))
    return x.select("cand", F.array_join(F.transform("rows", lambda r: r["text"]), "/").alias("rows"), F.round(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["conf"]), 6).alias("conf"))


def _named(spark, d):
    """Attempts with names, layouts and success, and the hints that their candidates have."""
    x = tries(spark, d).withColumns({"name": F.concat(F.when(F.col("seq") % 4 == 0, "textonly_").when(F.col("seq") % 4 == 1, "rowcomposite_").otherwise("full_"), F.col("seq").cast("string")), "layout": F.when(F.col("seq") % 2 == 0, "Line").otherwise("Block"), "success": F.col("seq") % 5 != 4})
    k = F.col("o_orderkey")
    hints = _t(spark, d, "orders").select(k.alias("cand"), F.when(k % 2 == 0, "two_row").otherwise("").alias("layout"), F.when(k % 3 == 0, "two_row").otherwise("single_line").alias("profile"), F.lit(None).cast("array<struct<text:string,conf:double>>").alias("rows"))
    return x, hints


_VB = lambda t: "CASE " + " ".join(f"WHEN source = '{k}'" + ("" if y is None else f" AND lay = '{y}'") + f" THEN {v}" for (k, y), v in t.items()) + " ELSE 0 END"
_VARIANTS = f"""{_T}, va AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'Line' ELSE 'Block' END AS lay, cand % 2 = 0 OR cand % 3 = 0 AS two FROM shaped),
vs AS (SELECT cand, seq, t, round((CASE WHEN seq % 5 = 4 THEN -1 ELSE {_ATTEMPT} END + CASE WHEN two THEN {_VB(text.TWO_ROW_BONUS)} ELSE {_VB(text.ONE_ROW_BONUS)} END + CASE WHEN cand % 3 = 0 AND source = 'row_composite' THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS score FROM va)"""


@query(_double(f"WITH {_VARIANTS} SELECT cand, seq, t AS text, score FROM vs"))
def attempt_scores(spark, d):
    x, hints = _named(spark, d)
    both = x.join(hints.select("cand", F.col("layout").alias("l"), F.col("profile").alias("p")), "cand")
    t, two = text.norm(F.col("text")), text.hint_layout(F.col("l"), F.col("p")) == "two_row"
    score = F.when(F.col("success"), text.attempt_score(t, F.col("conf"))).otherwise(-1.0) + text.variant_bonus(F.col("source"), F.col("layout"), two, F.col("p"))
    return both.select("cand", "seq", t.alias("text"), F.round(score, 6).alias("score"))


@query(f"""WITH {A}, n AS (SELECT cand, {_norm('text')} AS t, {_W} AS w, seq % 4 AS m FROM tries), u AS (SELECT cand, t, CASE m WHEN 0 THEN greatest(w, 0.85) WHEN 1 THEN least(w, 0.30) ELSE w END AS w FROM n WHERE t <> '') SELECT cand, t AS text, round(sum(w)::DOUBLE, 6) AS support, count(*)::BIGINT AS votes FROM u GROUP BY cand, t""")
def named_support_vote(spark, d):
    return attempts.support_vote(_named(spark, d)[0])


def _scored(of: str, name: str) -> str:
    """Attempts (cand, seq, name, source, t, conf, bonus, success, two) with shape, score and total."""
    return f"""{name} AS (SELECT *, score + bonus AS total FROM (SELECT *, CASE WHEN NOT success THEN -1 ELSE {_ATTEMPT} END AS score FROM (SELECT *, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o, length(t) AS n FROM ({of}))))"""


_BONUS_OF = f"CASE WHEN two THEN {_VB(text.TWO_ROW_BONUS)} ELSE {_VB(text.ONE_ROW_BONUS)} END + CASE WHEN cand % 3 = 0 AND source = 'row_composite' THEN 0.05 ELSE 0 END"
_NAME_OF = "CASE seq % 4 WHEN 0 THEN 'textonly_' WHEN 1 THEN 'rowcomposite_' ELSE 'full_' END || seq"
_FIRST = lambda of, by, name: f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY {by} DESC, seq) AS place FROM {of}) WHERE place = 1)"
_PART = lambda c: f"least(1.0, greatest(0.0, {c}))"
_EDITS = "list_sum(list_transform(range(1, 1 + least(length(a.t), length(y.t))), lambda i: (substr(a.t, i, 1) <> substr(y.t, i, 1))::INT)) + abs(length(a.t) - length(y.t))"
_BY_NAME = f"CASE WHEN starts_with(name, 'textonly_') THEN greatest({_W}, 0.85) WHEN starts_with(name, 'rowcomposite_') THEN least({_W}, 0.30) WHEN name IN ('rowwise_combo', 'hybrid_two_row') THEN least({_W}, 0.25) ELSE {_W} END"
READ = f"""{_T}, tries AS (SELECT * FROM raw){ROWS[len(A):].replace(" raw AS", " rraw AS").replace("FROM raw)", "FROM rraw)")},
{_scored(f"SELECT cand, seq, {_NAME_OF} AS name, source, t, conf, {_BONUS_OF} AS bonus, success, two FROM (SELECT cand, seq, source, t, conf, seq % 5 <> 4 AS success, CASE WHEN seq % 2 = 0 THEN 'Line' ELSE 'Block' END AS lay, cand % 2 = 0 OR cand % 3 = 0 AS two FROM shaped)", "own")}, {_FIRST("own", "total", "bo")},
rw AS (SELECT cand, max(t) FILTER (WHERE row = 1) AS t1, max(t) FILTER (WHERE row = 2) AS t2, max(conf) FILTER (WHERE row = 1) AS c1, max(conf) FILTER (WHERE row = 2) AS c2 FROM rb WHERE k = 1 GROUP BY cand HAVING count(*) = 2),
{_scored(f"SELECT w.cand, 1000000 AS seq, 'rowwise_combo' AS name, 'rowwise_combo' AS source, t1 || t2 AS t, (CASE WHEN t1 <> '' THEN {_PART('c1')} ELSE 0 END + CASE WHEN t2 <> '' THEN {_PART('c2')} ELSE 0 END) / ((t1 <> '')::INT + (t2 <> '')::INT) AS conf, CASE WHEN two THEN 0.24 ELSE 0 END AS bonus, true AS success, two, t2 FROM rw w JOIN bo ON bo.cand = w.cand WHERE t1 <> '' OR t2 <> ''", "combo")},
{_scored("SELECT c.cand, 1000001 AS seq, 'hybrid_two_row' AS name, 'hybrid_two_row' AS source, head || tail AS t, (nc + c.conf) / 2 AS conf, 0.10 AS bonus, true AS success, two FROM (SELECT c.*, CASE WHEN c.total > bo.total THEN c.conf ELSE bo.conf END AS nc, regexp_extract(CASE WHEN c.total > bo.total THEN c.t ELSE bo.t END, '^([A-Z]{1,4})', 1) AS head, regexp_extract(t2, '([0-9]{1,4})', 1) AS tail FROM combo c JOIN bo ON bo.cand = c.cand) c WHERE two AND head <> '' AND tail <> ''", "mixed")},
every AS (SELECT cand, seq, name, source, t, conf, success, two, p, d, s, o, n, score, total FROM own UNION ALL SELECT cand, seq, name, source, t, conf, success, two, p, d, s, o, n, score, total FROM combo UNION ALL SELECT cand, seq, name, source, t, conf, success, two, p, d, s, o, n, score, total FROM mixed), {_FIRST("every", "total", "x")},
same AS (SELECT a.cand, a.seq, a.name, a.conf, a.success, a.score, a.t, x.total AS least, count(*) OVER (PARTITION BY a.cand) AS many FROM every a JOIN x ON a.cand = x.cand AND a.t = substr(x.t, 1, length(x.t) - 1) WHERE x.conf <= 0.35 AND regexp_matches(x.t, '^[A-Z]{{1,4}}[0-9]{{1,4}}[A-Z]$')), {_FIRST("same", "score", "wk")},
y AS (SELECT x.cand, x.two, coalesce(w.t, x.t) AS t, coalesce(w.conf, x.conf) AS conf, coalesce(w.name || '+trim_weak_suffix', x.name) AS name, coalesce(w.success, x.success) AS success FROM x LEFT JOIN (SELECT * FROM wk WHERE many >= 2 AND score >= least - 0.12) w ON x.cand = w.cand),
sup AS (SELECT cand, t, sum({_BY_NAME})::DOUBLE AS n FROM every GROUP BY cand, t),
like_it AS (SELECT a.cand, a.seq, a.name, a.t, a.conf, a.success, sa.n + 0.10 * least(1.0, ({_rule('a.t', 4, '0')}) / 100) AS rank FROM every a JOIN (SELECT *, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o FROM y) y ON a.cand = y.cand JOIN sup sa ON sa.cand = a.cand AND sa.t = a.t JOIN sup sy ON sy.cand = y.cand AND sy.t = y.t
  WHERE y.two AND y.o AND y.d >= 3 AND y.p >= 2 AND y.s <= 1 AND a.t <> y.t AND abs(length(a.t) - length(y.t)) <= 1 AND regexp_matches(a.t, '^[A-Z]{{1,4}}[0-9]{{3,4}}[A-Z]?$') AND a.p = y.p AND regexp_extract(a.t, '^[A-Z]*([0-9]*)', 1) = regexp_extract(y.t, '^[A-Z]*([0-9]*)', 1) AND {_EDITS} = 1
  AND sa.n >= 1.5 AND sa.n > sy.n + 0.45 AND ({_rule('a.t', 4, '0')}) + 5 >= ({_rule('y.t', 4, '0')})), {_FIRST("like_it", "rank", "lk")},
z AS (SELECT y.cand, y.two, coalesce(l.t, y.t) AS t, coalesce(l.conf, y.conf) AS conf, coalesce(l.name || '+attempt_support', y.name) AS name, coalesce(l.success, y.success) AS success FROM y LEFT JOIN lk l ON y.cand = l.cand),
src AS (SELECT DISTINCT z.cand AS k, z.t AS orig, e.t AS src FROM z JOIN every e ON z.cand = e.cand WHERE e.t <> '' UNION SELECT cand, t, t FROM z), heads AS{_MORE.split("heads AS", 1)[1]},
f AS (SELECT k, orig, t, {S['p']} AS p, {S['d']} AS d, {S['s']} AS s, {S['o']} AS o, coalesce(list_sum(list_transform(range(1, 1 + least(length(t), length(orig))), lambda i: (substr(t, i, 1) <> substr(orig, i, 1))::INT)), 0) + abs(length(t) - length(orig)) AS edits FROM cands),
g AS (SELECT k, orig, t, {_REPAIR} + CASE WHEN t = orig THEN 0 ELSE {_BONUS} - 0.015 * edits END AS score FROM f),
h AS (SELECT k, orig, list_prepend({{'t': orig, 'score': max(CASE WHEN t = orig THEN score END)}}, list({{'t': t, 'score': score}} ORDER BY t)) AS c FROM g GROUP BY k, orig),
mend AS (SELECT k, orig, CASE WHEN orig = '' THEN '' ELSE list_reduce(list_transform(c, lambda e: {{'t': e.t, 'score': e.score, 'gain': gain}}), lambda acc, e: CASE WHEN e.t <> orig AND e.score > acc.score + e.gain THEN e ELSE acc END).t END AS t, conf FROM (SELECT h.*, z.conf, greatest(0.005, CASE WHEN z.conf <= 0.84 THEN 0.015 ELSE 0.03 END - CASE WHEN two THEN 0.010 ELSE 0 END) AS gain FROM h JOIN z ON h.k = z.cand)),
texts AS (SELECT k, t, conf FROM mend), {_stage('texts', 't', 'start')},
s0 AS (SELECT k, conf, b AS a, '' AS label FROM start), {_stage('s0', _CUT, 't1')}, s1 AS (SELECT k, conf, CASE WHEN a.s > 1 AND b.score > a.score + 0.06 THEN b ELSE a END AS a, CASE WHEN a.s > 1 AND b.score > a.score + 0.06 THEN 'trim_tail' ELSE '' END AS label FROM t1),
{_stage('s1', _CUT, 't2')}, w2 AS (SELECT *, a.s = 1 AND conf <= 0.25 AND regexp_matches(b.t, '^[A-Z]{{1,4}}[0-9]{{1,4}}$') AND b.score >= a.score - 0.02 AS go FROM t2), s2 AS (SELECT k, conf, CASE WHEN go THEN b ELSE a END AS a, CASE WHEN go THEN 'trim_weak_suffix' ELSE label END AS label FROM w2),
{_stage('s2', 'substr(a.t, 2)', 't3')}, w3 AS (SELECT *, a.p >= 2 AND CASE WHEN b.priority > a.priority THEN b.score > a.score + 0.04 WHEN b.priority = a.priority THEN b.score > a.score + 0.02 ELSE false END AS go FROM t3),
fine AS (SELECT w3.k AS cand, CASE WHEN go THEN b.t ELSE a.t END AS t, CASE WHEN go THEN 'trim_head' ELSE label END AS label, z.conf, z.name, z.success, z.two, m.t <> m.orig AS repaired FROM w3 JOIN z ON w3.k = z.cand JOIN mend m ON m.k = w3.k)"""


@query(_double(f"""WITH {READ} SELECT cand, t AS text, round(conf, 6) AS confidence, concat_ws('+', name, CASE WHEN repaired THEN 'pattern_repair' END, nullif(label, '')) AS variant, CASE WHEN two THEN 'two_row' ELSE 'unknown' END AS layout,
  CASE WHEN t = '' THEN '' WHEN {_PREFIX} BETWEEN 1 AND 4 AND {_DIGITS} BETWEEN 1 AND 4 THEN concat('L', {_PREFIX}, '-D', {_DIGITS}, '-S', length(t) - {_PREFIX} - {_DIGITS}) ELSE 'unparsed' END AS pattern, repaired, success, round({_PART('conf')}, 6) AS recognition FROM fine"""))
def recognise(spark, d):
    """Attempts to readings: best of all, rows, weak suffix, support, repair and refinement."""
    x, hints = _named(spark, d)
    rows = attempts.best_rows(_row_readings(spark, d))
    found = attempts.recognised(x, hints.drop("rows").join(rows, "cand", "left"))
    return found.select("cand", "text", F.round("confidence", 6).alias("confidence"), "variant", "layout", "pattern", "repaired", "success", F.round("recognition", 6).alias("recognition"))


@query(_double(f"WITH {B}, c AS (SELECT image, seq, x / 40 AS a, y / 10 AS b, w / 200 AS c, h / 100 AS e, w / 300 AS rec FROM boxes) SELECT image, seq, round(least(1.0, greatest(0.0, (least(1.0, a) + least(1.0, b) + least(1.0, c)) / 3 - 0.35 * least(1.0, e))), 6) AS evidence, round(CASE WHEN seq % 3 = 0 THEN least(1.0, rec) ELSE least(1.0, (a + b) / 2) END, 6) AS recognition, "
  "CASE WHEN seq % 5 = 1 THEN 'a' WHEN seq % 4 = 1 THEN 'b' WHEN seq % 3 = 1 THEN 'c' WHEN seq % 2 = 1 THEN 'two_row' ELSE 'unknown' END AS layout FROM c"))  # fmt: skip
def candidate_evidence(spark, d):
    x, seq = boxes(spark, d), F.col("seq")
    x = x.withColumns({"character_texture": F.col("x") / 40, "plate_contrast": F.col("y") / 10, "alignment": F.col("w") / 200, "empty": F.col("h") / 100})
    own = F.when(seq % 3 == 0, F.array().cast("array<double>")).otherwise(F.array("character_texture", "plate_contrast"))
    chosen = rerank.layout_of(F.when(seq % 5 == 1, "a"), F.when(seq % 4 == 1, "b").otherwise(""), F.when(seq % 3 == 1, "c"), F.when(seq % 2 == 1, "two_row"))
    return x.select("image", "seq", F.round(rerank.evidence(x), 6).alias("evidence"), F.round(rerank.recognition(own, F.col("w") / 300), 6).alias("recognition"), chosen.alias("layout"))


@query(f"WITH {_double(FINAL)}, judged AS (SELECT f.image, f.seq, t, round(least(1.0, greatest(0.0, f))::DOUBLE, 6) AS score, det, ev, frame FROM fin f JOIN sc ON f.image = sc.image AND f.seq = sc.seq), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, seq)::INT AS rank FROM judged) SELECT image, rank AS \"Rank\", score AS \"FinalScore\", round(det, 6) AS \"Detector\", round(frame, 6) AS \"Framing\", length(t)::INT AS \"TextLength\", t AS \"RecognizedText\", {_rule('t', 0, chr(39) + 'Unknown' + chr(39))} AS \"StateName\" FROM r WHERE rank <= 10")
def evaluated_report(spark, d):
    x = _texted(spark, d).withColumns({"detector": F.col("score"), "evidence": F.col("box.x") / 40, "recognition": F.col("box.w") / 300, "framing": F.col("box.y") / 20, "left_margin": F.col("seq") % 5 / 100})
    full = rerank.report(rerank.with_final_score(x).withColumn("final_score", F.round("final_score", 6)))
    return full.select("image", "Rank", "FinalScore", F.round("Detector", 6).alias("Detector"), F.round("Framing", 6).alias("Framing"), "TextLength", "RecognizedText", "StateName")


@query(f"""WITH {A}, c AS (SELECT cand, seq, {_norm('text')} AS t, conf, seq % 3 = 0 AS own FROM tries) SELECT cand, seq, CASE WHEN t = '' THEN '' ELSE array_to_string(string_split(t, ''), ' ') END AS characters, round(CASE WHEN t = '' THEN 0 WHEN own THEN least(1.0, conf * 0.5) ELSE least(1.0, conf) END::DOUBLE * length(t), 6) AS total FROM c""")
def character_confidences(spark, d):
    x = tries(spark, d).withColumn("t", text.norm(F.col("text")))
    own = F.when(F.col("seq") % 3 == 0, F.array_repeat(F.col("conf") * 0.5, F.length("t"))).otherwise(F.array(F.lit(0.5)))
    each = text.expanded_confidence(F.col("t"), F.when((F.col("seq") % 3 == 0) | (F.length("t") != 1), own).otherwise(F.array(F.col("conf"))), F.col("conf"))
    top = text.top_candidates(text.characters(F.col("t")), each)
    return x.select("cand", "seq", F.array_join(F.transform(top, lambda c: c["label"]), " ").alias("characters"), F.round(F.coalesce(F.get(F.transform(top, lambda c: c["score"]), F.lit(0)), F.lit(0.0)) * F.length("t"), 6).alias("total"))


_MEND = READ[READ.index("heads AS"):READ.index("fine AS")].rstrip().rstrip(",")
_TRIED = "SELECT image * 1000 + seq AS cand, a AS seq, 'full_' || a AS name, 'full_plate' AS source, CASE a WHEN 0 THEN t WHEN 1 THEN translate(t, '0125', 'OIZS') ELSE substr(t, 1, 2 + seq % 5) END AS t, ((seq + a) % 7)::DOUBLE / 7 AS conf, 0.03 AS bonus, true AS success, false AS two FROM base, (SELECT unnest([0, 1, 2]) AS a)"
_NEAR = f"greatest(CASE WHEN a.w * a.h + b.w * b.h - {IOU('a', 'b')} <= 0 THEN 0 ELSE {IOU('a', 'b')} / (a.w * a.h + b.w * b.h - {IOU('a', 'b')}) END, {IOU('a', 'b')} / greatest(least(a.w * a.h, b.w * b.h), 2.220446049250313e-16)) >= 0.42"
E2E = f"""{P}, {B}, base AS (SELECT boxes.* EXCLUDE score, x / 50 AS score, t FROM boxes JOIN plates ON image = k), {_scored(_TRIED, "own")}, {_FIRST("own", "total", "x")},
same AS (SELECT a.cand, a.seq, a.name, a.conf, a.score, a.t, x.total AS least, count(*) OVER (PARTITION BY a.cand) AS many FROM own a JOIN x ON a.cand = x.cand AND a.t = substr(x.t, 1, length(x.t) - 1) WHERE x.conf <= 0.35 AND regexp_matches(x.t, '^[A-Z]{{1,4}}[0-9]{{1,4}}[A-Z]$')), {_FIRST("same", "score", "wk")},
z AS (SELECT x.cand, x.two, coalesce(w.t, x.t) AS t, coalesce(w.conf, x.conf) AS conf, coalesce(w.name || '+trim_weak_suffix', x.name) AS name FROM x LEFT JOIN (SELECT * FROM wk WHERE many >= 2 AND score >= least - 0.12) w ON x.cand = w.cand),
src AS (SELECT DISTINCT z.cand AS k, z.t AS orig, e.t AS src FROM z JOIN own e ON z.cand = e.cand WHERE e.t <> '' UNION SELECT cand, t, t FROM z), {_MEND},
fine AS (SELECT w3.k AS cand, CASE WHEN go THEN b.t ELSE a.t END AS t, CASE WHEN go THEN 'trim_head' ELSE label END AS label, z.conf, z.name, m.t <> m.orig AS repaired FROM w3 JOIN z ON w3.k = z.cand JOIN mend m ON m.k = w3.k),
sh AS (SELECT b.image, b.seq, f.t, {_shape("f.t")['p']} AS p, {_shape("f.t")['d']} AS d, {_shape("f.t")['s']} AS s, {_shape("f.t")['o']} AS o, length(f.t) AS n, {_PART("b.score")} AS det, {_PART(f"({_PART('x / 80')} + {_PART('y / 40')} + {_PART('x / 50')}) / 3 - 0.35 * {_PART('seq / 10')}")} AS ev, {_PART("conf")} AS rec, y / 20 AS frame, seq % 5 / 100 AS left_m,
  concat_ws('+', name, CASE WHEN repaired THEN 'pattern_repair' END, nullif(label, '')) AS variant FROM base b JOIN fine f ON f.cand = b.image * 1000 + b.seq),
sc AS{FINAL.split("sc AS", 1)[1]},
big AS (SELECT image, seq, t, greatest(1.0, floor(x - w * 0.35)) AS x, greatest(1.0, floor(y - h * 0.35)) AS y, ceil(x + w + w * 0.35) AS x2, ceil(y + h + h * 0.35) AS y2, row_number() OVER (PARTITION BY image ORDER BY score DESC, seq) AS place FROM base),
pad AS (SELECT image, seq, place, x, greatest(1.0, x2 - x) AS w, CASE WHEN greatest(1.0, y2 - y) < 36 THEN greatest(1.0, y - floor((36 - greatest(1.0, y2 - y)) / 2)) ELSE y END AS y,
  CASE WHEN greatest(1.0, y2 - y) < 36 THEN greatest(1.0, y + greatest(1.0, y2 - y) - 1 + ceil((36 - greatest(1.0, y2 - y)) / 2) - greatest(1.0, y - floor((36 - greatest(1.0, y2 - y)) / 2)) + 1) ELSE greatest(1.0, y2 - y) END AS h FROM big),
ev AS (SELECT p.*, sh.t, sh.variant, {_PART("f")} AS before, row_number() OVER (PARTITION BY p.image ORDER BY {_PART("f")} DESC, place) AS r FROM pad p JOIN fin ON p.image = fin.image AND p.seq = fin.seq JOIN sh ON p.image = sh.image AND p.seq = sh.seq WHERE place <= 10),
mv AS (SELECT a.image, a.seq, list(CASE WHEN length(a.t) > length(b.t) THEN 0.08 ELSE -0.16 END ORDER BY b.r) AS ds FROM ev a JOIN ev b ON a.image = b.image AND a.seq <> b.seq WHERE {_NEAR} AND a.t <> '' AND b.t <> '' AND length(a.t) <> length(b.t) AND (contains(a.t, b.t) OR contains(b.t, a.t)) GROUP BY a.image, a.seq),
af AS (SELECT ev.*, CASE WHEN ds IS NULL THEN before ELSE list_reduce(list_prepend(before, ds), lambda acc, v: least(1.0, greatest(0.0, acc + v))) END AS final FROM ev LEFT JOIN mv ON ev.image = mv.image AND ev.seq = mv.seq),
pk AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY final DESC, before DESC, place) AS top, count(*) OVER (PARTITION BY image) AS many FROM af), {IMAGES}"""


@query(_double(f"""WITH {E2E} SELECT path AS "imagePath", CASE WHEN failed THEN 'error' WHEN t IS NULL THEN 'plate_not_found' WHEN t <> '' THEN 'ok' ELSE 'ocr_failed' END AS status, CASE WHEN failed OR t IS NULL THEN '' ELSE t END AS "plateText", {_rule("CASE WHEN failed OR t IS NULL THEN '' ELSE t END", 0, chr(39) + 'Unknown' + chr(39))} AS "stateName",
  round(CASE WHEN failed OR t IS NULL THEN 0.0 ELSE final END, 6) AS confidence, CASE WHEN NOT failed AND t IS NOT NULL THEN variant END AS variant, CASE WHEN failed OR t IS NULL THEN 0 ELSE many END::INT AS evaluated, CASE WHEN failed THEN 'unreadable' WHEN t IS NULL THEN '{recognition.NO_PLATE}' WHEN t <> '' THEN '{recognition.DONE}' ELSE '{recognition.NO_TEXT}' END AS said
FROM images LEFT JOIN (SELECT * FROM pk WHERE top = 1) c ON images.image = c.image"""))
def end_to_end(spark, d):
    """Every image's result from its candidates and their attempts."""
    x = _candidates(spark, d).withColumns({"score": F.col("box.x") / 50, "profile": F.lit("single_line"), "framing": F.col("box.y") / 20, "left_margin": F.col("seq") % 5 / 100})
    text_of = plates(spark, d).select(F.col("k").alias("image"), "t")
    base = x.select("image", "seq", "box").join(text_of, "image")
    t = F.array(F.col("t"), F.translate("t", "0125", "OIZS"), F.substring(F.col("t"), F.lit(1), 2 + F.col("seq") % 5))
    tried = base.select("image", "seq", F.posexplode(t).alias("attempt", "text")).select("image", "seq", "attempt", F.concat(F.lit("full_"), F.col("attempt").cast("string")).alias("name"), F.lit("full_plate").alias("source"), F.lit("Line").alias("layout"), "text", ((F.col("seq") + F.col("attempt")) % 7 / 7).alias("conf"), F.lit(True).alias("success"))
    # No hints: plates of one row, as the profile says, without readings of rows.
    found = recognition.results(_images(spark, d), x, tried, None)
    return found.select("imagePath", "status", "plateText", "stateName", F.round("confidence", 6).alias("confidence"), "variant", F.coalesce("many", F.lit(0)).alias("evaluated"), F.get("messages", F.lit(0)).alias("said"))


@query(_double(f"WITH {_rows_sql(layout.RECTIFIED, 0.10)}, u AS (SELECT image, 'top' AS row, t FROM rowed WHERE is_two UNION ALL SELECT image, 'bottom', b FROM rowed WHERE is_two), v AS (SELECT image, row, floor(t.x1) AS x1, floor(t.y1) AS y1, greatest(1.0, ceil(t.x2) - floor(t.x1)) AS w, greatest(1.0, ceil(t.y2) - floor(t.y1)) AS h FROM u), "
  "p AS (SELECT image, row, greatest(1.0, floor(x1 - w * 0.07)) AS x, greatest(1.0, floor(y1 - h * 0.07)) AS y, least(240.0, ceil(x1 + w + w * 0.07)) AS x2, least(100.0, ceil(y1 + h + h * 0.07)) AS y2 FROM v) SELECT image, row, x, y, greatest(1.0, x2 - x) AS w, greatest(1.0, y2 - y) AS h FROM p"))  # fmt: skip
def row_bounds(spark, d):
    x = glyphs(spark, d).select("image", layout.character_boxes(F.col("boxes"), "area", 240.0, 100.0, layout.RECTIFIED).alias("c")).where(F.size("c") > 0)
    x = x.withColumn("r", layout.split_rows(F.col("c"), 100.0, 0.10)).where("r.two")
    both = x.select("image", F.posexplode(layout.row_boxes([F.col("r.top"), F.col("r.bottom")], 240, 100)).alias("i", "b"))
    return both.select("image", F.when(F.col("i") == 0, "top").otherwise("bottom").alias("row"), "b.*")
