"""OCR attempts: one row an attempt, keyed by candidate and sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plateflow.functions import text as texts
from plateflow.functions.text import attempt_score, let, norm
from plateflow.operators.repair import repaired
from plateflow.settings import DEFAULTS

# What an attempt counts by its source.
SUPPORT = {"text_only": 1.0, "text_only_trimmed": 0.75, "full_plate": 0.70, "row_composite": 0.30, "rowwise_combo": 0.25, "hybrid_two_row": 0.25}
#: What a reading of two rows one by one gains on a plate of two rows, and one of letters above and digits below.
ROWWISE, HYBRID = 0.24, 0.10


def support_weight(source: Column, name: Column | None = None) -> Column:
    """What an attempt counts by its source; at least or at most so much by the beginning of its name."""
    out = F.lit(0.35)
    for known, weight in SUPPORT.items():
        out = F.when(source == known, weight).otherwise(out)
    if name is None:
        return out
    by_name = F.when(name.startswith("textonly_"), F.greatest(out, F.lit(0.85))).when(name.startswith("rowcomposite_"), F.least(out, F.lit(0.30)))
    return by_name.when(name.isin("rowwise_combo", "hybrid_two_row"), F.least(out, F.lit(0.25))).otherwise(out)


def best_attempt(attempts: DataFrame) -> DataFrame:
    """cand, seq, text, score of each candidate's best attempt; the earlier one of equals. One aggregation, no sort."""
    t = norm(F.col("text"))
    scored = attempts.select("cand", F.struct(F.round(attempt_score(t, F.col("conf")), 6).alias("score"), (-F.col("seq")).alias("order"), t.alias("text")).alias("x"))
    best = scored.groupBy("cand").agg(F.max("x").alias("x"))
    return best.select("cand", (-F.col("x.order")).alias("seq"), F.col("x.text").alias("text"), F.col("x.score").alias("score"))


def support_vote(attempts: DataFrame) -> DataFrame:
    """cand, text, support, votes for each text that a candidate's attempts read."""
    weight = support_weight(F.col("source"), F.col("name") if "name" in attempts.columns else None)
    return attempts.groupBy("cand", norm(F.col("text")).alias("text")).agg(F.round(F.sum(weight), 6).alias("support"), F.count("*").alias("votes")).where("text <> ''")


def best_rows(readings: DataFrame) -> DataFrame:
    """cand, rows: of each row of a plate the best reading (text, conf), in order of rows. readings: cand, row, seq, name, text, conf,
    two_row. A candidate's readings (fifty or so) meet in a window and leave it in its order, so a task holds one candidate's, and
    readings that come in order of candidates are not sorted again."""
    t = texts.row_text(norm(F.col("text")), F.col("row"), F.col("two_row"))
    score = texts.row_score(t, F.col("conf"), F.col("row"), F.col("two_row")) + texts.row_variant_bonus(F.col("name"), F.col("row"), F.col("two_row"))
    read = F.struct("row", score.alias("score"), (-F.col("seq")).alias("order"), t.alias("text"), F.col("conf").alias("conf"))
    each = readings.select("cand", read.alias("x")).withColumn("every", F.collect_list("x").over(Window.partitionBy("cand")))
    every = each.groupBy("cand").agg(F.first("every").alias("every"))
    of = lambda k: F.array_max(F.filter("every", lambda r: r["row"].eqNullSafe(k)))
    best = F.transform(F.sort_array(F.array_distinct("every.row")), of)
    return every.select("cand", F.transform(best, lambda r: F.struct(r["text"].alias("text"), r["conf"].alias("conf"))).alias("rows"))


#: What is known of the best attempt on its way.
_BEST = ("name", "t", "conf", "success", "chars", "p", "d", "s", "ordered")


def _best(a: Column, total: Column, name: Column | None = None) -> Column:
    return F.struct(*((a["name"] if name is None else name).alias(k) if k == "name" else a[k].alias(k) for k in _BEST), total.alias("total"))


def weak_suffix(best: Column, every: Column) -> Column:
    """The best attempt, or, if it ends in a letter that is read with little confidence, the best of two attempts or more that read
    the same without it. Most attempts end at the first test."""
    trimmed = F.substring(best["t"], F.lit(1), F.length(best["t"]) - 1)

    def other(x: Column) -> Column:
        same = F.filter(every, lambda a: a["t"] == x)
        top = lambda c: F.aggregate(c, F.get(c, F.lit(0)), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
        taken = lambda b: F.when(b["score"] >= best["total"] - 0.12, _best(b, b["score"], F.concat(b["name"], F.lit("+trim_weak_suffix")))).otherwise(best)
        return let(same, lambda c: F.when(F.size(c) >= 2, let(top(c), taken)).otherwise(best))

    doubt = (best["conf"] <= 0.35) & best["ordered"] & best["p"].between(1, 4) & best["d"].between(1, 4) & (best["s"] == 1)
    return F.when(doubt, let(trimmed, other)).otherwise(best)


def supported(best: Column, every: Column, two_row: Column) -> Column:
    """The best attempt, or, on a plate of two rows, one of another letter that more of the attempts support. Tests come in order of
    their cost, and what needs the texts' rules comes last."""
    support = lambda t: F.aggregate(every, F.lit(0.0), lambda acc, a: F.when(a["t"] == t, acc + a["weight"]).otherwise(acc))
    priority = lambda t: texts.identify_state(t)["priority"]
    digits = lambda a: F.substring(a["t"], a["p"] + 1, a["d"])

    def like(a: Column) -> Column:
        """One letter away, with the same digits."""
        whole = a["ordered"] & a["p"].between(1, 4) & a["d"].between(3, 4) & (a["s"] <= 1)
        near = (a["p"] == best["p"]) & (a["d"] == best["d"]) & whole & (a["t"] != best["t"]) & (F.abs(F.length(a["t"]) - F.length(best["t"])) <= 1)
        return near & (digits(a) == digits(best)) & (texts.edit_count(best["t"], a["t"]) == 1)

    def judged(own: Column) -> Column:
        strong = F.filter(F.transform(F.filter(every, like), lambda a: F.struct(a.alias("a"), support(a["t"]).alias("n"))), lambda r: (r["n"] >= 1.5) & (r["n"] > own + 0.45))

        def placed(found: Column) -> Column:
            rated = F.transform(found, lambda r: F.struct(r["a"].alias("a"), r["n"].alias("n"), priority(r["a"]["t"]).alias("priority")))
            able = let(priority(best["t"]), lambda k: F.filter(rated, lambda r: r["priority"] + 5 >= k))
            rank = lambda r: r["n"] + 0.10 * F.least(F.lit(1.0), r["priority"] / 100)
            top = lambda c: F.aggregate(c, F.get(c, F.lit(0)), lambda a, b: F.when(rank(b) > rank(a), b).otherwise(a))
            chosen = lambda a: _best(a, a["score"], F.concat(a["name"], F.lit("+attempt_support")))
            return let(able, lambda c: F.when(F.size(c) > 0, let(top(c)["a"], chosen)).otherwise(best))

        return let(strong, lambda c: F.when(F.size(c) > 0, placed(c)).otherwise(best))

    fit = two_row & best["ordered"] & (best["d"] >= 3) & (best["p"] >= 2) & (best["s"] <= 1) & F.exists(every, like)
    return F.when(fit, let(support(best["t"]), judged)).otherwise(best)


def gathered(attempts: DataFrame, hints: DataFrame | None, *keys: str, candidates: DataFrame | None = None, settings: dict = DEFAULTS) -> DataFrame:
    """keys, _a (the attempts in order, with what their texts are worth), _h (layout, profile, rows) and _c (the candidate's record, if
    candidates are given): what belongs to a candidate meets in one shuffle by the first key, without a join. attempts: keys, attempt
    (its place), name, source, layout, text, conf, success and, if there are any, chars (confidences of the characters); hints: keys,
    layout, profile, rows (text and conf of the rows of a plate, null for none); candidates: keys and _c.

    Attempts are rated as rows, in generated code, before they meet; what hangs on the hints is a bonus of theirs for each case.
    Without hints (None: nothing is known of any plate) there is no _h, and the attempts hold their total and nothing that only hints
    ask for."""
    suffix = settings["classification"]["suffix_letter"]
    chars = F.col("chars").cast("array<double>") if "chars" in attempts.columns else F.lit(None).cast("array<double>")
    name, source, lay, t, conf = (F.col(k) for k in ("name", "source", "layout", "_t", "_conf"))
    rated = attempts.select(*keys, "attempt", "name", "source", "layout", norm(F.col("text")).alias("_raw"), F.col("conf").cast("double").alias("_conf"), "success", chars.alias("_chars"))
    rated = rated.withColumn("_t", F.col("_raw") if suffix else texts.apart(texts.canonical(F.col("_raw"), suffix), F.col("_raw")))
    rated = rated.withColumns({f"_{k}": v for k, v in texts.shape_parts(t).items()})
    shaped, most = {k: F.col(f"_{k}") for k in ("p", "d", "s", "ordered")}, texts.most(F.col("_raw")).alias("most")
    rated = rated.withColumns({"_score": texts.apart(F.when(F.col("success"), attempt_score(t, conf, shaped)).otherwise(-1.0), t), "_one": texts.variant_bonus(source, lay, F.lit(False)), "_two": texts.variant_bonus(source, lay, F.lit(True)), "_weight": support_weight(source, name)})
    if hints is None:
        entry = F.struct("attempt", "name", F.col("_raw").alias("raw"), conf.alias("conf"), "success", F.col("_chars").alias("chars"), t.alias("t"), *(v.alias(k) for k, v in shaped.items()), F.col("_score").alias("score"), (F.col("_score") + F.col("_one")).alias("total"), most)
    else:
        entry = F.struct("attempt", "name", "source", "layout", F.col("_raw").alias("raw"), conf.alias("conf"), "success", F.col("_chars").alias("chars"), t.alias("t"), *(v.alias(k) for k, v in shaped.items()), *(F.col(f"_{k}").alias(k) for k in ("score", "one", "two", "weight")), most)
    whole = rated.select(*keys, entry.alias("_a"))
    if hints is not None:
        whole = whole.unionByName(hints.select(*keys, F.struct("layout", "profile", "rows").alias("_h")), allowMissingColumns=True)
    if candidates is not None:
        whole = whole.unionByName(candidates.select(*keys, "_c"), allowMissingColumns=True)
    whole = whole.repartition(keys[0])
    if candidates is None:
        return whole.groupBy(*keys).agg(F.sort_array(F.collect_list("_a")).alias("_a"), *([F.max("_h").alias("_h")] if hints is not None else []))
    # A candidate's rows (fifty or so) meet in a window and only its own goes on: they are sorted once, and no list is packed, dealt and
    # unpacked between the two halves of an aggregation.
    own = Window.partitionBy(*keys)
    beside = whole.withColumns({"_every": F.collect_list("_a").over(own), **({"_h": F.max("_h").over(own)} if hints is not None else {})}).where("_c IS NOT NULL")
    return beside.select(*keys, F.sort_array("_every").alias("_a"), *(["_h"] if hints is not None else []), "_c")


def _made(x: DataFrame, at: str, name: str, raw: Column, conf: Column, bonus: Column, suffix: bool) -> DataFrame:
    """Adds the columns at (an attempt that is put together from others, as an entry of _a) and at_total, in steps of generated code;
    raw null: no attempt."""
    kind, c = x.schema["_a"].dataType.elementType, lambda k: F.col(f"{at}_{k}")
    x = x.withColumns({f"{at}_raw": texts.apart(raw, F.col("layout")), f"{at}_conf": conf}).withColumn(f"{at}_t", texts.canonical(c("raw"), suffix))
    x = x.withColumns({f"{at}_{k}": texts.apart(v, c("t")) if k == "s" else v for k, v in texts.shape_parts(c("t")).items()})
    shaped = {k: c(k) for k in ("p", "d", "s", "ordered")}
    x = x.withColumn(f"{at}_score", texts.apart(attempt_score(c("t"), c("conf"), shaped), c("t")))
    own = {"name": F.lit(name), "source": F.lit(name), "raw": c("raw"), "conf": c("conf"), "success": c("t") != "", "t": c("t"), **shaped, "score": c("score"), "weight": support_weight(F.lit(name), F.lit(name)), "most": texts.most(c("raw"))}
    entry = F.struct(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))
    return x.withColumns({at: F.when(c("raw").isNotNull(), entry), f"{at}_total": c("score") + bonus})


def read(candidates: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """Adds layout, text, confidence, variant, success, chars, attempted and most to what `gathered` makes: the reading of each candidate
    before its repair, all texts attempted, and the greatest of what `texts.most` says of them. The best of a candidate's attempts (fifty at most; the earlier one of equals) is a
    greatest struct, and the readings that two rows give are columns. Without a suffix letter by the settings each reading loses the
    letter behind a whole plate, and the steps for weak suffixes fall away."""
    suffix, kept = settings["classification"]["suffix_letter"], candidates.columns
    if "_h" not in kept:
        return _read(candidates.withColumn("layout", texts.hint_layout(F.lit(""), F.lit(""))), suffix, kept)
    two = F.col("_two")
    x = candidates.withColumn("layout", texts.hint_layout(F.col("_h.layout"), F.col("_h.profile")))
    x = x.withColumns({"_two": F.col("layout") == "two_row", "_composite": F.coalesce(F.col("_h.profile") == "two_row", F.lit(False))})
    bonus = lambda a: F.when(two, a["two"]).otherwise(a["one"]) + F.when(F.col("_composite") & (a["source"] == "row_composite"), 0.05).otherwise(0.0)
    totals = F.transform("_a", lambda a, i: F.struct((a["score"] + bonus(a)).alias("total"), (-i).alias("order")))
    lines = F.transform("_h.rows", lambda r: F.struct(texts.canonical(norm(r["text"]), suffix).alias("text"), r["conf"].cast("double").alias("conf")))
    x = x.withColumns({"_top": F.array_max(totals), "_r": lines})
    x = x.withColumn("_b", F.get("_a", -F.col("_top.order")))
    # Rows: a reading of both (combo), and the head of the best so far before the digits below (mixed).
    some = F.size(F.array_remove("_r.text", ""))
    x = x.withColumn("_has", F.coalesce((F.size("_r") >= 2) & (some > 0), F.lit(False)))
    sure = F.aggregate("_r", F.lit(0.0), lambda a, r: a + F.when(r["text"] != "", texts.clamp(r["conf"])).otherwise(0.0)) / some
    x = _made(x, "_m", "rowwise_combo", F.when(F.col("_has"), F.array_join("_r.text", "")), F.when(F.col("_has"), sure), F.when(two, ROWWISE).otherwise(0.0), suffix)
    better = F.col("_has") & (F.col("_m_total") > F.col("_top.total"))
    x = x.withColumn("_n", F.when(better, _best(F.col("_m"), F.col("_m_total"))).otherwise(F.when(F.col("_b").isNotNull(), _best(F.col("_b"), F.col("_top.total")))))
    head, below = F.regexp_extract("_n.t", "^([A-Z]{1,4})", 1), F.regexp_extract(F.get("_r", F.lit(1))["text"], "([0-9]{1,4})", 1)
    x = x.withColumns({"_head": F.when(F.col("_has") & two, head), "_below": F.when(F.col("_has") & two, below)})
    mixed = (F.col("_head") != "") & (F.col("_below") != "")
    x = _made(x, "_v", "hybrid_two_row", F.when(mixed, F.concat("_head", "_below")), F.when(mixed, (F.col("_n.conf") + F.col("_m.conf")) / 2), F.lit(HYBRID), suffix)
    more = F.when(F.col("_v").isNotNull(), F.array("_m", "_v")).when(F.col("_has"), F.array("_m"))
    x = x.withColumns({"_x": F.when(F.col("_v").isNotNull() & (F.col("_v_total") > F.col("_n.total")), _best(F.col("_v"), F.col("_v_total"))).otherwise(F.col("_n")), "_all": F.when(F.col("_has"), F.concat("_a", more)).otherwise(F.col("_a"))})
    x = x.withColumn("_y", weak_suffix(F.col("_x"), F.col("_all")) if suffix else F.col("_x")).withColumn("_z", supported(F.col("_y"), F.col("_all"), two))
    return _spelt(x, kept)


def _read(x: DataFrame, suffix: bool, kept: list[str]) -> DataFrame:
    """`read` without hints: one row by its layout, and no readings of rows. The first of the greatest totals is found without a
    lambda."""
    x = x.withColumn("_top", F.array_max("_a.total"))
    # Without any total the first attempt stands, as the greatest struct would have it.
    best = F.get("_a", (F.coalesce(F.array_position("_a.total", F.col("_top")), F.lit(1)) - 1).cast("int"))
    x = x.withColumn("_b", best).withColumn("_x", F.when(F.col("_b").isNotNull(), _best(F.col("_b"), F.col("_top"))))
    return _spelt(x.withColumns({"_z": weak_suffix(F.col("_x"), F.col("_a")) if suffix else F.col("_x"), "_all": F.col("_a")}), kept)


def _spelt(x: DataFrame, kept: list[str]) -> DataFrame:
    """The columns of `read` from _z, the best attempt, and _all, all of them."""
    none = {"text": F.lit(""), "confidence": F.lit(0.0), "variant": F.lit(""), "success": F.lit(False)}
    named = {"text": "t", "confidence": "conf", "variant": "name", "success": "success"}
    out = x.withColumns({k: F.coalesce(F.col(f"_z.{named[k]}"), v) for k, v in none.items()} | {"chars": F.col("_z.chars"), "attempted": F.col("_all.raw"), "most": F.array_max("_all.most")})
    return out.select(*(k for k in kept if k not in ("_a", "_h")), "layout", *none, "chars", "attempted", "most")


def refined(x: DataFrame, text: str, confidence: Column, suffix: bool = True) -> DataFrame:
    """Adds _text and _label: what `text.refined` makes of a text, with each step's columns in generated code. A step that a text does
    not come to has null for a text, so that its tests cost next to nothing."""
    parts = ("t", "p", "d", "s", "ordered", "priority", "score")

    def stated(x: DataFrame, at: str, t: Column) -> DataFrame:
        c = lambda k: F.col(f"_{at}_{k}")
        x = x.withColumn(f"_{at}_t", t).withColumns({**{f"_{at}_{k}": v for k, v in texts.shape_parts(c("t")).items()}, f"_{at}_rule": texts.apart(texts.rule_number(c("t")), c("t"))})
        known = {k: c(k) for k in ("p", "d", "s", "ordered")}
        return x.withColumns({f"_{at}_score": texts.apart(texts.refinement_score(c("t"), known, c("rule")), c("t")), f"_{at}_priority": texts.rule_priority(c("rule"))})

    def taken(x: DataFrame, at: str, better: Column, label: str) -> DataFrame:
        x = x.withColumn("_better", F.coalesce(better, F.lit(False)))
        return x.withColumns({f"_n_{k}": F.when(F.col("_better"), F.col(f"_{at}_{k}")).otherwise(F.col(f"_n_{k}")) for k in parts} | {"_label": F.when(F.col("_better"), label).otherwise(F.col("_label"))})

    n, kept = lambda k: F.col(f"_n_{k}"), x.columns
    cut = F.substring(n("t"), F.lit(1), F.length(n("t")) - 1)
    x = stated(x, "n", F.col(text)).withColumn("_label", F.lit(""))
    x = taken(stated(x, "c", F.when(n("s") > 1, cut)), "c", F.col("_c_score") > n("score") + 0.06, "trim_tail")
    if suffix:
        plain = F.col("_w_ordered") & F.col("_w_p").between(1, 4) & F.col("_w_d").between(1, 4) & (F.col("_w_s") == 0)
        x = taken(stated(x, "w", F.when((n("s") == 1) & (confidence <= 0.25), cut)), "w", plain & (F.col("_w_score") >= n("score") - 0.02), "trim_weak_suffix")
    x = stated(x, "h", F.when(n("p") >= 2, F.substring(n("t"), F.lit(2), F.length(n("t")))))
    higher = F.when(F.col("_h_priority") > n("priority"), F.col("_h_score") > n("score") + 0.04).when(F.col("_h_priority") == n("priority"), F.col("_h_score") > n("score") + 0.02)
    x = taken(x, "h", F.col("_h_t").isNotNull() & higher, "trim_head")
    return x.select(*kept, n("t").alias("_text"), "_label")


def finished(before: DataFrame, keys: tuple[str, ...], settings: dict = DEFAULTS, *carried: str) -> DataFrame:
    """keys, carried columns, text, confidence, variant, layout, pattern, repaired, success, characters (of the text, with the
    confidence of each) and recognition (their mean): readings after repair and refinement. A reading goes through repair as one
    record, so nothing is joined; where before is dealt by the keys, nothing is shuffled."""
    record = F.struct("confidence", "variant", "layout", "success", "chars", *carried)
    suffix = settings["classification"]["suffix_letter"]
    # With suffix letters the text is one of those attempted, as it is.
    most = F.col("most") if suffix else F.greatest("most", texts.most(F.col("text")))
    staged = before.select(*keys, "text", "attempted", most.alias("_most"), texts.least_gain(F.col("confidence"), F.col("layout")).alias("_gain"), record.alias("_r"))
    mended = repaired(staged, keys, "text", "_gain", "attempted", "_r", dealt=True, clean=True, most="_most")
    mended = refined(mended.select(*keys, "text", "changed", "_r"), "text", F.col("_r.confidence"), suffix)
    steps = F.array_compact(F.array(F.nullif(F.col("_r.variant"), F.lit("")), F.when(F.col("changed"), F.lit("pattern_repair")), F.nullif(F.col("_label"), F.lit(""))))
    made = mended.select(*keys, *(F.col(f"_r.{k}").alias(k) for k in carried), F.col("_text").alias("text"), F.col("_r.confidence").alias("confidence"), F.array_join(steps, "+").alias("variant"), F.col("_r.layout").alias("layout"), texts.pattern_label(F.col("_text")).alias("pattern"), F.col("changed").alias("repaired"), F.col("_r.success").alias("success"), F.col("_r.chars").alias("_chars"))
    each = texts.expanded_confidence(F.col("text"), F.col("_chars"), F.col("confidence"))
    # The mean of a text's one confidence is that itself: no array is made for it.
    own = (F.size("_chars") == F.length("text")) & (F.size("_chars") > 0)
    recognition = F.when(own, recognition_score(F.transform("_chars", texts.clamp), F.col("confidence"))).otherwise(texts.clamp(F.coalesce(F.col("confidence"), F.lit(0.0))))
    return made.withColumns({"characters": texts.top_candidates(texts.characters(F.col("text")), each), "recognition": recognition}).drop("_chars")


def recognition_score(characters: Column, whole: Column) -> Column:
    """The mean confidence of a text's characters; of the text, where there is none for characters; within 0 and 1."""
    own = F.aggregate(characters, F.lit(0.0), lambda a, v: a + v) / F.size(characters)
    return texts.clamp(F.coalesce(F.when(F.size(characters) > 0, own), whole, F.lit(0.0)))


def _placed(attempts: DataFrame) -> DataFrame:
    return attempts if "attempt" in attempts.columns else attempts.withColumnRenamed("seq", "attempt")


def chosen(attempts: DataFrame, hints: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """cand, layout, text, confidence, variant, success, chars, attempted: see `read`. attempts: cand, seq, and the rest of `gathered`."""
    return read(gathered(_placed(attempts), hints, "cand", settings=settings).where(F.size("_a") > 0), settings)


def recognised(attempts: DataFrame, hints: DataFrame, settings: dict = DEFAULTS) -> DataFrame:
    """The reading of each candidate that was attempted; see `finished`."""
    return finished(chosen(attempts, hints, settings), ("cand",), settings)
