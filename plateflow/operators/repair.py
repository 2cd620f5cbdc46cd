"""Repair of plate texts: candidates are rows, so that each is scored in generated code; one shuffle by key brings them together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateflow.functions.text import any_promising, apart, as_digits, as_letters, edit_count, norm, prefix_bonus, promising, readings, repair_score, room, rule_candidates, rule_number, shape_parts, split_limits, worth


def candidates(texts: DataFrame, key: str | tuple[str, ...], text: str, attempted: str | None = None, *more: str, once: tuple[str, ...] = (), least: str | None = None, clean: bool = False) -> DataFrame:
    """key, text (normalised), candidate and more columns: the readings of each text and of the texts attempted (an array), distinct
    for each of these. Texts are rows before they are read. once: those of more that only the row of the text itself keeps (null in the
    others), as they may be large. least: a column; beside the text itself only readings that may have a greater repair_score, with
    their rule's bonus, are made (others may be among them), which bounds tell by a text's letters before anything is read. clean: the
    texts are normalised already."""
    keys = (key,) if isinstance(key, str) else key
    normed = (lambda x: x) if clean else norm
    held = more if least is None or least in more else (*more, least)
    rows = texts.select(*keys, normed(F.col(text)).alias("text"), *held, *([F.col(attempted).alias("_others")] if attempted else []))
    rows = rows.withColumn("_read", F.col("text"))
    if attempted:
        every = F.array_distinct(F.concat(F.array("text"), F.coalesce("_others", F.array().cast("array<string>"))))
        rows = rows.select(*keys, "text", *held, F.posexplode(every).alias("_place", "_raw")).withColumn("_read", normed(F.col("_raw"))).where((F.col("_place") == 0) | (F.col("_read") != ""))
    else:
        rows = rows.withColumn("_place", F.lit(0))
    own = (F.col("_place") == 0) & (F.col("_k") == 0)  # the first reading is the text
    read, above, below = F.col("_read"), F.col("_letters"), F.col("_digits")
    if least is None:
        rows = rows.withColumns({"_letters": as_letters(read), "_digits": as_digits(read)})
        found = rows.withColumn("_found", F.array_distinct(F.concat(readings(read, above, below), rule_candidates(read))))
    else:
        rows = rows.withColumn("_room", room(read, F.col(least)))
        rows = rows.withColumns({f"_at_{k}": v for k, v in split_limits(read, F.col("_room")).items()})
        splits = worth(read, F.col("_room"), {k: F.col(f"_at_{k}") for k in ("lead", "tail", "tail1")})
        rows = rows.withColumns({f"_able_{p}_{s}": v for (p, s), v in splits.items()})
        able = {(p, s): F.col(f"_able_{p}_{s}") for p, s in splits}
        some = any_promising(F.col("_room"), able)
        found = rows.withColumns({"_letters": F.when(some, as_letters(read)), "_digits": F.when(some, as_digits(read))})
        made = F.when(F.col(least).isNotNull(), F.concat(promising(read, above, below, F.col("_room"), able), rule_candidates(read))).otherwise(F.array().cast("array<string>"))
        found = found.withColumn("_found", F.when(F.col("_place") == 0, F.array_distinct(F.concat(F.array("text"), made))).otherwise(made))
    # Outer, since Spark would lay a filter on the size below an inner one and make each array twice.
    laid = found.select(*keys, "text", *more, "_place", F.posexplode_outer("_found").alias("_k", "candidate"))
    if least is not None:
        laid = laid.where(own | (F.col("candidate") != F.col("text")))
    return laid.select(*keys, "text", *(F.when(own, F.col(k)).alias(k) if k in once else k for k in more), "candidate")


def repaired(texts: DataFrame, key: str | tuple[str, ...], text: str, gain: str, attempted: str | None = None, *carried: str, dealt: bool = False, clean: bool = False, most: str | None = None) -> DataFrame:
    """key, text, score, original, original_score, edits, changed, label and the carried columns. Goes through a text's candidates in
    order and changes to one that beats the best so far by gain (a column). An edit costs .015; a rule whose token has several
    characters adds .18, and .04 more from priority 90 on. key (one column or several) tells texts apart. Empty texts stay as they are.

    The best so far is never worse than the text itself, so a candidate that does not beat that is no row any more when the rows meet,
    and one that cannot by the bounds of `candidates` is none from the beginning. What is carried stays with the text's own row. Texts
    are dealt by their key before they become candidates, so that the exchange is small and the tasks are even; dealt: they are
    already; clean: all texts are normalised; most: a column, the greatest of what `text.most` says of the text and those attempted, so
    that texts which nothing can beat stay one row."""
    keys = (key,) if isinstance(key, str) else key
    c, t = F.col("candidate"), F.col("text")
    own = texts if dealt else texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys[0])
    own = own.withColumn("_text", F.col(text) if clean else norm(F.col(text)))
    first, shaped = {k: F.col(f"_o_{k}") for k in ("p", "d", "s", "ordered")}, {k: F.col(f"_s_{k}") for k in ("p", "d", "s", "ordered")}
    own = own.withColumns({**{f"_o_{k}": v for k, v in shape_parts(F.col("_text")).items()}, "_rule": apart(rule_number(F.col("_text")), F.col("_text"))})
    own = own.withColumn("_own", repair_score(F.col("_text"), first, first, F.col("_rule"))).withColumn("_least", F.col("_own") + F.col(gain))
    if most is not None:
        # What nothing can beat is not read at all.
        hopeless = F.col(most) <= F.col("_least")
        own = own.withColumns({"_least": F.when(~hopeless, F.col("_least")), **({attempted: F.when(~hopeless, F.col(attempted))} if attempted else {})})
    # What a text has goes as one record with its own row, so that the rows meet in two aggregates.
    own = own.withColumn("_kept", F.struct(F.col("_text").alias("text"), F.col(gain).alias("gain"), F.col("_own").alias("own"), *carried))
    rest = (gain, "_kept", "_own", "_o_p", "_o_d", "_o_s", "_o_ordered")
    rows = candidates(own, keys, text, attempted, *rest, once=("_kept",), least="_least", clean=clean)
    # The text's own row is rated already: nothing is looked for in null.
    rows = rows.withColumn("_c", F.nullif(c, t))
    other = F.col("_c")
    rows = rows.withColumns({**{f"_s_{k}": v for k, v in shape_parts(other).items()}, "_number": apart(rule_number(other), other)})
    rows = rows.withColumns({"_form": apart(repair_score(other, shaped, first, F.col("_number")), other), "_bonus": prefix_bonus(F.col("_number"))})
    # Edits only cost, so those of a candidate that would not be better without any are not counted.
    raised = F.when(F.col("_form") + F.col("_bonus") > F.col("_own") + F.col(gain), F.col("_form") + (F.col("_bonus") - 0.015 * edit_count(t, c)))
    rows = rows.withColumn("_score", F.when(c == t, F.col("_own")).otherwise(raised))
    # As a generator, since a filter would be pushed below the scores and make them again for itself.
    better = F.when((c == t) | (F.col("_score") > F.col("_own") + F.col(gain)), F.array(F.struct("candidate", F.col("_score").alias("score"))))
    rows = rows.select(*keys, "text", "_kept", F.explode_outer(better).alias("_x")).where("_x IS NOT NULL").select("*", "_x.candidate")
    found = rows.groupBy(*keys).agg(F.first("_kept", ignorenulls=True).alias("_k"), F.collect_set(F.when(c != t, F.col("_x"))).alias("_c"))
    found = found.select(*keys, F.col("_k.text").alias("text"), F.col("_k.gain").alias("_gain"), F.col("_k.own").alias("_own"), *(F.col(f"_k.{k}").alias(k) for k in carried), F.sort_array("_c").alias("_c"))
    start = F.struct(t.alias("candidate"), F.col("_own").alias("score"))
    best = F.aggregate("_c", start, lambda a, x: F.when(x["score"] > a["score"] + F.col("_gain"), x).otherwise(a))
    out = found.withColumn("_best", F.when((t == "") | (F.size("_c") == 0), start).otherwise(best))
    some = lambda x: F.when(t == "", 0.0).otherwise(F.col(x))
    changed = F.col("_best.candidate") != t
    return out.select(*keys, *carried, F.col("_best.candidate").alias("text"), some("_best.score").alias("score"), t.alias("original"), some("_own").alias("original_score"), edit_count(t, F.col("_best.candidate")).alias("edits"), changed.alias("changed"), F.when(changed, "pattern_repair").otherwise("").alias("label"))
