"""Column expressions over profiles and runs: arrays that belong to one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plateflow.functions.text import let

#: More than sums of shares are off by rounding, less than two shares differ by.
ROUNDING = 1e-12


def runs(mask: Column) -> Column:
    """array<struct<first, last>>: maximal runs of true, places from 1."""
    on = lambda i: F.coalesce(F.get(mask, i), F.lit(False))
    places = F.when(F.size(mask) > 0, F.sequence(F.lit(0), F.size(mask) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: on(i) & ~on(i - 1))
    stops = F.filter(places, lambda i: on(i) & ~on(i + 1))
    return F.zip_with(starts, stops, lambda a, b: F.struct((a + 1).alias("first"), (b + 1).alias("last")))


def merge_runs(r: Column, most: int) -> Column:
    """Sorted runs, joined where at most so many places lie between them."""

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (x["first"] - F.try_element_at(acc, F.lit(-1))["last"] - 1 <= most)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), x["last"].alias("last"))))
        return F.when(near, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(r, F.slice(r, 1, 0), join)


def moving_average(values: Column, each_side: int | Column) -> Column:
    """Mean of a window that shrinks at the ends."""

    def mean(_: Column, i: Column) -> Column:
        first = F.greatest(i - each_side, F.lit(0))
        part = F.slice(values, first + 1, i + each_side + 1 - first)
        return F.aggregate(part, F.lit(0.0), lambda a, b: a + b) / F.size(part)

    return F.transform(values, mean)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def positive_mean(profile: Column) -> Column:
    """Mean of the entries above 0; null if there are none."""
    return let(F.filter(profile, lambda v: v > 0), lambda p: F.when(F.size(p) > 0, total(p) / F.size(p)))


def active(profile: Column, least: float, share: float | Column) -> Column:
    """Flags of the entries that reach a share of the mean of those above 0, and least; none if no entry is above 0. An entry that
    meets the limit counts whatever way the mean was rounded."""
    limit = F.greatest(F.lit(least), share * positive_mean(profile)) - ROUNDING
    return let(limit, lambda m: F.transform(profile, lambda v: (v > 0) & F.coalesce(v >= m, F.lit(False))))


def smoothed(profile: Column) -> Column:
    """Moving mean over a seventh of the profile, three entries at least."""
    half = F.greatest(F.lit(1), F.floor(F.size(profile) / 14)).cast("int")
    return let(half, lambda k: moving_average(profile, k))


def length(run: Column) -> Column:
    return run["last"] - run["first"] + 1


def widest_two(found: Column) -> Column:
    """struct(a, b, balance, apart) of the two longest runs (the earlier ones of equals) in their order: how alike their lengths are,
    and places from one to the other. Null if there are fewer than two."""

    def of(s: Column) -> Column:
        both = F.array_sort(F.transform(F.slice(s, 1, 2), lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last"))))
        a, b = F.get(both, F.lit(0)), F.get(both, F.lit(1))
        balance = F.greatest(F.lit(0.0), 1 - F.abs(length(a) - length(b)) / F.greatest(length(a) + length(b), F.lit(1)))
        return F.when(F.size(s) >= 2, F.struct(a.alias("a"), b.alias("b"), balance.alias("balance"), (b["first"] - a["last"]).alias("apart")))

    return let(F.array_sort(F.transform(found, lambda r: F.struct((-length(r)).alias("order"), r["first"].alias("first"), r["last"].alias("last")))), of)


def percentile(values: Column, percent: float) -> Column:
    """The value below which percent of an array's numbers lie: the i-th of n sorted ones stands for 100 (i - .5) / n percent, places
    between are interpolated, those beyond take the least or the greatest. Exact; null for an empty array."""

    def of(s: Column) -> Column:
        n = F.size(s)
        place = F.greatest(F.lit(1.0), F.least(n.cast("double"), n * percent / 100 + 0.5))
        low = F.floor(place).cast("int")
        a, b = F.get(s, low - 1), F.get(s, F.least(low, n - 1))
        return F.when(n > 0, a + (b - a) * (place - low))

    return let(F.sort_array(F.filter(values, lambda v: v.isNotNull())), of)
