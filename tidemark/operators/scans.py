"""Scans along series that no task does whole: the row before, running numbers,
values carried forward, and as-of joins.

A series is cut into buckets of its order (days, numbers or seconds). Windows run
within a bucket only, so one long series is many tasks. What a bucket hands on is
one row: how many rows it has, its last one and its last value that is not null.
Only these meet by series, in one array; buckets should be so wide that a series
has some thousands at most.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of order in a bucket: eleven years of days.
WIDTH = 4096


def place(order: Column, kind: str) -> Column:
    """A whole number that follows the order: kind is date, timestamp (seconds)
    or a number's type."""
    if kind == "date":
        return F.unix_date(order).cast("long")
    return F.unix_seconds(order.cast("timestamp")) if kind.startswith("timestamp") else order.cast("long")


def bucketed(rows: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """rows plus _b, the bucket that order falls in."""
    return rows.withColumn("_b", F.floor(place(F.col(order), dict(rows.dtypes)[order]) / width))


def scanned(rows: DataFrame, key: tuple[str, ...], order: list[str], value: str | None = None, counted: Callable[[Column, Column], Column] | None = None, **made: str) -> DataFrame:
    """rows (bucketed by order[0], with _b) plus the columns of made, by name:
    "before" (value of the row before, null for the first), "number" (from 1; of
    the rows for which counted(value, value before) holds, if it is given, null
    for others) or "upto" (the last value that is not null, this row's included).

    key must not be null; order tells all rows of a key apart, or else which of
    equal ones comes first is open."""
    at, v = [F.col(c) for c in order], F.col(value) if value else F.lit(None).cast("int")
    counted = counted or (lambda x, y: F.lit(True))
    here, when = Window.partitionBy(*key, "_b").orderBy(*at), F.struct(*at)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumns({"_v": v, "_lag": F.lag(F.struct(v.alias("v"))).over(here)})
    # whether a bucket's first row counts is not known within it
    r = r.withColumn("_one", F.when(F.col("_lag").isNull(), 0).otherwise(F.coalesce(counted(F.col("_v"), F.col("_lag.v")), F.lit(False)).cast("int")))
    r = r.withColumns({"_i": F.sum("_one").over(upto), "_upto": F.last("_v", ignorenulls=True).over(upto)})
    each = r.groupBy(*key, "_b").agg(
        F.sum("_one").alias("n"), F.min_by(F.struct("_v"), when).alias("first"), F.max_by(F.struct("_v"), when).alias("last"), F.max_by("_v", F.when(F.col("_v").isNotNull(), when)).alias("found")
    )
    first = lambda x, i: F.coalesce(counted(x["first"]["_v"], F.get("a", i - 1)["last"]["_v"]), F.lit(False)).cast("long")
    state = F.col("a0")
    a = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_b", "n", "first", "last", "found"))).alias("a"))
    a = a.withColumn("a0", F.transform("a", lambda x, i: F.struct(x["_b"].alias("_b"), first(x, i).alias("one"), (x["n"] + first(x, i)).alias("n"), x["found"].alias("found"))))
    handed = F.transform(state, lambda x, i: F.struct(
        x["_b"].alias("_b"), (F.aggregate(F.slice(state, 1, i), x["one"], lambda s, y: s + y["n"])).alias("_n"), F.get("a", i - 1)["last"].alias("_last"),
        F.aggregate(F.slice(state, 1, i), F.lit(None).cast(each.schema["found"].dataType), lambda s, y: F.coalesce(y["found"], s)).alias("_found"), x["one"].alias("_first"),
    ))
    r = r.join(a.select(*key, F.inline(handed)), [*key, "_b"])
    counts = F.when(F.col("_lag").isNull(), F.col("_first")).otherwise(F.col("_one")) > 0
    how = {
        "before": F.when(F.col("_lag").isNull(), F.col("_last._v")).otherwise(F.col("_lag.v")), "upto": F.coalesce("_upto", "_found"),
        "number": F.when(counts, F.col("_n") + F.col("_i")).cast("int"),
    }
    return r.select(*rows.columns, *(how[k].alias(name) for name, k in made.items()))


DIRECTIONS = ("backward", "forward", "nearest")


def _fine(at: Column, kind: str) -> Column:
    """at as a number that tells all its values apart."""
    if kind == "date":
        return F.unix_date(at)
    return F.unix_micros(at.cast("timestamp")) if kind.startswith("timestamp") else at


def as_of(left: DataFrame, right: DataFrame, key: tuple[str, ...], at: str, ties: list[str], direction: str = "backward", tolerance: float | None = None, exact: bool = True, width: int = WIDTH) -> DataFrame:
    """Every row of left with the row of right of its key that is nearest in time:
    at or before (backward), at or after (forward), or either, where backward wins
    an even distance.

    Columns of right but key come as <name>_right, null where none is found. at
    must have the same type in both: a date, a timestamp or a number. Of rows of
    right at one time the last by ties is taken (the first, forward). tolerance:
    how far off it may be, in days, seconds or units; exact=False leaves equal
    times out. Rows of left with a null key or time find nothing and stay; such
    rows of right are never found. Repeated rows of left all stay. width: days,
    seconds or units of a bucket.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}")
    others, kind = [c for c in right.columns if c not in key], dict(left.dtypes)[at]
    unit = 1e6 if kind.startswith("timestamp") else 1
    whole = [F.col(c).isNotNull() for c in (*key, at)]
    known = functools.reduce(lambda a, b: a & b, whole)
    time = _fine(F.col(at), kind)
    found = F.struct(time.alias("_t"), *(F.col(c).alias(f"{c}_right") for c in others))
    quotes = right.where(known).select(*key, time.alias("_t"), found.alias("_right"), F.struct(*ties).alias("_tie"))

    def one_way(rows: DataFrame, sign: int) -> DataFrame:
        """rows (row, key, _t) plus what is found on one side, or null."""
        best = quotes.groupBy(*key, "_t").agg((F.max_by if sign > 0 else F.min_by)("_right", "_tie").alias("_right"))
        none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        # at equal times a row of right comes before the rows of left that may find it
        r = best.select(*key, F.col("_t") * sign, "_right", F.lit(0 if exact else 1), none(rows, "row"))
        both = r.union(rows.select(*key, F.col("_t") * sign, none(best, "_right"), F.lit(1 if exact else 0), "row")).toDF(*key, "_t", "_right", "_side", "row")
        got = scanned(both.withColumn("_b", F.floor(F.col("_t") / (width * unit))), key, ["_t", "_side"], "_right", _got="upto").where("row is not null")
        off = (F.col("_t") - F.col("_got._t") * sign) / unit
        near = F.lit(True) if tolerance is None else off <= tolerance
        return got.select("row", *key, (F.col("_t") * sign).alias("_t"), F.when(near, F.col("_got")).alias("_got"))

    rows = left.where(known).select(F.struct(*left.columns).alias("row"), *key, time.alias("_t"))
    if direction == "nearest":
        back = one_way(rows, 1).select(F.struct("row", F.col("_got").alias("back")).alias("row"), *key, "_t")
        got = one_way(back, -1).select(F.col("row.row").alias("row"), "_t", F.col("row.back").alias("_back"), F.col("_got").alias("_ahead"))
        later = F.col("_ahead").isNotNull() & (F.col("_back").isNull() | (F.col("_ahead._t") - F.col("_t") < F.col("_t") - F.col("_back._t")))
        got = got.select("row", F.when(later, F.col("_ahead")).otherwise(F.col("_back")).alias("_got"))
    else:
        got = one_way(rows, 1 if direction == "backward" else -1)
    types = dict(right.dtypes)
    lost = left.where(~F.coalesce(known, F.lit(False))).select("*", *(F.lit(None).cast(types[c]).alias(f"{c}_right") for c in others))
    return got.select(*(F.col("row")[c].alias(c) for c in left.columns), *(F.col("_got")[f"{c}_right"].alias(f"{c}_right") for c in others)).unionByName(lost)
