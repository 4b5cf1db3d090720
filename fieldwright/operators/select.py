"""Exact values at given ranks of large groups, without sorting a group in one place."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a level cuts the values into.
RANGES = 4096


def _meet(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left joined with right on `by`, null keys with null keys; the columns of `by` come once."""
    other = right.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in by], *[c for c in right.columns if c not in by])
    if not by:
        return left.crossJoin(F.broadcast(other))  # one row a pick
    matched = reduce(and_, [left[c].eqNullSafe(other[f"__{c}"]) for c in by])
    return left.join(other, matched).drop(*[f"__{c}" for c in by])


def rank_picks(rows: DataFrame, by: Iterable[str], value: str, ranks: dict[str, Callable[[Column], Column]], levels: int = 2, ranges: int = RANGES) -> DataFrame:
    """(by, each name of `ranks`): the value at the rank that the function gives for the group's number of values.

    Ranks count from 0 in ascending order; values are picked, never interpolated. Null and NaN values don't count; a null
    group is a group; a group without values has no row; an empty table gives none; ties take as many ranks as there are.

    Each level cuts the span of values that can hold the rank into equal ranges, counts them (partial counts before the
    shuffle, `ranges` rows a group at most behind it) and goes on with the range where the running count passes the rank;
    behind the last, the distinct values of one range are counted and put in order. So a group may hold all rows. Where
    values are so uneven that one range of the last level holds most of them, more levels are the remedy.
    """
    by = list(by)
    v = F.col("__v")
    base = rows.select(*[F.col(f"`{c}`") for c in by], F.col(f"`{value}`").alias("__v")).where(v.isNotNull() & ~F.isnan(v.cast("double")))
    ends = base.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    picks = F.array(*[F.struct(F.lit(name).alias("__pick"), rank(F.col("__n")).cast("long").alias("__k")) for name, rank in ranks.items()])
    state = ends.select(*by, F.inline(picks), "__lo", "__hi")

    def within(now: DataFrame) -> DataFrame:
        return _meet(base, now, by).where((v >= F.col("__lo")) & (v <= F.col("__hi")))

    def passed(counts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("__c").over(Window.partitionBy(*by, "__pick").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("__upto", upto).where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__c") <= F.col("__k")))

    for _ in range(levels):
        lo, hi = F.col("__lo").cast("double"), F.col("__hi").cast("double")
        at = F.when(hi > lo, F.least(F.floor((v.cast("double") - lo) / (hi - lo) * ranges), F.lit(ranges - 1))).otherwise(F.lit(0))
        counts = within(state).groupBy(*by, "__pick", "__k", at.cast("long").alias("__at")).agg(F.count("*").alias("__c"), F.min("__v").alias("__l"), F.max("__v").alias("__h"))
        state = passed(counts, "__at").select(*by, "__pick", (F.col("__k") - F.col("__upto") + F.col("__c")).alias("__k"), F.col("__l").alias("__lo"), F.col("__h").alias("__hi"))
    last = passed(within(state).groupBy(*by, "__pick", "__k", "__v").agg(F.count("*").alias("__c")), "__v")
    return last.groupBy(*by).agg(*[F.max(F.when(F.col("__pick") == name, v)).alias(name) for name in ranks])
