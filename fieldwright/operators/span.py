"""The extent of a profile: where a share of its weight begins and ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a part of a profile.
PART = 64


def trimmed_span(profile: DataFrame, key: str = "doc_id", position: str = "position", weight: str = "weight", trim: float = 0.02, part: int = PART) -> DataFrame:
    """profile(key, position, weight) -> (key, lo, hi, size): the first positions at which the running share of the weight
    reaches trim and 1 - trim; hi is at least lo + 1. size is the last position plus one.

    Positions are whole numbers from 0; absent ones weigh nothing, as null weights do; several rows of one position add
    up. A profile that weighs nothing spans all of it: 0 to size - 1. A null key is a key; rows without a position are
    ignored; an empty table gives no rows.

    Running sums go over the parts of a profile first, then within the one part in which each share is reached, so one
    profile may hold any part of the rows. Parts are summed before they are shuffled; positions are shuffled once, to
    meet the parts sought, and only those of such a part go on.
    """
    rows = profile.select(F.col(f"`{key}`").alias("k"), F.col(f"`{position}`").cast("long").alias("p"), F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)).alias("w")).where("p IS NOT NULL")
    rows = rows.withColumn("part", F.floor(F.col("p") / part))
    parts = rows.groupBy("k", "part").agg(F.sum("w").alias("s"), F.max("p").alias("most"))
    by_part = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("k")
    parts = parts.withColumns({"upto": F.sum("s").over(by_part), "total": F.sum("s").over(whole), "size": F.max("most").over(whole) + 1})
    shares = {"lo": trim, "hi": 1.0 - trim}

    def reached(share: float, upto: Column) -> Column:
        return (F.col("total") > 0) & (F.try_divide(upto, F.col("total")) >= share)

    first = parts.groupBy("k").agg(F.first("total").alias("total"), F.first("size").alias("size"), *[F.min(F.when(reached(s, F.col("upto")), F.struct("part", (F.col("upto") - F.col("s")).alias("before")))).alias(n) for n, s in shares.items()])
    sought = first.select("k", "total", F.explode(F.array(*[F.struct(F.lit(n).alias("which"), F.lit(s).alias("share"), F.col(n)["part"].alias("at"), F.col(n)["before"].alias("before")) for n, s in shares.items()])).alias("x")).select("k", "total", "x.*").where("at IS NOT NULL")
    s = sought.select(F.col("k").alias("sk"), "total", "which", "share", "at", "before")
    inside = rows.join(s, rows["k"].eqNullSafe(s["sk"]) & (rows["part"] == s["at"]))
    upto = F.col("before") + F.sum("w").over(Window.partitionBy("k", "which").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow))  # rows of one position together
    found = inside.withColumn("upto", upto).where(F.try_divide(F.col("upto"), F.col("total")) >= F.col("share")).groupBy(F.col("k").alias("fk")).agg(*[F.min(F.when(F.col("which") == n, F.col("p"))).alias(n) for n in shares])
    out = first.select("k", "total", "size").join(found, F.col("k").eqNullSafe(F.col("fk")), "left")
    none = F.col("total") <= 0
    lo = F.when(none, F.lit(0).cast("long")).otherwise(F.col("lo"))
    hi = F.when(none, F.col("size") - 1).otherwise(F.greatest("hi", F.col("lo") + 1))
    return out.select(F.col("k").alias(key), lo.alias("lo"), hi.alias("hi"), "size")
