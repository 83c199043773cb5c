"""Dense numbers and running sums over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, key: str, amount: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows with a smaller key (a number, distinct) as ``name``.

    Quantiles of the key cut the table to ordered ranges; a window sums within a range, and a table with
    one row for each range (at most ``ranges``) holds what lies before it.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    dealt = df.withColumn("_range", place).withColumn("_amount", amount)
    totals = dealt.groupBy("_range").agg(F.sum("_amount").alias("_t"))
    before = totals.select("_range", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_own", F.coalesce(F.sum("_amount").over(w), F.lit(0))).join(F.broadcast(before), "_range")  # a row for each range
    return summed.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_amount", "_own", "_before")


def dense_ids(df: DataFrame, key: str, name: str = "call_id") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the order of ``key``, whose values are distinct numbers."""
    return running_before(df, key, F.lit(1), name)
