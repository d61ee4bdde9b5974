"""Joins in time and outer joins, planned as one shuffle on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Left rows with the columns of the latest right row of their key at or before their time; nulls if there is none.

    Both sides are laid one after the other and a window carries the last
    right row forward, so every row is shuffled once and no pairs arise. Of
    right rows with one key and time the one with the greatest columns counts.
    Left rows without a time get nulls; right rows without one are left out.
    """
    held = F.struct(*[C(c) for c in columns]).alias("_held")
    r = right.where(C(right_time).isNotNull()).groupBy(*by, C(right_time).alias("_t")).agg(F.max(held).alias("_held")).withColumn("_side", F.lit(0))
    l = left.withColumns({"_t": C(left_time), "_side": F.lit(1)})
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(C("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select(*left.columns, *[C(f"_last.{c}").alias(c) for c in columns])


def within(points: DataFrame, spans: DataFrame, by: Sequence[str], time: str, start: str, end: str, width_days: int = 32) -> DataFrame:
    """Points joined with the spans of their key that hold their day (start and end included).

    Spans are listed in buckets of days, points lie in one bucket, and the
    bucket is part of the join key: an equi-join instead of a comparison of
    all points with all spans. Nulls meet nothing.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / width_days)
    s = spans.where(C(start) <= C(end)).withColumn("_b", F.explode(F.sequence(bucket(C(start)), bucket(C(end)))))
    p = points.where(C(time).isNotNull()).withColumn("_b", bucket(C(time)))
    return p.join(s, [*by, "_b"]).where(C(time).between(C(start), C(end))).drop("_b")


def matched(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "full_outer") -> DataFrame:
    """An outer join with a column `side` (left, right, both)."""
    j = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(key), how)
    return j.withColumn("side", F.when(C("_l").isNull(), "right").when(C("_r").isNull(), "left").otherwise("both")).drop("_l", "_r")
