"""Running totals over a calendar series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ranlens.functions.timing import utc_date


def running_total(series: DataFrame, ts: str, value: str, out: str, start: str) -> DataFrame:
    """Cumulative sum of ``value`` in ``ts`` order, one row per ``ts`` (NULL first).

    ``out`` is the sum up to and including the row, ``start`` the first ``ts`` of all.

    Days run in parallel: a total is the sum of the earlier days plus the sum
    inside the day. Only one row per calendar day passes through a single task.
    """
    dated = series.withColumn("running_day", utc_date(ts))
    days = dated.groupBy("running_day").agg(F.sum(value).alias("day_total"), F.min(ts).alias("day_start"))
    earlier = Window.orderBy(F.col("running_day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    all_days = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = days.select(
        F.col("running_day").alias("total_day"),
        F.coalesce(F.sum("day_total").over(earlier), F.lit(0)).alias("before_day"),
        F.min("day_start").over(all_days).alias(start),
    )
    inside = Window.partitionBy("running_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (
        dated.withColumn("inside_day", F.sum(value).over(inside))
        .join(days, F.col("running_day").eqNullSafe(F.col("total_day")))
        .withColumn(out, F.col("before_day") + F.col("inside_day"))
        .drop("running_day", "total_day", "before_day", "inside_day")
    )
