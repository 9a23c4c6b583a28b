"""Exact percentiles of large groups without one task per group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

# Buckets per factor e: a bucket spans values within 0.05 % of each other. The offset
# exceeds the logarithm of any double, so that no bucket number changes its sign.
BUCKET = """CASE WHEN isnan(value) THEN 3200000L WHEN value = 0 THEN 0L
    ELSE cast(signum(value) * floor((ln(least(abs(value), 1.7e308)) + 800) * 2000) AS bigint) END"""

# A bucket found with more values than MOST is cut, so often and into so many parts: 0.0005 / 4096 / 4096
# of a value is less than 150,000 steps of a double.
MOST, CUTS, PARTS = 150_000, 2, 4096


def _position(fraction: float) -> str:
    """Position of a percentile among the sorted values of its group, counted from 0."""
    return f"({fraction}D * (total - 1))"


def _part(parts: int) -> str:
    """The number of the equal part of [low, high] that a value lies in; it never falls when the value rises.

    A range too wide for a double has three parts: its ends, and what lies between.
    """
    return f"""CASE WHEN NOT high > low THEN 0L
        WHEN high - low > 1.7e308 THEN CASE value WHEN low THEN 0L WHEN high THEN 2L ELSE 1L END
        ELSE least({parts - 1}L, cast(floor((value - low) / (high - low) * {parts}) AS bigint)) END"""


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles with linear interpolation, equal to SQL ``percentile``.

    ``wanted`` maps an output column to (input column, fraction). The result has
    one row per group that holds any value; NULLs are ignored.

    The built-in aggregate keeps all distinct values of a group in one task. Here
    each step is spread: (1) equal values are counted, partly before the shuffle,
    keyed by the value itself, so a hot group or a hot value splits; (2) the
    counts are summed per value bucket, and a running sum over the bounded set of
    buckets finds those that hold a wanted rank; (3) twice, buckets found with too many values
    for one task are cut into equal parts between their least and greatest value, and the same
    running sum finds the parts; (4) only the values of those parts, and of the other buckets
    found, are sorted and numbered; (5) the two neighbours of each rank are interpolated. The
    table is scanned once, as the shuffled counts of step 1 feed all others. Where no
    bucket has too many values, adaptive execution sees that step 3 has no rows and leaves it out,
    so the counted values are joined once.

    Buckets are logarithmic, so their number is bounded for any input; a bucket
    number never falls when the value rises, and NaN is the highest. After both cuts
    a part is so narrow that 150,000 doubles at most lie in it, however many rows the
    group has and however close its values are.
    """
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    samples = ", ".join(f"struct({i} AS metric, cast(`{c}` AS double) AS value)" for i, c in enumerate(columns))
    group, bucket = [*keys, "metric"], [*keys, "metric", "bucket"]
    counts = (
        df.selectExpr(*keys, f"inline(array({samples}))")
        .filter("value IS NOT NULL")
        .selectExpr(*group, f"{BUCKET} AS bucket", "value")
        .groupBy(*bucket, "value")
        .agg(F.count("*").alias("copies"))
    )

    # The fractions of a metric are looked up by its number: a plain test of the
    # number would be pushed below step 1 and keep its shuffle from being shared.
    of_metric = [[p for column, p in wanted.values() if column == c] for c in columns]
    lookup = ", ".join(f"array({', '.join(f'{p}D' for p in fractions)})" for fractions in of_metric)
    at = "(p * (total - 1))"
    holds = " OR ".join(f"{side}({at}) BETWEEN before AND before + inside - 1" for side in ("floor", "ceil"))
    wanted_here = f"exists(array({lookup})[metric], p -> {holds})"
    measures = [
        F.sum("copies").alias("inside"), F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"),
    ]
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        counts.groupBy(*bucket)
        .agg(*measures)
        .withColumns(
            {
                "before": F.sum("inside").over(running) - F.col("inside"),
                "total": F.sum("inside").over(Window.partitionBy(*group)),
            }
        )
        .filter(wanted_here)
    )

    def values_in(ranges: DataFrame) -> DataFrame:
        """The counted values of the ranges, each beside the range that holds it."""
        sought = ranges.selectExpr(*(f"`{k}` AS target_{k}" for k in bucket), "before", "total", "low", "high")
        match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"target_{k}")) for k in bucket])
        # NaN is alone in its bucket and equals itself.
        return counts.join(sought, match & F.col("value").between(F.col("low"), F.col("high")))

    narrow, ranges = ranges.filter(f"values <= {MOST}"), ranges.filter(f"values > {MOST}")
    for _ in range(CUTS):
        parts = Window.partitionBy(*bucket, "from").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        ranges = (
            values_in(ranges)
            .withColumn("part", F.expr(_part(PARTS)))
            .withColumnsRenamed({"low": "from", "high": "to", "before": "ahead"})
            .groupBy(*bucket, "from", "ahead", "total", "part")
            .agg(*measures)
            .withColumn("before", F.col("ahead") + F.sum("inside").over(parts) - F.col("inside"))
            .filter(wanted_here)
        )

    inside = Window.partitionBy(*bucket, "low").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    numbered = values_in(narrow).unionByName(values_in(ranges)).withColumn("end", F.col("before") + F.sum("copies").over(inside))

    picks, outputs = [], []
    for name, (column, p) in wanted.items():
        metric = columns.index(column)
        for side in ("floor", "ceil"):
            here = f"metric = {metric} AND {side}({_position(p)}) BETWEEN end - copies AND end - 1"
            picks.append(F.expr(f"max(CASE WHEN {here} THEN value END) AS {name}_{side}"))
        picks.append(F.expr(f"max(CASE WHEN metric = {metric} THEN {_position(p)} END) AS {name}_at"))
        low, high, at = f"{name}_floor", f"{name}_ceil", f"{name}_at"
        outputs.append(
            f"CASE WHEN {low} = {high} THEN {low} "
            f"ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END AS {name}"
        )
    return numbered.groupBy(*keys).agg(*picks).selectExpr(*keys, *outputs)


def with_percentiles(
    summary: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """A summary with one row per group of ``df``, and exact percentiles added to its rows.

    The two are put together by grouping, as a key may be NULL; without keys the
    result is one row, also for an empty ``df``.
    """
    both = summary.unionByName(exact_percentiles(df, keys, wanted), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*(F.max(c).alias(c) for c in both.columns if c not in keys))
