"""Service-level breach expressions and the limits table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ranlens.functions.choose import choose
from ranlens.settings import SLA_LIMITS, SLA_RULES, SlaRule

#: Slice to KPI to limit. A KPI without a limit is not judged.
Limits = Mapping[str, Mapping[str, float]]


def beyond_limit(rule: SlaRule, limit: Column) -> Column:
    """Strictly on the bad side of the limit; NaN never is, NULL gives NULL."""
    value = F.col(rule.kpi)
    if rule.bound == "min":
        return value < limit
    return (value > limit) & ~F.isnan(value)


def any_beyond(limit_of: Callable[[SlaRule], Column]) -> Column:
    """Whether any KPI is beyond ``limit_of(rule)``; never NULL."""
    checks = [beyond_limit(rule, limit_of(rule)) for rule in SLA_RULES]
    return F.coalesce(reduce(or_, checks), F.lit(False))


def _limit(own: Mapping[str, float], rule: SlaRule) -> Column:
    return F.lit(own.get(rule.kpi)).cast("double")


def sla_breach(limits: Limits = SLA_LIMITS) -> Column:
    """Breach flag of an event; one CASE on the slice with the limits as literals.

    A missing KPI is not judged; an unknown or missing slice never breaches.
    """
    return choose(
        [(F.col("slice_type") == name, any_beyond(lambda rule, own=own: _limit(own, rule))) for name, own in limits.items()],
        F.lit(False),
    )


def sla_limit(rule: SlaRule, limits: Limits = SLA_LIMITS) -> Column:
    """The limit of a rule for the event's slice; NULL for a slice without limits."""
    return choose(
        [(F.col("slice_type") == name, _limit(own, rule)) for name, own in limits.items()],
        F.lit(None).cast("double"),
    )


def limits_table(spark: SparkSession, limits: Limits = SLA_LIMITS) -> DataFrame:
    """The limits as a table of one row per slice: ``slice_type`` and ``limit_<kpi>``."""
    rows = [(name, *(own.get(rule.kpi) for rule in SLA_RULES)) for name, own in limits.items()]
    columns = ", ".join(f"limit_{rule.kpi} double" for rule in SLA_RULES)
    return spark.createDataFrame(rows, f"slice_type string, {columns}")
