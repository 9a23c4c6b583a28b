"""One row per breached KPI, and the table-driven form of the breach flag."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ranlens.functions.sla import Limits, any_beyond, beyond_limit, sla_limit
from ranlens.schemas import SLA_VIOLATIONS
from ranlens.settings import SLA_LIMITS, SLA_RULES, SlaRule

EVENT_KEYS = SLA_VIOLATIONS.names[:6]
VIOLATION = "struct<violation_type:string,kpi_name:string,kpi_value:double,threshold_value:double,severity:string>"


def _violation(rule: SlaRule, limit: Column) -> Column:
    row = F.struct(
        F.lit(rule.violation_type).alias("violation_type"),
        F.lit(rule.kpi).alias("kpi_name"),
        F.col(rule.kpi).cast("double").alias("kpi_value"),
        limit.alias("threshold_value"),
        F.lit(rule.severity).alias("severity"),
    )
    return F.when(beyond_limit(rule, limit), row)


def sla_violations(
    silver: DataFrame,
    detected_at: Column | datetime | None = None,
    limits: Limits | DataFrame = SLA_LIMITS,
    rules: tuple[SlaRule, ...] = SLA_RULES,
) -> DataFrame:
    """One row per breaching event and KPI beyond its slice's limit.

    A single pass: each event is expanded to its KPIs and the fine ones are
    dropped at once, inside generated code. The table is scanned once and, with limits
    as a mapping, nothing is shuffled. A limits table (``limits_table``) is joined
    by slice, small as it is without a shuffle of the events. Without rules or limits
    the result is empty. Works on streams.
    """
    if detected_at is None:
        detected_at = F.current_timestamp()
    elif isinstance(detected_at, datetime):
        detected_at = F.lit(detected_at)
    breaching, limit_of = silver.filter("sla_breach"), lambda rule: sla_limit(rule, limits)
    if isinstance(limits, DataFrame):
        breaching, limit_of = breaching.join(limits, "slice_type"), lambda rule: F.col(f"limit_{rule.kpi}")
    none = F.array().cast(f"array<{VIOLATION}>")
    checked = F.array(*(_violation(rule, limit_of(rule)) for rule in rules)) if rules else none
    return (
        breaching.select(*EVENT_KEYS, detected_at.alias("detected_at"), F.inline(checked))
        .filter("kpi_name IS NOT NULL")
        .select(*SLA_VIOLATIONS.names)
    )


def with_table_breach(events: DataFrame, limits: DataFrame) -> DataFrame:
    """``sla_breach`` judged by a limits table with one row per slice.

    Use it when the limits live in a table; the literal form needs no join. Spark
    decides from the table's size how to join. Works with a streaming left side.
    """
    joined = events.join(limits, "slice_type", "left")
    flag = any_beyond(lambda rule: F.col(f"limit_{rule.kpi}"))
    return joined.withColumn("sla_breach", flag).drop(*(f"limit_{rule.kpi}" for rule in SLA_RULES))
