"""Sliding-window KPI aggregation per cell and per slice, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ranlens.functions.aggregates import compliance_pct, flag_sum
from ranlens.schemas import CELL_KPIS, SLICE_KPIS
from ranlens.settings import WATERMARK_DELAY, WINDOW_DURATION, WINDOW_SLIDE


def _count_set(flag: str) -> Column:
    return F.coalesce(flag_sum(flag), F.lit(0).cast("long"))


def windowed_kpis(
    silver: DataFrame,
    keys: list[str],
    measures: dict[str, Column],
    duration: str,
    slide: str,
    delay: str,
    approx_ues: bool,
) -> DataFrame:
    """``measures`` and the number of distinct UEs per (window, keys).

    Measures are combined before their shuffle, so a hot key sends one partial
    row per task. UEs are counted apart: duplicates of (window, keys, UE) are
    dropped on a key that includes the UE, which splits a hot cell or slice over
    all tasks, and only per-task counts reach the last step. No set of UEs is
    ever held for a group. The last step groups instead of joining because the
    keys may be NULL. Every step is legal on a stream in append mode.

    ``approx_ues`` replaces the distinct step by a bounded sketch.
    """
    events = silver.withWatermark("event_timestamp", delay).select(
        F.window("event_timestamp", duration, slide).alias("window"), "*"
    )
    if approx_ues:
        sketch = F.approx_count_distinct("ue_id").alias("unique_ues")
        return _flat(events.groupBy("window", *keys).agg(*_named(measures), sketch))
    totals = events.groupBy("window", *keys).agg(*_named(measures))
    seen = events.select("window", *keys, "ue_id").dropDuplicates()
    merged = (
        totals.unionByName(seen, allowMissingColumns=True)
        .groupBy("window", *keys)
        .agg(*(F.max(name).alias(name) for name in measures), F.count("ue_id").alias("unique_ues"))
    )
    return _flat(merged)


def _named(measures: dict[str, Column]) -> list[Column]:
    return [measure.alias(name) for name, measure in measures.items()]


def _flat(windowed: DataFrame) -> DataFrame:
    return windowed.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*"
    ).drop("window")


def cell_kpis(
    silver: DataFrame,
    duration: str = WINDOW_DURATION,
    slide: str = WINDOW_SLIDE,
    delay: str = WATERMARK_DELAY,
    approx_ues: bool = False,
) -> DataFrame:
    """Gold cell table: KPIs per (window, cell, base station)."""
    averages = ("rsrp_dbm", "rsrq_db", "sinr_db", "cqi", "dl_throughput_mbps", "ul_throughput_mbps",
                "latency_ms", "jitter_ms", "packet_loss_pct", "bler_pct", "rb_utilization_pct")
    measures = {f"avg_{name}": F.avg(name) for name in averages}
    measures |= {
        "p95_dl_throughput_mbps": F.percentile_approx("dl_throughput_mbps", 0.95),
        "p95_latency_ms": F.percentile_approx("latency_ms", 0.95),
        "event_count": F.count("*"),
        "sla_breach_count": _count_set("sla_breach"),
        "anomaly_count": _count_set("is_anomaly"),
    }
    kpis = windowed_kpis(silver, ["cell_id", "gnb_id"], measures, duration, slide, delay, approx_ues)
    return kpis.select(*CELL_KPIS.names)


def slice_kpis(
    silver: DataFrame,
    duration: str = WINDOW_DURATION,
    slide: str = WINDOW_SLIDE,
    delay: str = WATERMARK_DELAY,
    approx_ues: bool = False,
) -> DataFrame:
    """Gold slice table: KPIs per (window, slice); events without a slice form a group."""
    averages = ("dl_throughput_mbps", "ul_throughput_mbps", "latency_ms", "packet_loss_pct", "jitter_ms")
    measures = {f"avg_{name}": F.avg(name) for name in averages}
    measures |= {
        "p99_latency_ms": F.percentile_approx("latency_ms", 0.99),
        "event_count": F.count("*"),
        "sla_breach_count": _count_set("sla_breach"),
    }
    kpis = windowed_kpis(silver, ["slice_id", "slice_type"], measures, duration, slide, delay, approx_ues)
    compliance = compliance_pct(F.col("sla_breach_count"), F.col("event_count"))
    return kpis.withColumn("sla_compliance_pct", compliance).select(*SLICE_KPIS.names)
