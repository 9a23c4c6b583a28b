"""Look-back dashboard reports.

``as_of`` is the end of the look-back; it defaults to the current time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ranlens.functions.aggregates import average, compliance_pct, flag_mean_pct, flag_share_pct, flag_sum
from ranlens.functions.signal import load_status, signal_score
from ranlens.functions.timing import minute, recent
from ranlens.operators.percentiles import with_percentiles
from ranlens.plans.layers import Layers
from ranlens.plans.network import rounded, throughput_summary
from ranlens.settings import SLA_LIMITS

AsOf = Column | datetime | None


def _recent_events(layers: Layers, interval: str, as_of: AsOf) -> DataFrame:
    return recent(layers.silver, "event_timestamp", interval, as_of)


def total_events(layers: Layers) -> DataFrame:
    return layers.silver.agg(F.count("*").alias("total_events"))


def event_rate_recent(layers: Layers, as_of: AsOf = None) -> DataFrame:
    return (
        _recent_events(layers, "1 hour", as_of)
        .groupBy(minute("event_timestamp").alias("ts"))
        .agg(F.count("*").alias("events_per_minute"))
        .orderBy("ts")
    )


def sla_scorecard(layers: Layers, as_of: AsOf = None) -> DataFrame:
    return (
        _recent_events(layers, "15 minutes", as_of)
        .filter("slice_type IS NOT NULL")
        .groupBy("slice_type")
        .agg(compliance_pct(flag_sum("sla_breach"), F.count("*")).alias("sla_compliance_pct"))
        .orderBy("slice_type")
    )


def throughput_recent(layers: Layers, as_of: AsOf = None) -> DataFrame:
    wanted = {"p95_dl_mbps": ("dl_throughput_mbps", 0.95), "p95_ul_mbps": ("ul_throughput_mbps", 0.95)}
    report = throughput_summary(_recent_events(layers, "15 minutes", as_of), wanted)
    return report.select("slice_type", "avg_dl_mbps", "p95_dl_mbps", "avg_ul_mbps", "p95_ul_mbps")


def latency_recent(layers: Layers, as_of: AsOf = None) -> DataFrame:
    events = _recent_events(layers, "15 minutes", as_of)
    slowest = events.groupBy("slice_type").agg(F.max("latency_ms").alias("max_ms"))
    wanted = {f"p{percent}_ms": ("latency_ms", percent / 100) for percent in (50, 95, 99)}
    report = with_percentiles(slowest, events, ["slice_type"], wanted).select("slice_type", *wanted, "max_ms")
    return rounded(report, dict.fromkeys([*wanted, "max_ms"], 3)).orderBy("p50_ms")


def cell_signal_quality(layers: Layers, as_of: AsOf = None) -> DataFrame:
    return (
        _recent_events(layers, "15 minutes", as_of)
        .groupBy("cell_id", "gnb_id")
        .agg(
            average("rsrp_dbm", 1).alias("avg_rsrp_dbm"),
            average("sinr_db", 1).alias("avg_sinr_db"),
            average("cqi", 2).alias("avg_cqi"),
            F.round(F.avg(signal_score()), 2).alias("signal_score"),
            F.count("*").alias("event_count"),
        )
        .orderBy("avg_rsrp_dbm", "cell_id", "gnb_id")
    )


def top_violations(layers: Layers, as_of: AsOf = None, rows: int = 20) -> DataFrame:
    return (
        recent(layers.violations, "detected_at", "15 minutes", as_of)
        .groupBy("violation_type", "severity", "slice_type")
        .agg(
            F.count("*").alias("violation_count"),
            F.count_distinct("cell_id").alias("cells_affected"),
            F.count_distinct("ue_id").alias("ues_affected"),
            average("kpi_value", 4).alias("avg_kpi_value"),
            F.round(F.max("kpi_value"), 4).alias("max_kpi_value"),
            average("threshold_value", 4).alias("sla_threshold"),
        )
        .orderBy(F.desc("violation_count"), "violation_type", "severity", "slice_type")
        .limit(rows)
    )


def anomaly_rate_recent(layers: Layers, as_of: AsOf = None) -> DataFrame:
    return (
        _recent_events(layers, "1 hour", as_of)
        .groupBy(minute("event_timestamp").alias("ts"))
        .agg(
            flag_mean_pct("is_anomaly").alias("anomaly_rate_pct"),
            F.count("*").alias("total_events"),
            flag_sum("is_anomaly").alias("anomaly_count"),
        )
        .orderBy("ts")
    )


def rb_utilisation(layers: Layers, as_of: AsOf = None, rows: int = 20) -> DataFrame:
    return (
        _recent_events(layers, "15 minutes", as_of)
        .groupBy("cell_id")
        .agg(
            average("rb_utilization_pct", 1).alias("avg_rb_util_pct"),
            load_status(F.avg("rb_utilization_pct")).alias("load_status"),
        )
        .orderBy(F.desc("avg_rb_util_pct"), "cell_id")
        .limit(rows)
    )


def breach_leaderboard(layers: Layers, as_of: AsOf = None, rows: int = 10) -> DataFrame:
    return (
        _recent_events(layers, "30 minutes", as_of)
        .groupBy("cell_id", "gnb_id")
        .agg(
            flag_sum("sla_breach").alias("breach_count"),
            F.count("*").alias("total_events"),
            flag_share_pct("sla_breach", 1).alias("breach_rate_pct"),
            average("rsrp_dbm", 1).alias("avg_rsrp_dbm"),
            average("latency_ms", 2).alias("avg_latency_ms"),
        )
        .orderBy(F.desc("breach_count"), "cell_id", "gnb_id")
        .limit(rows)
    )


def urllc_latency_gauge(layers: Layers, as_of: AsOf = None) -> DataFrame:
    """One row, also when no event is recent."""
    target = SLA_LIMITS["URLLC"]["latency_ms"]
    events = _recent_events(layers, "5 minutes", as_of).filter("slice_type = 'URLLC' AND latency_ms IS NOT NULL")
    gauge = events.agg(
        F.avg("latency_ms").alias("avg_latency_ms"),
        flag_share_pct(F.col("latency_ms") > target).alias("pct_exceeding_sla"),
    )
    wanted = {"p99_latency_ms": ("latency_ms", 0.99), "p95_latency_ms": ("latency_ms", 0.95)}
    report = with_percentiles(gauge, events, [], wanted).select(
        F.lit("URLLC").alias("slice"),
        *wanted,
        "avg_latency_ms",
        F.lit(target).alias("sla_target_ms"),
        "pct_exceeding_sla",
    )
    return rounded(report, dict.fromkeys([*wanted, "avg_latency_ms"], 3))
