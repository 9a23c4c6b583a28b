"""Network-wide reports: volumes, signal, throughput, latency, cells, compliance, anomalies.

Each takes the layers and returns a lazy DataFrame in its report order. Reports
with a row limit order by a complete key, so equal ranks give a stable answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ranlens.functions.aggregates import average, compliance_pct, flag_mean_pct, flag_share_pct, flag_sum
from ranlens.functions.signal import anomaly_proxy_type, signal_class_order
from ranlens.functions.timing import minute
from ranlens.operators.latest import latest_per_key
from ranlens.operators.percentiles import with_percentiles
from ranlens.plans.layers import Layers


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """The DataFrame with the named columns rounded in place."""
    return df.withColumns({name: F.round(name, places) for name, places in digits.items()})


def network_overview(layers: Layers) -> DataFrame:
    return (
        layers.silver.groupBy("slice_type")
        .agg(
            F.count("*").alias("total_events"),
            flag_mean_pct("is_anomaly").alias("anomaly_rate_pct"),
            F.count_distinct("cell_id").alias("unique_cells"),
            F.count_distinct("ue_id").alias("unique_ues"),
            F.min("event_timestamp").alias("earliest_event"),
            F.max("event_timestamp").alias("latest_event"),
        )
        .orderBy(F.desc("total_events"))
    )


def events_per_minute(layers: Layers) -> DataFrame:
    return (
        layers.silver.groupBy(minute("event_timestamp").alias("event_minute"), "slice_type")
        .agg(F.count("*").alias("events"))
        .orderBy("event_minute", "slice_type")
    )


def signal_class_distribution(layers: Layers) -> DataFrame:
    """Events per slice and signal class, with the share of the slice's events."""
    counts = (
        layers.silver.filter("rsrp_dbm IS NOT NULL")
        .groupBy("slice_type", "signal_quality_class")
        .agg(F.count("*").alias("event_count"))
    )
    of_slice = F.sum("event_count").over(Window.partitionBy("slice_type"))
    return counts.withColumn("pct_of_slice", F.round(F.col("event_count") * F.lit(100.0) / of_slice, 2)).orderBy(
        "slice_type", signal_class_order()
    )


def signal_percentiles(layers: Layers) -> DataFrame:
    events = layers.silver.filter("rsrp_dbm IS NOT NULL AND sinr_db IS NOT NULL")
    ends = events.groupBy("slice_type").agg(F.min("rsrp_dbm").alias("rsrp_min"), F.max("rsrp_dbm").alias("rsrp_max"))
    wanted = {
        "rsrp_p25": ("rsrp_dbm", 0.25),
        "rsrp_p50": ("rsrp_dbm", 0.50),
        "rsrp_p75": ("rsrp_dbm", 0.75),
        "sinr_p50": ("sinr_db", 0.50),
        "sinr_p5_worst": ("sinr_db", 0.05),
    }
    columns = ["rsrp_min", "rsrp_p25", "rsrp_p50", "rsrp_p75", "rsrp_max", "sinr_p50", "sinr_p5_worst"]
    report = with_percentiles(ends, events, ["slice_type"], wanted).select("slice_type", *columns)
    return rounded(report, dict.fromkeys(columns, 1)).orderBy("slice_type")


def throughput_summary(events: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Average and wanted percentiles of down- and uplink per slice."""
    means = events.groupBy("slice_type").agg(
        F.avg("dl_throughput_mbps").alias("avg_dl_mbps"), F.avg("ul_throughput_mbps").alias("avg_ul_mbps")
    )
    report = with_percentiles(means, events, ["slice_type"], wanted)
    report = rounded(report, dict.fromkeys(["avg_dl_mbps", "avg_ul_mbps", *wanted], 2))
    return report.orderBy(F.desc("avg_dl_mbps"))


def throughput_by_slice(layers: Layers) -> DataFrame:
    wanted = {
        "p50_dl_mbps": ("dl_throughput_mbps", 0.50),
        "p95_dl_mbps": ("dl_throughput_mbps", 0.95),
        "p95_ul_mbps": ("ul_throughput_mbps", 0.95),
    }
    report = throughput_summary(layers.silver.filter("dl_throughput_mbps IS NOT NULL"), wanted)
    return report.select("slice_type", "avg_dl_mbps", "p50_dl_mbps", "p95_dl_mbps", "avg_ul_mbps", "p95_ul_mbps")


def throughput_trend(layers: Layers) -> DataFrame:
    return layers.slice_kpis.select(
        "window_start",
        "slice_type",
        F.round("avg_dl_throughput_mbps", 2).alias("avg_dl_mbps"),
        F.round("avg_ul_throughput_mbps", 2).alias("avg_ul_mbps"),
        "event_count",
    ).orderBy("window_start", "slice_type")


def latency_by_slice(layers: Layers) -> DataFrame:
    events = layers.silver.filter("latency_ms IS NOT NULL")
    others = events.groupBy("slice_type").agg(
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("jitter_ms").alias("avg_jitter_ms"),
        F.avg("packet_loss_pct").alias("avg_packet_loss_pct"),
    )
    wanted = {f"p{percent}_latency_ms": ("latency_ms", percent / 100) for percent in (50, 95, 99)}
    digits = dict.fromkeys([*wanted, "max_latency_ms", "avg_jitter_ms"], 3) | {"avg_packet_loss_pct": 5}
    report = with_percentiles(others, events, ["slice_type"], wanted).select("slice_type", *digits)
    return rounded(report, digits).orderBy("p50_latency_ms")


def latency_trend_top(layers: Layers, rows: int = 200) -> DataFrame:
    """The first ``rows`` cell windows in time, the slowest cells of a window first."""
    trend = layers.cell_kpis.select(
        "window_start",
        "cell_id",
        F.round("avg_latency_ms", 2).alias("avg_latency_ms"),
        F.round("p95_latency_ms", 2).alias("p95_latency_ms"),
        "event_count",
        "gnb_id",
    )
    return trend.orderBy("window_start", F.desc("avg_latency_ms"), "cell_id", "gnb_id").limit(rows).drop("gnb_id")


def latest_cell_kpis(layers: Layers) -> DataFrame:
    """The newest window of each cell; every base station in that window is kept."""
    latest = latest_per_key(layers.cell_kpis, ["cell_id"], "window_end")
    return latest.select(
        "cell_id",
        "gnb_id",
        F.round("avg_rsrp_dbm", 1).alias("rsrp_dbm"),
        F.round("avg_sinr_db", 1).alias("sinr_db"),
        F.round("avg_dl_throughput_mbps", 1).alias("dl_mbps"),
        F.round("avg_latency_ms", 2).alias("latency_ms"),
        F.round("avg_rb_utilization_pct", 1).alias("rb_util_pct"),
        "event_count",
        "unique_ues",
        "sla_breach_count",
        "anomaly_count",
    ).orderBy(F.desc("sla_breach_count"), "cell_id", "gnb_id")


def sla_compliance(layers: Layers) -> DataFrame:
    return (
        layers.silver.filter("slice_type IS NOT NULL")
        .groupBy("slice_type")
        .agg(F.count("*").alias("total_events"), flag_sum("sla_breach").alias("sla_breaches"))
        .withColumn("compliance_pct", compliance_pct(F.col("sla_breaches"), F.col("total_events")))
        .orderBy("compliance_pct")
    )


def sla_compliance_trend(layers: Layers) -> DataFrame:
    return layers.slice_kpis.select(
        "window_start", "slice_type", "sla_compliance_pct", "sla_breach_count", "event_count"
    ).orderBy("window_start", "slice_type")


def violation_breakdown(layers: Layers) -> DataFrame:
    return (
        layers.violations.groupBy("violation_type", "severity", "slice_type")
        .agg(
            F.count("*").alias("violation_count"),
            F.count_distinct("cell_id").alias("affected_cells"),
            F.count_distinct("ue_id").alias("affected_ues"),
            average("kpi_value", 3).alias("avg_kpi_value"),
            average("threshold_value", 3).alias("threshold"),
        )
        .orderBy(F.desc("violation_count"))
    )


def violations_per_minute(layers: Layers) -> DataFrame:
    return (
        layers.violations.groupBy(minute("event_timestamp").alias("minute"), "violation_type", "severity")
        .agg(F.count("*").alias("violation_count"))
        .orderBy("minute", F.desc("violation_count"))
    )


def worst_cells(layers: Layers, rows: int = 10) -> DataFrame:
    """Cells with the most breaching events, the weakest signal first among equals."""
    return (
        layers.silver.groupBy("cell_id", "gnb_id")
        .agg(
            F.count("*").alias("total_events"),
            average("rsrp_dbm", 1).alias("avg_rsrp_dbm"),
            average("sinr_db", 1).alias("avg_sinr_db"),
            average("latency_ms", 2).alias("avg_latency_ms"),
            average("rb_utilization_pct", 1).alias("avg_rb_util_pct"),
            flag_sum("sla_breach").alias("sla_breaches"),
            flag_sum("is_anomaly").alias("anomaly_count"),
            flag_share_pct("sla_breach").alias("breach_rate_pct"),
        )
        .orderBy(F.desc("sla_breaches"), "avg_rsrp_dbm", "cell_id", "gnb_id")
        .limit(rows)
    )


def anomaly_trend(layers: Layers) -> DataFrame:
    return (
        layers.silver.groupBy(minute("event_timestamp").alias("minute"), "slice_type")
        .agg(
            F.count("*").alias("total_events"),
            flag_sum("is_anomaly").alias("anomaly_count"),
            flag_share_pct("is_anomaly").alias("anomaly_rate_pct"),
        )
        .orderBy("minute", "slice_type")
    )


def anomaly_proxy_breakdown(layers: Layers) -> DataFrame:
    return (
        layers.silver.filter("is_anomaly")
        .groupBy(anomaly_proxy_type().alias("anomaly_proxy_type"), "slice_type")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"))
    )
