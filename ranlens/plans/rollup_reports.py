"""Look-back reports from the minute roll-up: whole minutes are sums of stored rows, the rest is read from silver.

Each equals the report of the same name in ``dashboard``, if no event came after its minute was closed. Silver is read for the
first, broken minute of the look-back and for what the roll-up does not have yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ranlens.functions.aggregates import compliance_pct
from ranlens.functions.signal import load_status
from ranlens.functions.timing import DAY_COLUMNS, utc_date
from ranlens.operators.rollups import combined, distinct_ues, mean, minute_rollup, times_set
from ranlens.plans.dashboard import AsOf
from ranlens.plans.layers import Layers


def recent_minutes(layers: Layers, interval: str, as_of: AsOf = None) -> DataFrame:
    """Roll-up rows of the events since ``as_of - interval``, of which only those that no stored minute covers are made anew."""
    as_of = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    oldest = as_of - F.expr(f"INTERVAL {interval}")
    first = F.date_trunc("minute", oldest + F.expr("INTERVAL 59.999999 SECONDS"))
    stored_to = layers.minute_rollup.agg(F.max("minute") + F.expr("INTERVAL 1 MINUTE")).scalar()
    at = F.col("event_timestamp")
    silver = layers.silver.filter((at >= oldest) & ((at < first) | (at >= F.coalesce(stored_to, first))))
    day = DAY_COLUMNS["event_timestamp"]
    if day in silver.columns:
        silver = silver.filter(F.col(day) >= utc_date(oldest))
    stored = layers.minute_rollup.filter(F.col("minute") >= first)
    if DAY_COLUMNS["window_end"] in stored.columns:
        stored = stored.filter(F.col(DAY_COLUMNS["window_end"]) >= utc_date(oldest))
    fresh = minute_rollup(silver)
    return stored.select(*fresh.columns).unionByName(fresh)


def event_rate_recent(layers: Layers, as_of: AsOf = None) -> DataFrame:
    rows = combined(recent_minutes(layers, "1 hour", as_of), ["minute"])
    return rows.select(F.col("minute").alias("ts"), F.col("events").alias("events_per_minute")).orderBy("ts")


def sla_scorecard(layers: Layers, as_of: AsOf = None) -> DataFrame:
    rows = combined(recent_minutes(layers, "15 minutes", as_of).filter("slice_type IS NOT NULL"), ["slice_type"])
    compliance = compliance_pct(times_set("sla_breach"), F.col("events"))
    return rows.select("slice_type", compliance.alias("sla_compliance_pct")).orderBy("slice_type")


def cell_signal_quality(layers: Layers, as_of: AsOf = None) -> DataFrame:
    rows = combined(recent_minutes(layers, "15 minutes", as_of), ["cell_id", "gnb_id"])
    return rows.select(
        "cell_id",
        "gnb_id",
        F.round(mean("rsrp_dbm"), 1).alias("avg_rsrp_dbm"),
        F.round(mean("sinr_db"), 1).alias("avg_sinr_db"),
        F.round(mean("cqi"), 2).alias("avg_cqi"),
        F.round(mean("score"), 2).alias("signal_score"),
        F.col("events").alias("event_count"),
    ).orderBy("avg_rsrp_dbm", "cell_id", "gnb_id")


def anomaly_rate_recent(layers: Layers, as_of: AsOf = None) -> DataFrame:
    rows = combined(recent_minutes(layers, "1 hour", as_of), ["minute"])
    rate = F.round(F.col("is_anomaly_set") / F.nullif(F.col("is_anomaly_count"), F.lit(0)) * 100, 2)
    return rows.select(
        F.col("minute").alias("ts"),
        rate.alias("anomaly_rate_pct"),
        F.col("events").alias("total_events"),
        times_set("is_anomaly").alias("anomaly_count"),
    ).orderBy("ts")


def rb_utilisation(layers: Layers, as_of: AsOf = None, rows: int = 20) -> DataFrame:
    cells = combined(recent_minutes(layers, "15 minutes", as_of), ["cell_id"])
    load = mean("rb_utilization_pct")
    return (
        cells.select("cell_id", F.round(load, 1).alias("avg_rb_util_pct"), load_status(load).alias("load_status"))
        .orderBy(F.desc("avg_rb_util_pct"), "cell_id")
        .limit(rows)
    )


def breach_leaderboard(layers: Layers, as_of: AsOf = None, rows: int = 10) -> DataFrame:
    cells = combined(recent_minutes(layers, "30 minutes", as_of), ["cell_id", "gnb_id"])
    return (
        cells.select(
            "cell_id",
            "gnb_id",
            times_set("sla_breach").alias("breach_count"),
            F.col("events").alias("total_events"),
            F.round(times_set("sla_breach") * F.lit(100.0) / F.col("events"), 1).alias("breach_rate_pct"),
            F.round(mean("rsrp_dbm"), 1).alias("avg_rsrp_dbm"),
            F.round(mean("latency_ms"), 2).alias("avg_latency_ms"),
        )
        .orderBy(F.desc("breach_count"), "cell_id", "gnb_id")
        .limit(rows)
    )


def slice_overview(layers: Layers) -> DataFrame:
    """Volume, anomaly rate, cells and estimated devices of each slice, from the roll-up alone, however long it is."""
    rows = combined(layers.minute_rollup, ["slice_type", "cell_id"])
    anomalies = F.sum("is_anomaly_set") / F.nullif(F.sum("is_anomaly_count"), F.lit(0))
    return (
        rows.groupBy("slice_type")
        .agg(
            F.sum("events").alias("total_events"),
            F.round(anomalies * 100, 2).alias("anomaly_rate_pct"),
            F.count("cell_id").alias("unique_cells"),
            F.hll_union_agg("ues").alias("ues"),
            F.min("earliest_event").alias("earliest_event"),
            F.max("latest_event").alias("latest_event"),
        )
        .withColumn("unique_ues", distinct_ues())
        .drop("ues")
        .orderBy(F.desc("total_events"))
    )
