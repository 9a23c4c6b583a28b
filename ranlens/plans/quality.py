"""Bronze inspections and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ranlens.functions.aggregates import flag_mean_pct
from ranlens.functions.bands import alert_flag, kpi_band
from ranlens.functions.timing import minute
from ranlens.operators.running import running_total
from ranlens.operators.silver import typed
from ranlens.plans.layers import Layers
from ranlens.schemas import EVENT_COLUMNS
from ranlens.settings import ALERTS, KPI_BANDS, SLICE_IDS


def _as_rows(summary: DataFrame, keep: list[str], rows: list[Column]) -> DataFrame:
    """Turn the counters of each summary row into rows; ``rows`` are structs."""
    return summary.select(*keep, F.inline(F.array(*rows)))


def latest_events(layers: Layers, rows: int = 20) -> DataFrame:
    """The newest bronze events by time; those whose timestamp does not parse come last."""
    time = typed("event_timestamp", T.TimestampType())
    return layers.bronze.orderBy(time.desc_nulls_last(), F.desc("event_timestamp"), F.desc("event_id")).limit(rows)


def latest_events_by_text(layers: Layers, rows: int = 20) -> DataFrame:
    """The bronze events with the greatest timestamp texts, broken ones included."""
    return layers.bronze.orderBy(F.desc("event_timestamp"), F.desc("event_id")).limit(rows)


def bronze_anomaly_breakdown(layers: Layers) -> DataFrame:
    return (
        layers.bronze.groupBy("slice_type", "is_anomaly")
        .agg(F.count("*").alias("event_count"))
        .orderBy("slice_type", "is_anomaly")
    )


def ingest_audit(layers: Layers) -> DataFrame:
    """Per minute: events, anomalies, running total, and mean rate since the first minute.

    Rows whose timestamp does not parse form the first line, with a NULL minute and rate.
    """
    per_minute = (
        layers.bronze.groupBy(minute(typed("event_timestamp", T.TimestampType())).alias("minute"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("is_anomaly") == "true").alias("anomalies"))
    )
    audit = running_total(per_minute, "minute", "events", "total_events", "first_minute")
    elapsed = F.unix_seconds("minute") - F.unix_seconds("first_minute") + 60
    return audit.select(
        "minute", "events", "anomalies", "total_events", F.round(F.col("total_events") / elapsed, 2).alias("events_per_sec")
    ).orderBy("minute")


def kpi_band_counts(layers: Layers) -> DataFrame:
    """Events per slice, KPI and band: one pass of counters, then one row per counter."""
    names = [(band, label) for band in KPI_BANDS for label in ("Good", "Fair", "Poor")]
    counters = [F.count_if(kpi_band(band) == label).alias(f"{band.kpi}_{label}") for band, label in names]
    summary = layers.silver.groupBy("slice_type").agg(*counters)
    rows = [
        F.struct(
            F.lit(band.kpi).alias("kpi"), F.lit(label).alias("band"), F.col(f"{band.kpi}_{label}").alias("event_count")
        )
        for band, label in names
    ]
    return _as_rows(summary, ["slice_type"], rows).filter("event_count > 0").orderBy("slice_type", "kpi", "band")


def alert_counts(layers: Layers) -> DataFrame:
    """Events beyond each alert limit, per cell."""
    return (
        layers.silver.groupBy("cell_id")
        .agg(F.count("*").alias("total_events"), *(F.count_if(alert_flag(name)).alias(name) for name in ALERTS))
        .orderBy("cell_id")
    )


def _within(name: str, low: float, high: float) -> Column:
    return F.col(name).between(low, high)


def _positive(name: str) -> Column:
    return (F.col(name) > 0) & ~F.isnan(name)


def expectations() -> dict[str, tuple[Column, Column]]:
    """Rule name to (row is subject to the rule, row satisfies it).

    A missing value is no range error (``parse_failures`` reports it), but an
    identifier must be there.
    """
    ranges = {  # fixed values: valid ranges, both ends included
        "rsrp_dbm": (-140, -44),
        "cqi": (0, 15),
        "mcs_index": (0, 28),
        "rb_utilization_pct": (0, 100),
        "latitude": (49, 61),
        "longitude": (-8, 2),
    }
    rules = {f"{name}_in_range": (F.col(name).isNotNull(), _within(name, *ends)) for name, ends in ranges.items()}
    for name in ("dl_throughput_mbps", "ul_throughput_mbps", "latency_ms"):
        rules[f"{name}_positive"] = (F.col(name).isNotNull(), _positive(name))
    rules["packet_loss_pct_not_negative"] = (
        F.col("packet_loss_pct").isNotNull(),
        (F.col("packet_loss_pct") >= 0) & ~F.isnan("packet_loss_pct"),
    )
    for name in ("event_id", "gnb_id", "cell_id", "ue_id"):
        rules[f"{name}_not_empty"] = (F.lit(True), F.coalesce(F.col(name) != "", F.lit(False)))
    rules["slice_type_known"] = (F.col("slice_type").isNotNull(), F.col("slice_type").isin(*SLICE_IDS))
    rules["slice_id_known"] = (F.col("slice_id").isNotNull(), F.col("slice_id").isin(*SLICE_IDS.values()))
    return rules


def range_expectations(layers: Layers) -> DataFrame:
    """Failed and checked rows per rule, from one pass over the table."""
    counters, rows = [], []
    for rule, (subject, satisfied) in expectations().items():
        counters.append(F.count_if(subject & ~satisfied).alias(f"{rule}_failed"))
        counters.append(F.count_if(subject).alias(f"{rule}_total"))
        rows.append(
            F.struct(
                F.lit(rule).alias("rule"), F.col(f"{rule}_failed").alias("failed"), F.col(f"{rule}_total").alias("total")
            )
        )
    return _as_rows(layers.silver.agg(*counters), [], rows).orderBy("rule")


def coverage_summary(layers: Layers) -> DataFrame:
    """One row: volume, observed anomaly rate, distinct cells, and how many known slices occur."""
    present = [F.coalesce(F.max((F.col("slice_type") == name).cast("int")), F.lit(0)) for name in SLICE_IDS]
    return layers.silver.agg(
        F.count("*").alias("total_events"),
        flag_mean_pct("is_anomaly").alias("anomaly_rate_pct"),
        F.count_distinct("cell_id").alias("distinct_cells"),
        sum(present[1:], present[0]).alias("known_slices_present"),
    )


def payload_failures(quarantine: DataFrame) -> DataFrame:
    """How many payloads hold no event, by the reason."""
    return quarantine.groupBy("failure").agg(F.count("*").alias("payloads")).orderBy("failure")


def parse_failures(layers: Layers) -> DataFrame:
    """Per typed column: texts that do not parse, and texts that were there."""
    counters, rows = [], []
    for name, kind, _ in EVENT_COLUMNS:
        if isinstance(kind, T.StringType):
            continue
        raw = F.col(name)
        counters.append(F.count_if(raw.isNotNull() & typed(name, kind).isNull()).alias(f"{name}_failed"))
        counters.append(F.count(raw).alias(f"{name}_total"))
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"), F.col(f"{name}_failed").alias("failed"), F.col(f"{name}_total").alias("total")
            )
        )
    return _as_rows(layers.bronze.agg(*counters), [], rows).orderBy("column_name")
