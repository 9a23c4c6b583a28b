"""Table schemas of the three layers."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, REAL, WHOLE, COUNT, FLAG, TIME = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)

# The event columns in table order with their typed form; the flag says whether a NULL is allowed.
EVENT_COLUMNS = (
    ("event_id", TEXT, False),
    ("event_timestamp", TIME, False),
    ("gnb_id", TEXT, False),
    ("cell_id", TEXT, False),
    ("ue_id", TEXT, False),
    ("slice_id", TEXT, True),
    ("slice_type", TEXT, True),
    ("rsrp_dbm", REAL, True),
    ("rsrq_db", REAL, True),
    ("sinr_db", REAL, True),
    ("cqi", WHOLE, True),
    ("dl_throughput_mbps", REAL, True),
    ("ul_throughput_mbps", REAL, True),
    ("latency_ms", REAL, True),
    ("jitter_ms", REAL, True),
    ("packet_loss_pct", REAL, True),
    ("mcs_index", WHOLE, True),
    ("bler_pct", REAL, True),
    ("rb_utilization_pct", REAL, True),
    ("latitude", REAL, True),
    ("longitude", REAL, True),
    ("handover_count", WHOLE, True),
    ("is_anomaly", FLAG, True),
)


def _schema(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


# Bronze holds everything as text so that a bad payload is kept, not lost.
BRONZE = _schema(*((name, TEXT, nullable) for name, _, nullable in EVENT_COLUMNS))

SILVER = _schema(
    *EVENT_COLUMNS,
    ("signal_quality_class", TEXT, True),
    ("sla_breach", FLAG, True),
    ("ingested_at", TIME, False),
)

# What came as a payload and is no event.
QUARANTINE = _schema(("payload", TEXT, True), ("failure", TEXT, False), ("received_at", TIME, False))

CELL_KPIS = _schema(
    ("window_start", TIME, False),
    ("window_end", TIME, False),
    ("cell_id", TEXT, False),
    ("gnb_id", TEXT, False),
    ("avg_rsrp_dbm", REAL, True),
    ("avg_rsrq_db", REAL, True),
    ("avg_sinr_db", REAL, True),
    ("avg_cqi", REAL, True),
    ("avg_dl_throughput_mbps", REAL, True),
    ("avg_ul_throughput_mbps", REAL, True),
    ("p95_dl_throughput_mbps", REAL, True),
    ("avg_latency_ms", REAL, True),
    ("p95_latency_ms", REAL, True),
    ("avg_jitter_ms", REAL, True),
    ("avg_packet_loss_pct", REAL, True),
    ("avg_bler_pct", REAL, True),
    ("avg_rb_utilization_pct", REAL, True),
    ("event_count", COUNT, False),
    ("unique_ues", COUNT, False),
    ("sla_breach_count", COUNT, False),
    ("anomaly_count", COUNT, False),
)

MINUTE_ROLLUP = _schema(
    ("minute", TIME, False),
    ("slice_type", TEXT, True),
    ("cell_id", TEXT, False),
    ("gnb_id", TEXT, False),
    ("events", COUNT, False),
    *(
        column
        for name in ("score", "rsrp_dbm", "sinr_db", "cqi", "latency_ms", "rb_utilization_pct")
        for column in ((f"{name}_sum", REAL, True), (f"{name}_count", COUNT, False))
    ),
    *(column for name in ("sla_breach", "is_anomaly") for column in ((f"{name}_set", COUNT, False), (f"{name}_count", COUNT, False))),
    ("earliest_event", TIME, False),
    ("latest_event", TIME, False),
    ("ues", T.BinaryType(), False),
)

SLICE_KPIS = _schema(
    ("window_start", TIME, False),
    ("window_end", TIME, False),
    ("slice_id", TEXT, True),
    ("slice_type", TEXT, True),
    ("avg_dl_throughput_mbps", REAL, True),
    ("avg_ul_throughput_mbps", REAL, True),
    ("avg_latency_ms", REAL, True),
    ("p99_latency_ms", REAL, True),
    ("avg_packet_loss_pct", REAL, True),
    ("avg_jitter_ms", REAL, True),
    ("event_count", COUNT, False),
    ("unique_ues", COUNT, False),
    ("sla_breach_count", COUNT, False),
    ("sla_compliance_pct", REAL, True),
)

SLA_VIOLATIONS = _schema(
    ("event_id", TEXT, False),
    ("event_timestamp", TIME, False),
    ("cell_id", TEXT, False),
    ("ue_id", TEXT, False),
    ("slice_id", TEXT, True),
    ("slice_type", TEXT, True),
    ("violation_type", TEXT, False),
    ("kpi_name", TEXT, False),
    ("kpi_value", REAL, False),
    ("threshold_value", REAL, False),
    ("severity", TEXT, False),
    ("detected_at", TIME, False),
)
