"""The order of every ordered report: columns from the first key on, a minus for falling; NULLs are least."""

from __future__ import annotations

from functools import cmp_to_key

CLASSES = ("Excellent", "Good", "Fair", "Poor")

ORDERS = {
    "event_rate_recent": ["ts"],
    "sla_scorecard": ["slice_type"],
    "latency_recent": ["p50_ms"],
    "cell_signal_quality": ["avg_rsrp_dbm", "cell_id"],
    "top_violations": ["-violation_count", "violation_type", "severity", "slice_type"],
    "anomaly_rate_recent": ["ts"],
    "rb_utilisation": ["-avg_rb_util_pct", "cell_id"],
    "breach_leaderboard": ["-breach_count", "cell_id"],
    "network_overview": ["-total_events"],
    "events_per_minute": ["event_minute", "slice_type"],
    "signal_class_distribution": ["slice_type", "signal_quality_class"],
    "signal_percentiles": ["slice_type"],
    "throughput_by_slice": ["-avg_dl_mbps"],
    "throughput_recent": ["-avg_dl_mbps"],
    "throughput_trend": ["window_start", "slice_type"],
    "latency_by_slice": ["p50_latency_ms"],
    "latency_trend_top": ["window_start", "-avg_latency_ms", "cell_id"],
    "latest_cell_kpis": ["-sla_breach_count", "cell_id"],
    "sla_compliance": ["compliance_pct"],
    "sla_compliance_trend": ["window_start", "slice_type"],
    "violation_breakdown": ["-violation_count"],
    "violations_per_minute": ["minute", "-violation_count"],
    "worst_cells": ["-sla_breaches", "avg_rsrp_dbm", "cell_id"],
    "anomaly_trend": ["minute", "slice_type"],
    "anomaly_proxy_breakdown": ["-count"],
    "latest_events": ["-event_timestamp", "-event_id"],
    "latest_events_by_text": ["-event_timestamp", "-event_id"],
    "bronze_anomaly_breakdown": ["slice_type", "is_anomaly"],
    "ingest_audit": ["minute"],
    "kpi_band_counts": ["slice_type", "kpi", "band"],
    "alert_counts": ["cell_id"],
    "range_expectations": ["rule"],
    "parse_failures": ["column_name"],
    "payload_failures": ["failure"],
}
ORDERS |= {f"rollup_{name}": ORDERS[name] for name in ("event_rate_recent", "sla_scorecard", "cell_signal_quality", "anomaly_rate_recent")}
ORDERS |= {f"rollup_{name}": ORDERS[name] for name in ("rb_utilisation", "breach_leaderboard")}


def _compared(one: object, other: object) -> int:
    if one is None or other is None:
        return (one is not None) - (other is not None)
    return (one > other) - (one < other)


def out_of_order(name: str, columns: list[str], rows: list) -> str:
    """Empty when the rows follow the order of the report or it has none, else the first two that do not."""
    if name not in ORDERS:
        return ""
    keys = [(columns.index(key.lstrip("-")), -1 if key.startswith("-") else 1) for key in ORDERS[name]]

    if "signal_quality_class" in columns:  # from the best class to the worst
        place = columns.index("signal_quality_class")
        rows = [(*r[:place], CLASSES.index(r[place]), *r[place + 1 :]) for r in rows]

    def compare(one: tuple, other: tuple) -> int:
        return next((way * c for i, way in keys if (c := _compared(one[i], other[i]))), 0)

    key = cmp_to_key(compare)
    for one, other in zip(rows, rows[1:]):
        if key(one) > key(other):
            return f"out of order: {one} before {other}"
    return ""
