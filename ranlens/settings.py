"""Fixed values of the telemetry model, stated once and used everywhere."""

from __future__ import annotations

from typing import NamedTuple

# ---------------------------------------------------------------------------
# Slices and their service-level limits. A throughput limit is a
# minimum, every other limit is a maximum; a value equal to the limit is fine.
# ---------------------------------------------------------------------------
SLICE_IDS = {"eMBB": "S1", "URLLC": "S2", "mMTC": "S3"}

SLA_LIMITS = {
    "eMBB": {
        "dl_throughput_mbps": 100.0,
        "ul_throughput_mbps": 20.0,
        "latency_ms": 10.0,
        "packet_loss_pct": 0.1,
        "jitter_ms": 5.0,
    },
    "URLLC": {
        "dl_throughput_mbps": 10.0,
        "ul_throughput_mbps": 5.0,
        "latency_ms": 1.0,
        "packet_loss_pct": 0.001,
        "jitter_ms": 0.5,
    },
    "mMTC": {
        "dl_throughput_mbps": 1.0,
        "ul_throughput_mbps": 0.5,
        "latency_ms": 100.0,
        "packet_loss_pct": 1.0,
        "jitter_ms": 50.0,
    },
}


class SlaRule(NamedTuple):
    """How one KPI is judged: ``bound`` says which side of the limit is bad."""

    kpi: str
    bound: str
    violation_type: str
    severity: str


SLA_RULES = (
    SlaRule("dl_throughput_mbps", "min", "LOW_DL_THROUGHPUT", "WARNING"),
    SlaRule("ul_throughput_mbps", "min", "LOW_UL_THROUGHPUT", "WARNING"),
    SlaRule("latency_ms", "max", "HIGH_LATENCY", "CRITICAL"),
    SlaRule("packet_loss_pct", "max", "HIGH_PACKET_LOSS", "CRITICAL"),
    SlaRule("jitter_ms", "max", "HIGH_JITTER", "WARNING"),
)

# Lower edges (inclusive) of the signal classes, in dBm.
SIGNAL_CLASS_FLOORS = (("Excellent", -80.0), ("Good", -90.0), ("Fair", -100.0))
SIGNAL_CLASSES = ("Excellent", "Good", "Fair", "Poor")

# Lower edges (inclusive) of the average resource-block load.
LOAD_FLOORS = (("Congested", 85), ("High Load", 60), ("Normal", 30))

# Alert limits. "below" and "above" are strict.
ALERTS = {
    "poor_rsrp": ("rsrp_dbm", "below", -110.0),
    "poor_rsrq": ("rsrq_db", "below", -15.0),
    "poor_sinr": ("sinr_db", "below", 0.0),
    "high_bler": ("bler_pct", "above", 10.0),
    "rb_congestion": ("rb_utilization_pct", "above", 85.0),
}


class Band(NamedTuple):
    """Good and Fair edges of one KPI; ``better`` is the good direction."""

    kpi: str
    better: str
    good: float
    fair: float
    only_slice: str | None = None


# KPI bands. Both edges belong to the better band.
KPI_BANDS = (
    Band("rsrp_dbm", "high", -80.0, -100.0),
    Band("rsrq_db", "high", -10.0, -15.0),
    Band("sinr_db", "high", 10.0, 0.0),
    Band("cqi", "high", 10.0, 5.0),
    Band("dl_throughput_mbps", "high", 200.0, 50.0, "eMBB"),
    Band("latency_ms", "low", 0.5, 1.0, "URLLC"),
    Band("bler_pct", "low", 2.0, 10.0),
    Band("rb_utilization_pct", "low", 60.0, 85.0),
)

# Streaming cadence.
WINDOW_DURATION = "1 minute"
WINDOW_SLIDE = "30 seconds"
WATERMARK_DELAY = "30 seconds"
TRIGGER_INTERVAL = "10 seconds"
