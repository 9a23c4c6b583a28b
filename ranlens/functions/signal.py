"""Signal classes, scores, load states and the anomaly heuristic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ranlens.functions.choose import choose
from ranlens.settings import LOAD_FLOORS, SIGNAL_CLASS_FLOORS, SIGNAL_CLASSES


def signal_quality_class(rsrp: Column | str = "rsrp_dbm") -> Column:
    """Class of a received power; NULL is ``Unknown`` and NaN is ``Poor``.

    Spark sorts NaN above every number, so NaN is tested before the floors.
    """
    rsrp = F.col(rsrp) if isinstance(rsrp, str) else rsrp
    missing = [(rsrp.isNull(), "Unknown"), (F.isnan(rsrp), "Poor")]
    return choose(missing + [(rsrp >= floor, name) for name, floor in SIGNAL_CLASS_FLOORS], "Poor")


def signal_class_order(label: Column | str = "signal_quality_class") -> Column:
    """1 for the best class up to 4, and 5 for anything else (a sort key)."""
    label = F.col(label) if isinstance(label, str) else label
    return choose(
        [(label == name, position) for position, name in enumerate(SIGNAL_CLASSES, start=1)],
        len(SIGNAL_CLASSES) + 1,
    )


def signal_score(label: Column | str = "signal_quality_class") -> Column:
    """4 for the best class down to 1, and 0 for anything else."""
    return F.lit(len(SIGNAL_CLASSES) + 1) - signal_class_order(label)


def load_status(average_rb: Column) -> Column:
    """Load state of an average resource-block use; NULL is ``Low Load``."""
    return choose([(average_rb >= floor, name) for name, floor in LOAD_FLOORS], "Low Load")


def anomaly_proxy_type() -> Column:
    """Likely cause of an anomalous event; the first match wins."""
    return choose(
        [
            ((F.col("sinr_db") < 0) & (F.col("rsrp_dbm") < -110), "Interference"),
            (F.col("latency_ms") > 100, "Handover / Backhaul"),
            (F.col("rb_utilization_pct") > 85, "Cell Congestion"),
        ],
        "Other",
    )
