"""Good / Fair / Poor bands and alert flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ranlens.functions.choose import choose
from ranlens.settings import ALERTS, Band


def kpi_band(band: Band) -> Column:
    """Band of a KPI; NULL for a missing value, NaN, or a slice it does not apply to."""
    value = F.col(band.kpi).cast("double")
    edges = [("Good", band.good), ("Fair", band.fair)]
    if band.better == "high":
        label = choose([(value >= edge, name) for name, edge in edges], "Poor")
    else:
        label = choose([(value <= edge, name) for name, edge in edges], "Poor")
    applies = value.isNotNull() & ~F.isnan(value)
    if band.only_slice:
        applies = applies & (F.col("slice_type") == band.only_slice)
    return F.when(applies, label)


def alert_flag(name: str) -> Column:
    """Whether an event is strictly beyond the named alert limit; NULL without a value, never for NaN."""
    kpi, side, limit = ALERTS[name]
    value = F.col(kpi)
    return value < limit if side == "below" else (value > limit) & ~F.isnan(value)
