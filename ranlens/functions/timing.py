"""Calendar minutes, partition dates and look-back filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


# Time columns and the day column that a table layout may have for them.
DAY_COLUMNS = {"event_timestamp": "event_date", "window_end": "window_date", "detected_at": "detected_date"}


def minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts)


def utc_date(ts: Column | str) -> Column:
    """UTC calendar day of an instant, whatever the session time zone is."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def recent(df: DataFrame, ts: str, interval: str, as_of: Column | datetime | None = None) -> DataFrame:
    """Rows with ``ts >= as_of - interval``; inclusive, with no upper bound.

    ``as_of`` defaults to the current time, which Spark folds to a literal and
    pushes to the scan. A table laid out by the day of ``ts`` also gets the matching
    day filter, so older directories are not read.
    """
    if as_of is None:
        as_of = F.current_timestamp()
    elif isinstance(as_of, datetime):
        as_of = F.lit(as_of)
    oldest = as_of - F.expr(f"INTERVAL {interval}")
    kept = df.filter(F.col(ts) >= oldest)
    day = DAY_COLUMNS.get(ts)
    if day in df.columns:
        kept = kept.filter(F.col(day) >= utc_date(oldest))
    return kept
