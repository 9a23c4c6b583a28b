"""Aggregate expressions shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def average(name: str, digits: int) -> Column:
    return F.round(F.avg(name), digits)


def flag_sum(flag: str | Column) -> Column:
    """How often a flag is set; NULL when every flag of the group is NULL."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.sum(flag.cast("long"))


def flag_share_pct(flag: str | Column, digits: int = 2) -> Column:
    """Percentage of rows with the flag set; rows with a NULL flag count as rows."""
    return F.round(flag_sum(flag) * F.lit(100.0) / F.count("*"), digits)


def flag_mean_pct(flag: str, digits: int = 2) -> Column:
    """Percentage of set flags among the flags that are not NULL."""
    return F.round(F.avg(F.col(flag).cast("int")) * 100, digits)


def compliance_pct(breaches: Column, events: Column) -> Column:
    """Percentage of events without a breach; NULL when there are no events."""
    return F.round((F.lit(1.0) - breaches / F.nullif(events, F.lit(0))) * 100.0, 2)
