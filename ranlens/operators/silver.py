"""Bronze to silver: typing, key filter, classification, breach flag."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ranlens.functions.signal import signal_quality_class
from ranlens.functions.sla import Limits, sla_breach
from ranlens.schemas import EVENT_COLUMNS, SILVER
from ranlens.settings import SLA_LIMITS

REQUIRED_KEYS = ("event_id", "event_timestamp", "cell_id", "ue_id")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project on a schema: drop unknown columns, add missing nullable ones as NULL.

    A missing column that may not be NULL is an error, not a silent NULL. A text that
    does not parse as its target becomes NULL.
    """
    absent = [f.name for f in schema if f.name not in df.columns and not f.nullable]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    return df.select(
        *(
            F.col(f.name).try_cast(f.dataType).alias(f.name)
            if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        )
    )


def typed(name: str, kind: T.DataType) -> Column:
    """A text column in its silver type; text that does not parse becomes NULL.

    A whole-number column takes whole numbers only: ``'10.7'`` is NULL.
    """
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(F.col(name))
    return F.col(name).try_cast(kind)


def cast_bronze(bronze: DataFrame) -> DataFrame:
    """All event columns in their silver types, in one projection; no row is lost."""
    return bronze.select(*(typed(name, kind).alias(name) for name, kind, _ in EVENT_COLUMNS))


def drop_incomplete(events: DataFrame) -> DataFrame:
    """Rows whose required keys are all present (the base station is not one of them)."""
    return events.filter(reduce(and_, [F.col(key).isNotNull() for key in REQUIRED_KEYS]))


def bronze_to_silver(
    bronze: DataFrame, now: Column | datetime | None = None, limits: Limits = SLA_LIMITS
) -> DataFrame:
    """The silver table of a batch or streaming bronze table; one map-only stage.

    ``limits`` by slice may have other slices and values than the fixed ones.
    """
    stamp = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    events = drop_incomplete(cast_bronze(bronze))
    return events.select(
        "*",
        signal_quality_class().alias("signal_quality_class"),
        sla_breach(limits).alias("sla_breach"),
        stamp.alias("ingested_at"),
    ).select(*SILVER.names)
