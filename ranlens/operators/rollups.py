"""Additive minutes: sums, counts and sketches per minute, slice and cell, from which reports over any period are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ranlens.functions.signal import signal_score
from ranlens.schemas import MINUTE_ROLLUP
from ranlens.settings import WATERMARK_DELAY

KEYS = ("slice_type", "cell_id", "gnb_id")
#: What is averaged: its sum and the number of its values are kept.
AVERAGED = ("rsrp_dbm", "sinr_db", "cqi", "latency_ms", "rb_utilization_pct")
FLAGS = ("sla_breach", "is_anomaly")
#: Base-two logarithm of the registers of a sketch: its relative error is about 0.8 % (one standard deviation).
SKETCH_BITS = 14


def _measures() -> list[Column]:
    score = signal_score()
    measures = [F.count("*").alias("events"), F.sum(score).cast("double").alias("score_sum"), F.count(score).alias("score_count")]
    for name in AVERAGED:
        measures += [F.sum(name).cast("double").alias(f"{name}_sum"), F.count(name).alias(f"{name}_count")]
    for name in FLAGS:
        measures += [F.count_if(name).alias(f"{name}_set"), F.count(name).alias(f"{name}_count")]
    measures += [F.min("event_timestamp").alias("earliest_event"), F.max("event_timestamp").alias("latest_event")]
    return [*measures, F.hll_sketch_agg("ue_id", SKETCH_BITS).alias("ues")]


def minute_rollup(silver: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    """One row per minute, slice, cell and base station; on a stream a minute is emitted when it is closed.

    A hot cell sends one partial row per task and minute, and a sketch has a bounded size.
    """
    minutes = silver.withWatermark("event_timestamp", delay).groupBy(F.window("event_timestamp", "1 minute").alias("_w"), *KEYS)
    rows = minutes.agg(*_measures()).withColumn("minute", F.col("_w.start"))
    return rows.select(*MINUTE_ROLLUP.names)


def combined(rollup: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The rows of a roll-up added up by other keys."""
    kept = {"minute", *KEYS, "ues", "earliest_event", "latest_event"}
    sums = [F.sum(name).alias(name) for name in MINUTE_ROLLUP.names if name not in kept]
    times = [F.min("earliest_event").alias("earliest_event"), F.max("latest_event").alias("latest_event")]
    return rollup.groupBy(*keys).agg(*sums, *times, F.hll_union_agg("ues").alias("ues"))


def mean(name: str) -> Column:
    """The average of a measure of a roll-up at twelve digits, as the order of additions differs between runs; NULL if it had no value."""
    return F.round(F.col(f"{name}_sum") / F.nullif(F.col(f"{name}_count"), F.lit(0)), 12)


def times_set(flag: str) -> Column:
    """How often a flag was set; NULL if it always was NULL."""
    return F.when(F.col(f"{flag}_count") > 0, F.col(f"{flag}_set"))


def distinct_ues() -> Column:
    """The estimated number of distinct devices of a roll-up row."""
    return F.hll_sketch_estimate("ues")
