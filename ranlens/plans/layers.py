"""The tables that the named queries read."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ranlens.operators.rollups import minute_rollup
from ranlens.operators.silver import bronze_to_silver
from ranlens.operators.violations import sla_violations
from ranlens.operators.windows import cell_kpis, slice_kpis
from ranlens.settings import WATERMARK_DELAY
from ranlens.sources.tables import TABLES, read_table, register_views
from ranlens.sources.writes import exists
from ranlens.streaming.late import KEYS, current, revisions_spec


def closed_minutes(silver: DataFrame) -> DataFrame:
    """The roll-up as a stream has it: the minutes that the newest event has closed."""
    newest = silver.agg(F.max("event_timestamp")).scalar()
    ends = F.col("minute") + F.expr("INTERVAL 1 MINUTE")
    return minute_rollup(silver).filter(ends <= newest - F.expr(f"INTERVAL {WATERMARK_DELAY}"))


class Layers:
    """Bronze, silver and gold DataFrames, each built when first asked for."""

    def __init__(self, build: dict[str, Callable[[], DataFrame]]):
        self._build = build

    @classmethod
    def from_bronze(cls, bronze: DataFrame, detected_at: Column | datetime | None = None) -> Layers:
        """Derive every layer from a bronze DataFrame."""
        layers = cls({})
        layers._build = {
            "bronze": lambda: bronze,
            "silver": lambda: bronze_to_silver(bronze),
            "cell_kpis": lambda: cell_kpis(layers.silver),
            "slice_kpis": lambda: slice_kpis(layers.silver),
            "minute_rollup": lambda: closed_minutes(layers.silver),
            "sla_violations": lambda: sla_violations(layers.silver, detected_at),
        }
        return layers

    @classmethod
    def from_tables(cls, spark: SparkSession, base: str, fmt: str = "parquet") -> Layers:
        """Read the layers from the tables under ``base``; windows made anew for late events stand in place of their rows."""

        def read(name: str) -> DataFrame:
            stored, revised = read_table(spark, f"{base}/{name}", TABLES[name].schema, fmt), f"{base}/{name}_revisions"
            if name not in KEYS or not exists(spark, revised):
                return stored
            gold, schema = stored.select(*TABLES[name].schema.names), revisions_spec(TABLES[name]).schema
            return current(gold, read_table(spark, revised, schema, fmt).select(*schema.names), KEYS[name])

        return cls({name: lambda name=name: read(name) for name in TABLES})

    @cached_property
    def bronze(self) -> DataFrame:
        return self._build["bronze"]()

    @cached_property
    def quarantine(self) -> DataFrame:
        return self._build["quarantine"]()

    @cached_property
    def silver(self) -> DataFrame:
        return self._build["silver"]()

    @cached_property
    def cell_kpis(self) -> DataFrame:
        return self._build["cell_kpis"]()

    @cached_property
    def slice_kpis(self) -> DataFrame:
        return self._build["slice_kpis"]()

    @cached_property
    def minute_rollup(self) -> DataFrame:
        return self._build["minute_rollup"]()

    @cached_property
    def violations(self) -> DataFrame:
        return self._build["sla_violations"]()

    def register(self, spark: SparkSession) -> None:
        """Publish the layers under the view names that SQL users query."""
        quarantine = {"quarantined_payloads": self.quarantine} if "quarantine" in self._build else {}
        register_views(
            spark,
            quarantine
            | {
                "bronze_events": self.bronze,
                "silver_events": self.silver,
                "cell_kpis": self.cell_kpis,
                "slice_kpis": self.slice_kpis,
                "sla_violations": self.violations,
            },
        )
