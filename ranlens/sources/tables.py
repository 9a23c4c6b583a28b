"""Batch and streaming tables: scan, append, create, register.

Jobs and streams may write one table. Its last directory level names the write: a name of its own for each
job, and the stream and its batch for streams, so a batch that runs again replaces what it wrote
before and nothing else. No log of one writer decides what readers see. Completed writes leave a mark
(see ``writes``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from ranlens import schemas
from ranlens.functions.timing import utc_date
from ranlens.sources.writes import WRITE, job_name, mark_of


@dataclass(frozen=True)
class TableSpec:
    """Schema, layout and description of a stored table.

    ``partition_by`` may name a day column that is not in the schema; it is derived
    from ``day_of`` on write. ``directories`` adds the level that names the write.
    """

    schema: T.StructType
    partition_by: tuple[str, ...] = ()
    day_of: str | None = None
    comment: str = ""

    @property
    def directories(self) -> tuple[str, ...]:
        return (*self.partition_by, WRITE)

    @property
    def stored_schema(self) -> T.StructType:
        days = [T.StructField(c, T.DateType()) for c in self.partition_by if c not in self.schema.names]
        return T.StructType([*self.schema.fields, *days, T.StructField(WRITE, T.StringType())])

    @property
    def scan_schema(self) -> T.StructType:
        """The stored columns as a scan orders them, directories last: known before there is any directory."""
        stored = {f.name: f for f in self.stored_schema}
        data = [f for name, f in stored.items() if name not in self.directories]
        return T.StructType([*data, *(stored[name] for name in self.directories)])


# Tables that grow with the event rate get a day directory, so look-backs list
# only recent days. Cells are too many for one directory each (see TABLES_BY_KEY).
TABLES = {
    "bronze": TableSpec(schemas.BRONZE, comment="Raw device events as text"),
    "quarantine": TableSpec(schemas.QUARANTINE, ("received_date",), "received_at", "Payloads that hold no event"),
    "silver": TableSpec(
        schemas.SILVER, ("event_date", "slice_type"), "event_timestamp", "Typed and enriched device events"
    ),
    "cell_kpis": TableSpec(schemas.CELL_KPIS, ("window_date",), "window_end", "Windowed KPIs per cell"),
    "slice_kpis": TableSpec(schemas.SLICE_KPIS, ("window_date",), "window_end", "Windowed KPIs per slice"),
    "minute_rollup": TableSpec(schemas.MINUTE_ROLLUP, ("window_date",), "minute", "Sums, counts and sketches per minute and cell"),
    "sla_violations": TableSpec(
        schemas.SLA_VIOLATIONS, ("detected_date",), "detected_at", "One row per breached KPI"
    ),
}

# The layout by business key only, for small networks and tools that expect it.
TABLES_BY_KEY = {
    "bronze": TABLES["bronze"],
    "quarantine": TABLES["quarantine"],
    "silver": TableSpec(schemas.SILVER, ("slice_type",), comment=TABLES["silver"].comment),
    "cell_kpis": TableSpec(schemas.CELL_KPIS, ("cell_id",), comment=TABLES["cell_kpis"].comment),
    "slice_kpis": TableSpec(schemas.SLICE_KPIS, ("slice_type",), comment=TABLES["slice_kpis"].comment),
    "minute_rollup": TABLES["minute_rollup"],
    "sla_violations": TableSpec(schemas.SLA_VIOLATIONS, comment=TABLES["sla_violations"].comment),
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Batch scan. With a schema nothing is inferred and its columns come first."""
    reader = spark.read.format(fmt)
    if schema is None:
        return reader.load(path)
    table = reader.schema(schema).load(path)
    return table.select(*schema.names, *(c for c in table.columns if c not in schema.names))


def stream_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Streaming scan of an append-only table; columns in schema order."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(*schema.names)


def with_layout(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Add the day column that the layout needs and the data does not have."""
    for name in spec.partition_by:
        if name not in df.columns and spec.day_of:
            df = df.withColumn(name, utc_date(spec.day_of))
    return df


def _writer(df: DataFrame, spec: TableSpec | None, fmt: str, write: str) -> DataFrameWriter:
    """Rows laid out for the table and marked with the write.

    A rebalance gathers each directory into a few files of the advisory size, and adaptive
    execution splits a hot directory over several tasks.
    """
    partition_by: tuple[str, ...] = ()
    if spec:
        df, partition_by = with_layout(df, spec), spec.partition_by
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    return df.withColumn(WRITE, F.lit(write)).write.format(fmt).partitionBy(*partition_by, WRITE)


def append(df: DataFrame, path: str, spec: TableSpec | None = None, fmt: str = "parquet", name: str | None = None) -> None:
    """Batch append; the new directories are made known to the registered table ``name``, if one is given."""
    write = job_name()
    _writer(df, spec, fmt, write).mode("append").save(path)
    mark, files = mark_of(df.sparkSession, path, write)
    files.create(mark, True).close()
    if name:
        df.sparkSession.catalog.recoverPartitions(name)


def write_batch(df: DataFrame, path: str, write: str, spec: TableSpec | None = None, fmt: str = "parquet") -> None:
    """Write a stream's batch, or a job that may run again, once: its own directories are replaced, and a batch that was completed is left as it is.

    The mark of a completed batch keeps files that other streams have read from being replaced by their equals.
    """
    mark, files = mark_of(df.sparkSession, path, write)
    if files.exists(mark):
        return
    _writer(df, spec, fmt, write).mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    files.create(mark, True).close()


def ensure_table(
    spark: SparkSession, path: str, spec: TableSpec, name: str | None = None, fmt: str = "parquet"
) -> None:
    """Create the empty table at ``path`` unless it exists, and register it as ``name``.

    The name is explicit: two layers may share the last part of their path.
    """
    empty = spark.createDataFrame([], spec.stored_schema)
    empty.write.format(fmt).mode("ignore").partitionBy(*spec.directories).save(path)
    if name:
        register_table(spark, name, path, spec, fmt)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_table(spark: SparkSession, name: str, path: str, spec: TableSpec, fmt: str = "parquet") -> None:
    """Register an external table with an explicit schema, unless the name exists, and the directories it has.

    A catalog that tracks directories learns of later ones by ``append(..., name=...)`` or
    ``spark.catalog.recoverPartitions(name)``; ``read_table`` always lists them.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.stored_schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt} PARTITIONED BY ({', '.join(spec.directories)}) "
        f"LOCATION {_quoted(path)} COMMENT {_quoted(spec.comment)}"
    )
    spark.catalog.recoverPartitions(name)


def register_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Session-scoped SQL views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
