"""Every query by name, over an event log in ``<dir>/events.parquet``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ranlens.functions.sla import limits_table
from ranlens.functions.sql import register_functions
from ranlens.operators.silver import bronze_to_silver
from ranlens.operators.violations import sla_violations, with_table_breach
from ranlens.operators.windows import cell_kpis, slice_kpis
from ranlens.plans import dashboard, network, quality, rollup_reports
from ranlens.plans.layers import Layers
from ranlens.session import shared_folder, use_settings
from checks.event_log import bronze_from_log
from ranlens.sources.payloads import failures_of, judged_payload, parse_payload
from ranlens.streaming.pipelines import Medallion, start_append

Query = Callable[[SparkSession, str], DataFrame]


def layers_from_log(spark: SparkSession, folder: str) -> Layers:
    """The layers derived from the whole log; a violation is detected when its event happens."""
    use_settings(spark)
    log = spark.read.parquet(f"{folder}/events.parquet")
    return Layers.from_bronze(bronze_from_log(log), detected_at=F.col("event_timestamp"))


def newest_event(layers: Layers) -> Column:
    """The newest event time as a scalar subquery, evaluated once per query."""
    return layers.silver.agg(F.max("event_timestamp")).scalar()


def comparable(df: DataFrame) -> DataFrame:
    """Instants as zone-free timestamps, as the SQL side has them."""
    instants = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in instants}) if instants else df


def gold_comparable(df: DataFrame) -> DataFrame:
    """Averages at nine digits, as the order of additions differs between runs.

    The inner rounding removes that noise, so that a tie is the same tie everywhere.
    """
    return df.withColumns(
        {name: F.round(F.round(name, 12), 9) for name in df.columns if name.startswith("avg_")}
    )


def without_stamps(df: DataFrame) -> DataFrame:
    """Without the columns that hold the time of the run."""
    return df.drop("ingested_at", "detected_at")


def _over_layers(report: Callable[[Layers], DataFrame]) -> Query:
    return lambda spark, folder: comparable(report(layers_from_log(spark, folder)))


def _looking_back(report: Callable[..., DataFrame]) -> Query:
    return _over_layers(lambda layers: report(layers, newest_event(layers)))


def _by_table(spark: SparkSession, folder: str) -> DataFrame:
    events = layers_from_log(spark, folder).silver.drop("sla_breach")
    return with_table_breach(events, limits_table(spark)).select("event_id", "slice_type", "sla_breach")


def _violations_by_table(spark: SparkSession, folder: str) -> DataFrame:
    silver = layers_from_log(spark, folder).silver
    return comparable(without_stamps(sla_violations(silver, F.col("event_timestamp"), limits_table(spark))))


def _by_sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    register_functions(spark)
    return spark.sql(
        """SELECT event_id, signal_quality(rsrp_dbm) AS signal_quality_class,
        breaches_sla(slice_type, dl_throughput_mbps, ul_throughput_mbps, latency_ms, packet_loss_pct, jitter_ms)
          AS sla_breach FROM {silver}""",
        silver=layers_from_log(spark, folder).silver,
    )


def _by_payload(spark: SparkSession, folder: str) -> DataFrame:
    bronze = layers_from_log(spark, folder).bronze
    messages = bronze.select(F.to_json(F.struct("*")).cast("binary").alias("value"))
    return comparable(without_stamps(bronze_to_silver(parse_payload(messages))))


def messages_from_log(bronze: DataFrame) -> DataFrame:
    """The events as JSON messages, some of which are cut off, of another kind, blank or missing, as in a real feed."""
    e = F.col("event_id").cast("bigint")
    whole = F.to_json(F.struct(*bronze.columns))
    value = (
        F.when(e % 101 == 0, F.expr("left(whole, length(whole) - 3)"))
        .when(e % 103 == 0, F.concat(F.lit("["), "whole", F.lit("]")))
        .when(e % 107 == 0, " ")
        .when(e % 113 == 0, "17")
        .when(e % 109 != 0, F.col("whole"))
    )
    return bronze.withColumn("whole", whole).select(value.cast("binary").alias("value"))


def _payload_failures(spark: SparkSession, folder: str) -> DataFrame:
    judged = judged_payload(messages_from_log(layers_from_log(spark, folder).bronze))
    return quality.payload_failures(failures_of(judged))


def _streamed_payload_failures(spark: SparkSession, folder: str) -> DataFrame:
    """The quarantine table of a stream that fills it and bronze."""
    use_settings(spark)
    target = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    log = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    tables = Medallion(spark, f"{target}/tables", f"{target}/checkpoints")
    tables.start_bronze(judged_payload(messages_from_log(bronze_from_log(log))), trigger=None).awaitTermination()
    kept = stored_result(quality.payload_failures(tables.read("quarantine")))
    removed(spark, target)
    return kept


def removed(spark: SparkSession, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _streamed(derive: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame] = lambda df: df) -> Query:
    """Run the log through a stream into a table of the shared folder, and give back what the table holds.

    The log may be one file or a folder of files. The rows are kept in a small table of results, and the stream's table and
    checkpoint are removed.
    """

    def run(spark: SparkSession, folder: str) -> DataFrame:
        use_settings(spark)
        target = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
        schema = spark.read.parquet(f"{folder}/events.parquet").schema
        # A pattern may stand for a file, where a streaming source takes a plain path for a folder.
        log = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
        result = derive(bronze_to_silver(bronze_from_log(log)))
        query = start_append(result, f"{target}/table", uuid.uuid4().hex, f"{target}/checkpoint", trigger=None)
        query.awaitTermination()
        stored = spark.read.schema(result.schema).parquet(f"{target}/table").select(*result.columns)
        kept = stored_result(comparable(without_stamps(finish(stored))))
        removed(spark, target)
        return kept

    return run


def stored_result(df: DataFrame) -> DataFrame:
    """The rows, written once as a table in the folder all executors share and read from there."""
    context = df.sparkSession.sparkContext
    path = f"{shared_folder(df.sparkSession)}/results/{context.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def catalog() -> dict[str, Query]:
    """Query name to callable of (session, folder)."""
    named: dict[str, Query] = {
        "silver_events": _over_layers(lambda layers: without_stamps(layers.silver)),
        "sla_breach_flag": _over_layers(lambda layers: layers.silver.select("event_id", "slice_type", "sla_breach")),
        "cell_kpis": _over_layers(lambda layers: gold_comparable(layers.cell_kpis)),
        "slice_kpis": _over_layers(lambda layers: gold_comparable(layers.slice_kpis)),
        "sla_violations": _over_layers(lambda layers: without_stamps(layers.violations)),
        "sla_breach_by_table": _by_table,
        "sla_violations_by_table": _violations_by_table,
        "sql_function_flags": _by_sql_functions,
        "json_payload_silver": _by_payload,
        "payload_failures": _payload_failures,
        "stream_payload_failures": _streamed_payload_failures,
        "stream_silver_events": _streamed(lambda silver: silver),
        "stream_cell_kpis": _streamed(cell_kpis, gold_comparable),
        "stream_slice_kpis": _streamed(slice_kpis, gold_comparable),
        "stream_sla_violations": _streamed(sla_violations),
        "total_events": _over_layers(dashboard.total_events),
    }
    for report in (
        network.network_overview,
        network.events_per_minute,
        network.signal_class_distribution,
        network.signal_percentiles,
        network.throughput_by_slice,
        network.throughput_trend,
        network.latency_by_slice,
        network.latency_trend_top,
        network.latest_cell_kpis,
        network.sla_compliance,
        network.sla_compliance_trend,
        network.violation_breakdown,
        network.violations_per_minute,
        network.worst_cells,
        network.anomaly_trend,
        network.anomaly_proxy_breakdown,
        quality.latest_events,
        quality.latest_events_by_text,
        quality.bronze_anomaly_breakdown,
        quality.ingest_audit,
        quality.kpi_band_counts,
        quality.alert_counts,
        quality.range_expectations,
        quality.coverage_summary,
        quality.parse_failures,
    ):
        named[report.__name__] = _over_layers(report)
    for report in (
        dashboard.event_rate_recent,
        dashboard.sla_scorecard,
        dashboard.throughput_recent,
        dashboard.latency_recent,
        dashboard.cell_signal_quality,
        dashboard.top_violations,
        dashboard.anomaly_rate_recent,
        dashboard.rb_utilisation,
        dashboard.breach_leaderboard,
        dashboard.urllc_latency_gauge,
    ):
        named[report.__name__] = _looking_back(report)
    for report in (
        rollup_reports.event_rate_recent,
        rollup_reports.sla_scorecard,
        rollup_reports.cell_signal_quality,
        rollup_reports.anomaly_rate_recent,
        rollup_reports.rb_utilisation,
        rollup_reports.breach_leaderboard,
    ):
        named[f"rollup_{report.__name__}"] = _looking_back(report)
    return named
