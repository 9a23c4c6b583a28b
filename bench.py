"""Time the jobs and reports on stored tables; prints one JSON line.

Environment: BENCH_SF_DIR (folder with events.parquet), BENCH_CPUS, BENCH_RUNS, BENCH_BASE (where the tables go, a
folder all executors share), BENCH_COPIES (hourly copies of the silver rows with one cell in every third row; 0 for none).
The set-up maps the event log to a bronze table and derives the other tables from
it. Each job or report then reads its tables from disk: one run to warm up, then
BENCH_RUNS runs into a sink that computes every row and column; the median counts.
A stream is timed from start to end over everything that its table holds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from ranlens.operators.silver import bronze_to_silver  # noqa: E402
from ranlens.operators.violations import sla_violations  # noqa: E402
from ranlens.operators.windows import cell_kpis, slice_kpis  # noqa: E402
from ranlens.plans import dashboard, network, quality, rollup_reports  # noqa: E402
from ranlens.plans.layers import Layers, closed_minutes  # noqa: E402
from ranlens.session import build_session  # noqa: E402
from checks.event_log import bronze_from_log  # noqa: E402
from ranlens.sources.tables import TABLES, append  # noqa: E402
from ranlens.streaming.pipelines import GOLD, Medallion  # noqa: E402


NETWORK = (
    network.worst_cells, network.latency_by_slice, network.network_overview, network.signal_percentiles,
    network.throughput_by_slice, network.signal_class_distribution, network.latest_cell_kpis,
    network.violation_breakdown, network.sla_compliance, network.anomaly_trend, network.anomaly_proxy_breakdown,
    network.events_per_minute, network.throughput_trend, network.latency_trend_top, network.sla_compliance_trend,
    network.violations_per_minute, quality.kpi_band_counts, quality.ingest_audit, quality.range_expectations,
    quality.parse_failures, quality.latest_events, quality.bronze_anomaly_breakdown, quality.alert_counts,
    quality.coverage_summary, dashboard.total_events,
)
LOOK_BACKS = (
    dashboard.sla_scorecard, dashboard.latency_recent, dashboard.urllc_latency_gauge, dashboard.event_rate_recent,
    dashboard.throughput_recent, dashboard.cell_signal_quality, dashboard.top_violations,
    dashboard.anomaly_rate_recent, dashboard.rb_utilisation, dashboard.breach_leaderboard,
)
ROLLED_UP = (rollup_reports.sla_scorecard, rollup_reports.event_rate_recent, rollup_reports.breach_leaderboard)


def jobs(layers: Layers) -> dict[str, Callable[[], DataFrame]]:
    newest = layers.silver.agg(F.max("event_timestamp")).first()[0]
    reports = {report.__name__: lambda report=report: report(layers) for report in NETWORK}
    recent = {report.__name__: lambda report=report: report(layers, newest) for report in LOOK_BACKS}
    recent |= {f"rollup_{report.__name__}": lambda report=report: report(layers, newest) for report in ROLLED_UP}
    return {
        "silver_events": lambda: bronze_to_silver(layers.bronze),
        "cell_kpis": lambda: cell_kpis(layers.silver),
        "slice_kpis": lambda: slice_kpis(layers.silver),
        "sla_violations": lambda: sla_violations(layers.silver),
    } | reports | recent


def skewed(silver: DataFrame, copies: int) -> DataFrame:
    """Hourly copies of the rows with other devices, latencies of full precision, and a third of all rows in one cell."""
    n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    rows = silver.withColumn("copy", n)
    return rows.withColumns(
        {
            "event_timestamp": F.col("event_timestamp") + F.make_interval(hours=F.col("copy")),
            "ue_id": F.concat("ue_id", F.lit("-"), "copy"),
            "cell_id": F.when(F.xxhash64("event_id", "copy") % 3 == 0, "CELL-HOT").otherwise(F.col("cell_id")),
            "latency_ms": F.col("latency_ms") + F.rand(1) / 1000,
        }
    ).drop("copy")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    started = time.perf_counter()
    base = tempfile.mkdtemp(prefix="bench-", dir=os.environ.get("BENCH_BASE"))
    source = Medallion(spark, f"{base}/tables", f"{base}/checkpoints")
    log = spark.read.parquet(f"{folder}/events.parquet").repartition(int(cpus))
    append(bronze_from_log(log), source.path("bronze"), TABLES["bronze"])
    layers = Layers.from_tables(spark, source.base)
    append(bronze_to_silver(layers.bronze), source.path("silver"), TABLES["silver"])
    for table, derive in GOLD.items():
        append(derive(layers.silver), source.path(table), TABLES[table])
    append(closed_minutes(layers.silver), source.path("minute_rollup"), TABLES["minute_rollup"])
    setup = time.perf_counter() - started

    layers = Layers.from_tables(spark, source.base)
    events = layers.bronze.count()
    seconds = {}
    for name, job in jobs(layers).items():
        samples = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(samples[1:]), 3)

    for table in ("silver", *GOLD):
        samples = []
        for _ in range(max(1, runs - 1)):
            stream = source.stream("bronze" if table == "silver" else "silver")
            derive = bronze_to_silver if table == "silver" else GOLD[table]
            target = Medallion(spark, tempfile.mkdtemp(prefix="out-", dir=base), tempfile.mkdtemp(prefix="ck-", dir=base))
            started = time.perf_counter()
            target.start(table, derive(stream), trigger=None).awaitTermination()
            samples.append(time.perf_counter() - started)
        seconds[f"stream_{table}"] = round(statistics.median(samples), 3)

    copies, at_scale = int(os.environ.get("BENCH_COPIES", "5")), {}
    if copies:
        append(skewed(layers.silver, copies), f"{base}/skewed/silver", TABLES["silver"])
        large = Layers.from_tables(spark, f"{base}/skewed")
        for name, job in {
            "cell_kpis": lambda: cell_kpis(large.silver),
            "slice_kpis": lambda: slice_kpis(large.silver),
            "sla_violations": lambda: sla_violations(large.silver),
            "latency_by_slice": lambda: network.latency_by_slice(large),
            "worst_cells": lambda: network.worst_cells(large),
        }.items():
            started = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            at_scale[name] = round(time.perf_counter() - started, 3)

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {
                    name: round(events / seconds[name])
                    for name in ("silver_events", "cell_kpis", "slice_kpis", "sla_violations",
                                 *(f"stream_{table}" for table in ("silver", *GOLD)))
                },
                "skewed_rows": events * copies,
                "skewed_queries": at_scale,
                "setup_sec": round(setup, 3),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "events": events,
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
