import datetime
import os

import pytest
from pyspark.sql import Window, functions as F

from ranlens import schemas
from ranlens.functions.sla import limits_table
from ranlens.operators.silver import bronze_to_silver
from ranlens.operators.violations import sla_violations, with_table_breach
from ranlens.operators.windows import cell_kpis, slice_kpis
from ranlens.session import shared_folder
from ranlens.operators.rollups import minute_rollup
from ranlens.plans import dashboard, network, rollup_reports
from ranlens.plans.layers import Layers
from ranlens.sources.payloads import events_of, failures_of, judged_payload, parse_payload, stream_json_dir
from ranlens.sources.tables import TABLES, WRITE, append, read_table, stream_table, write_batch
from checks.catalog import catalog, messages_from_log
from ranlens.sources.writes import Write
from ranlens.streaming.late import lateness
from ranlens.streaming.monitor import ProgressHistory, progress_frame, rows_read, stop_all
from ranlens.streaming.pipelines import Medallion, observed_ingest, start_append
from tests.conftest import plan_of, rows, written

NOON = datetime.datetime(2024, 1, 1, 12)


def parts_in_time_order(df, ts, directory, parts=3):
    """Write the rows as files whose age follows event time."""
    numbered = df.withColumn("part", F.ntile(parts).over(Window.orderBy(ts)))
    for i in range(1, parts + 1):
        add_file(numbered.filter(F.col("part") == i).drop("part"), directory, i)


def add_file(df, directory, age):
    before = set(directory.glob("*.parquet")) if directory.exists() else set()
    df.coalesce(1).write.mode("append").parquet(str(directory))
    for path in set(directory.glob("*.parquet")) - before:
        os.utime(path, (1_700_000_000 + age * 60,) * 2)


def smooth(df):
    return df.withColumns({c: F.round(F.round(c, 12), 9) for c in df.columns if c.startswith("avg_")})


def closed(df, silver):
    newest = silver.agg(F.max("event_timestamp")).first()[0]
    return df.filter(F.col("window_end") <= F.lit(newest) - F.expr("INTERVAL 30 SECONDS"))


@pytest.fixture(scope="module")
def bronze_dir(layers, tmp_path_factory):
    directory = tmp_path_factory.mktemp("stream") / "bronze"
    parts_in_time_order(layers.bronze, "event_timestamp", directory)
    return directory


@pytest.fixture(scope="module")
def pipeline(spark, bronze_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("medallion")
    medallion = Medallion(spark, str(base / "tables"), str(base / "checkpoints"), max_files_per_trigger=1)
    medallion.create_tables()
    bronze = stream_table(spark, str(bronze_dir), schemas.BRONZE, max_files_per_trigger=1)
    medallion.run_available(bronze)
    return medallion


def stored(spark, pipeline, table):
    return read_table(spark, pipeline.path(table), TABLES[table].schema).select(*TABLES[table].schema.names)


def test_stateless_streams_equal_the_batch(spark, layers, pipeline):
    assert rows(stored(spark, pipeline, "silver").drop("ingested_at")) == rows(layers.silver.drop("ingested_at"))
    assert rows(stored(spark, pipeline, "sla_violations").drop("detected_at")) == rows(layers.violations.drop("detected_at"))


@pytest.mark.parametrize(("table", "derive"), [("cell_kpis", cell_kpis), ("slice_kpis", slice_kpis)])
def test_windowed_streams_equal_the_closed_windows(spark, layers, pipeline, table, derive):
    streamed = stored(spark, pipeline, table)
    assert streamed.count() > 0
    assert rows(smooth(streamed)) == rows(smooth(closed(derive(layers.silver), layers.silver)))


@pytest.mark.parametrize("derive", [cell_kpis, slice_kpis])
def test_many_batches_equal_the_closed_windows(spark, layers, bronze_dir, tmp_path, derive):
    stream = bronze_to_silver(stream_table(spark, str(bronze_dir), schemas.BRONZE, max_files_per_trigger=1))
    query = start_append(derive(stream), str(tmp_path / "out"), "batches", str(tmp_path / "checkpoint"), trigger=None)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    streamed = written(spark, tmp_path / "out")
    assert rows(smooth(streamed)) == rows(smooth(closed(derive(layers.silver), layers.silver)))


def test_nothing_is_read_twice_after_a_restart(spark, layers, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    numbered = layers.bronze.withColumn("late", F.col("event_timestamp") > "2024-01-01T00:30")
    for age, late in enumerate((False, True)):
        add_file(numbered.filter(F.col("late") == late).drop("late"), source, age)
        stream = stream_table(spark, str(source), schemas.BRONZE)
        kpis = slice_kpis(bronze_to_silver(stream))
        start_append(kpis, out, "restarted", checkpoint, trigger=None).awaitTermination()
        seen = bronze_to_silver(spark.read.schema(schemas.BRONZE).parquet(str(source)))
        found = written(spark, out)
        assert rows(smooth(found)) == rows(smooth(closed(slice_kpis(seen), seen)))


def test_late_rows_use_the_watermark_of_the_batch_before(spark, layers, tmp_path):
    template = layers.silver.limit(1)

    def events(*moments):
        parts = [template.withColumn("event_timestamp", F.lit(NOON + datetime.timedelta(seconds=s))) for s in moments]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    # The second file's late row is kept, as its batch still filters by the first watermark.
    for age, moments in enumerate([(600,), (20, 610), (25, 1200)]):
        add_file(events(*moments), tmp_path / "in", age)
    stream = stream_table(spark, str(tmp_path / "in"), schemas.SILVER, max_files_per_trigger=1)
    query = start_append(cell_kpis(stream), str(tmp_path / "out"), "late", str(tmp_path / "checkpoint"), trigger=None)
    query.awaitTermination()
    first = written(spark, tmp_path / "out").filter(F.col("window_start") == F.lit(NOON)).first()
    assert (first.event_count, first.unique_ues) == (1, 1)
    dropped = [op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(dropped) > 0


def test_json_files_and_message_values(spark, layers, tmp_path):
    layers.bronze.write.json(str(tmp_path / "json"))
    stream = stream_json_dir(spark, str(tmp_path / "json"), max_files_per_trigger=1)
    start_append(bronze_to_silver(stream), str(tmp_path / "a"), "json", str(tmp_path / "ca"), trigger=None).awaitTermination()
    lines = spark.readStream.text(str(tmp_path / "json"))
    start_append(bronze_to_silver(parse_payload(lines)), str(tmp_path / "b"), "text", str(tmp_path / "cb"), trigger=None).awaitTermination()
    expected = rows(layers.silver.drop("ingested_at"))
    for name in ("a", "b"):
        assert rows(written(spark, tmp_path / name).drop("ingested_at")) == expected


def test_broken_payloads_are_stored_and_counted_beside_the_good_ones(spark, layers, tmp_path):
    messages = messages_from_log(layers.bronze).select(F.col("value").cast("string"))
    messages.unionByName(spark.createDataFrame([("{broken",), ("[1",)], "value string")).write.text(str(tmp_path / "in"))
    medallion = Medallion(spark, str(tmp_path / "tables"), str(tmp_path / "checkpoints"))
    medallion.create_tables()
    query = medallion.start_bronze(stream_json_dir(spark, str(tmp_path / "in")), trigger=None)
    query.awaitTermination()
    judged = judged_payload(spark.read.text(str(tmp_path / "in")).where("trim(value) <> ''"))
    assert rows(medallion.read("bronze")) == rows(events_of(judged))
    assert rows(medallion.read("quarantine").drop("received_at")) == rows(failures_of(judged).drop("received_at"))
    counted = [p["observedMetrics"]["payloads"] for p in query.recentProgress if p["numInputRows"]]
    failed = failures_of(judged).count()
    assert failed > 2 and sum(c["failed"] for c in counted) == failed and sum(c["rows"] for c in counted) == judged.count()
    medallion.run_available()
    good = bronze_to_silver(events_of(judged)).drop("ingested_at")
    assert rows(silver_of(spark, medallion)) == rows(good)
    assert Layers.from_tables(spark, medallion.base).quarantine.count() == failed


def test_a_stream_may_join_the_limits_table(spark, layers, bronze_dir, tmp_path):
    stream = bronze_to_silver(stream_table(spark, str(bronze_dir), schemas.BRONZE)).drop("sla_breach")
    judged = with_table_breach(stream, limits_table(spark)).select("event_id", "sla_breach")
    start_append(judged, str(tmp_path / "out"), "limits", str(tmp_path / "checkpoint"), trigger=None).awaitTermination()
    assert rows(written(spark, tmp_path / "out")) == rows(layers.silver.select("event_id", "sla_breach"))


def test_running_streams_report_progress_and_stop(spark, layers, bronze_dir, tmp_path):
    stream = observed_ingest(stream_table(spark, str(bronze_dir), schemas.BRONZE))
    query = start_append(bronze_to_silver(stream), str(tmp_path / "out"), "running", str(tmp_path / "checkpoint"), trigger="1 second")
    query.processAllAvailable()
    progress = progress_frame(spark)
    assert progress.columns == ["query", "status", "input_rows_per_sec", "processed_rows"]
    assert progress.filter("query = 'running'").count() == 1
    counts = [p["observedMetrics"]["ingest"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(c["events"] for c in counts) == layers.bronze.count()
    assert sum(c["anomalies"] for c in counts) == layers.bronze.filter("is_anomaly = 'true'").count()
    stop_all(spark)
    assert progress_frame(spark).count() == 0 and not spark.streams.active


def test_the_progress_of_every_batch_is_kept(spark, layers, tmp_path):
    history = ProgressHistory(spark, str(tmp_path / "history"), rows=3)
    medallion = Medallion(spark, str(tmp_path / "tables"), str(tmp_path / "checkpoints"), max_files_per_trigger=1)
    medallion.create_tables()
    parts_in_time_order(layers.bronze, "event_timestamp", tmp_path / "in")
    queries = [medallion.start_silver(stream_table(spark, str(tmp_path / "in"), schemas.BRONZE, max_files_per_trigger=1), None)]
    queries[0].awaitTermination()
    for query in medallion.start_gold(trigger=None):
        query.awaitTermination()
        queries.append(query)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    history.close()
    found = history.read()
    assert {r["query"] for r in found.select("query").distinct().collect()} == {"silver", "cell_kpis", "slice_kpis", "sla_violations"}
    for query in queries:
        own = found.where(F.col("query_id") == query.id)
        kept = {r.batch_id: r.processed_rows for r in own.collect()}
        assert kept == {p["batchId"]: rows_read(p) for p in query.recentProgress}
        assert sum(kept.values()) == (layers.bronze if query.name == "silver" else layers.silver).count()


def test_the_rolled_up_minutes_of_a_stream_give_the_direct_reports(spark, layers, tmp_path):
    medallion = Medallion(spark, str(tmp_path / "tables"), str(tmp_path / "checkpoints"))
    medallion.create_tables()
    append(layers.silver, medallion.path("silver"), TABLES["silver"])
    medallion.start_rollup(trigger=None).awaitTermination()
    tables = Layers.from_tables(spark, medallion.base)
    newest = layers.silver.agg(F.max("event_timestamp")).first()[0]
    assert tables.minute_rollup.count() == layers.minute_rollup.count() > 0
    for name in ("event_rate_recent", "sla_scorecard", "cell_signal_quality", "anomaly_rate_recent", "breach_leaderboard"):
        for as_of in (newest, newest.replace(second=0, microsecond=0), newest + datetime.timedelta(minutes=90)):
            report = getattr(rollup_reports, name)(tables, as_of)
            assert rows(report) == rows(getattr(dashboard, name)(layers, as_of)), (name, as_of)
    plan = plan_of(rollup_reports.sla_scorecard(tables, newest))
    assert "event_timestamp" in plan[plan.index("PushedFilters"):] and "event_date" in plan[plan.index("PartitionFilters"):]


def test_long_periods_are_told_from_sketches_alone(spark, layers):
    found = {r.slice_type: r for r in rollup_reports.slice_overview(layers).collect()}
    ends = F.window("event_timestamp", "1 minute").end
    newest = layers.silver.agg(F.max("event_timestamp")).first()[0]
    exact = network.network_overview(Layers({"silver": lambda: layers.silver.where(ends <= F.lit(newest) - F.expr("INTERVAL 30 SECONDS"))}))
    for row in exact.collect():
        own = found.pop(row.slice_type)
        assert (own.total_events, own.anomaly_rate_pct, own.unique_cells) == (row.total_events, row.anomaly_rate_pct, row.unique_cells)
        assert (own.earliest_event, own.latest_event) == (row.earliest_event, row.latest_event)
        assert abs(own.unique_ues - row.unique_ues) <= 0.02 * row.unique_ues
    assert not found
    many = spark.range(200_000).selectExpr(
        "timestamp_seconds(id % 600) AS event_timestamp", "cast(id % 50000 AS string) AS ue_id", "'s' AS slice_type", "'c' AS cell_id",
        "'g' AS gnb_id", "-90D AS rsrp_dbm", "1D AS sinr_db", "7 AS cqi", "1D AS latency_ms", "2D AS rb_utilization_pct",
        "'Good' AS signal_quality_class", "false AS sla_breach", "false AS is_anomaly")
    rolled = Layers({"minute_rollup": lambda: minute_rollup(many)})
    assert abs(rollup_reports.slice_overview(rolled).first().unique_ues - 50_000) < 0.02 * 50_000


def test_the_newest_window_of_each_cell_is_kept_by_a_stream(spark, layers, tmp_path):
    medallion = Medallion(spark, str(tmp_path / "tables"), str(tmp_path / "checkpoints"))
    medallion.create_tables()
    seconds = F.unix_seconds("window_end")
    parts = [layers.cell_kpis.where(seconds % 180 == rest) for rest in (60, 0, 120)]  # the last is not the newest
    for part in (*parts, layers.cell_kpis.where(seconds % 60 != 0)):
        append(part, medallion.path("cell_kpis"), TABLES["cell_kpis"])
        medallion.start_latest_cells(trigger=None).awaitTermination()  # goes on from its checkpoint
        direct = network.latest_cell_kpis(Layers.from_tables(spark, medallion.base))
        kept = network.latest_cell_kpis(Layers({"cell_kpis": medallion.latest_cells}))
        assert rows(kept) == rows(direct) and direct.count() > 0
    written_rows = spark.read.parquet(medallion.path("latest_cells")).count()
    assert written_rows < layers.cell_kpis.count()


def test_all_four_streams_run_together(spark, layers, tmp_path):
    medallion = Medallion(spark, str(tmp_path / "tables"), str(tmp_path / "checkpoints"))
    medallion.create_tables()
    append(layers.bronze, medallion.path("bronze"), TABLES["bronze"])
    queries = medallion.start_all("1 second")
    assert [q.name for q in queries] == ["silver", "cell_kpis", "slice_kpis", "sla_violations"]
    queries[0].processAllAvailable()
    queries[3].processAllAvailable()
    stop_all(spark)
    assert read_table(spark, medallion.path("sla_violations")).count() == sla_violations(layers.silver).count()


def test_tables_are_registered_in_a_database(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS radio")
    medallion = Medallion(spark, str(tmp_path / "tables"))
    for _ in range(2):
        medallion.create_tables("radio")
    stored_tables = {t.name for t in spark.catalog.listTables("radio") if not t.isTemporary}
    assert stored_tables == set(TABLES)
    assert spark.table("radio.sla_violations").columns == [*schemas.SLA_VIOLATIONS.names, "detected_date", WRITE]


def test_default_checkpoints_are_in_the_shared_folder_one_for_each_table(spark, layers, bronze_dir, tmp_path):
    for name in ("one", "two"):  # two pipelines that name their queries alike
        for _ in range(2):
            stream = bronze_to_silver(stream_table(spark, str(bronze_dir), schemas.BRONZE))
            start_append(stream, str(tmp_path / name), "in_shared", trigger=None).awaitTermination()
    found = [p for p in os.listdir(f"{shared_folder(spark)}/streams") if p.startswith("in_shared-")]
    assert len(found) == 2
    for name in ("one", "two"):
        assert written(spark, tmp_path / name).count() == layers.silver.count()


def halves(layers):
    late = F.col("event_timestamp") > "2024-01-01T00:30"
    return layers.bronze.filter(~late), layers.bronze.filter(late)


def silver_of(spark, medallion):
    return stored(spark, medallion, "silver").drop("ingested_at")


@pytest.mark.parametrize("stream_first", [True, False])
def test_jobs_and_streams_share_a_table(spark, layers, tmp_path, stream_first):
    medallion = Medallion(spark, str(tmp_path / "tables"))
    medallion.create_tables()
    early, late = halves(layers)
    add_file(early, tmp_path / "in", 1)

    def job():
        append(bronze_to_silver(late), medallion.path("silver"), TABLES["silver"])

    def stream():
        medallion.start_silver(stream_table(spark, str(tmp_path / "in"), schemas.BRONZE), trigger=None).awaitTermination()

    for write in (stream, job) if stream_first else (job, stream):
        write()
    assert rows(silver_of(spark, medallion)) == rows(layers.silver.drop("ingested_at"))


def test_a_batch_that_runs_again_writes_once(spark, layers, tmp_path):
    path, silver = str(tmp_path / "silver"), layers.silver
    append(silver, path, TABLES["silver"])
    write_batch(silver, path, "stream-0", TABLES["silver"])
    files = set((tmp_path / "silver").rglob("*.parquet"))
    write_batch(silver, path, "stream-0", TABLES["silver"])  # completed, but its commit was lost
    assert set((tmp_path / "silver").rglob("*.parquet")) == files
    os.remove(tmp_path / "silver" / "_batches" / "stream-0")  # stopped between its files and its mark
    write_batch(silver, path, "stream-0", TABLES["silver"])
    write_batch(silver.limit(0), path, "stream-1", TABLES["silver"])
    assert read_table(spark, path).count() == 2 * silver.count()


def test_a_crash_between_write_and_commit_loses_and_repeats_nothing(spark, layers, tmp_path):
    early, late = halves(layers)
    checkpoint = tmp_path / "checkpoint"

    def run():
        stream = stream_table(spark, str(tmp_path / "in"), schemas.BRONZE)
        start_append(bronze_to_silver(stream), str(tmp_path / "out"), "crash", str(checkpoint), trigger=None).awaitTermination()

    for age, part in enumerate((early, late)):
        add_file(part, tmp_path / "in", age)
        run()
    for name in ("1", ".1.crc"):
        os.remove(checkpoint / "commits" / name)
    run()
    assert rows(written(spark, tmp_path / "out").drop("ingested_at")) == rows(layers.silver.drop("ingested_at"))


def gold_equals_the_batch(spark, medallion, silver):
    assert rows(stored(spark, medallion, "sla_violations").drop("detected_at")) == rows(sla_violations(silver).drop("detected_at"))
    for table, derive in (("cell_kpis", cell_kpis), ("slice_kpis", slice_kpis)):
        assert rows(smooth(medallion.gold(table))) == rows(smooth(closed(derive(silver), silver)))


def run_gold(medallion):
    for query in medallion.start_gold(trigger=None, since=medallion.hand_off()):
        query.awaitTermination()


@pytest.fixture
def filled(spark, layers, tmp_path):
    """Silver with the first half of the events, and gold filled from it by a job that ran twice."""
    medallion = Medallion(spark, str(tmp_path / "tables"), str(tmp_path / "checkpoints"))
    medallion.create_tables()
    early = layers.silver.filter(F.col("event_timestamp") < "2024-01-01T00:30")
    for part in early.randomSplit([1.0, 1.0], 1):
        append(part, medallion.path("silver"), TABLES["silver"])
    for _ in range(2):
        medallion.backfill_gold()
    return medallion


def test_gold_is_filled_by_a_job_and_continued_by_streams(spark, layers, filled):
    run_gold(filled)  # nothing is new yet
    append(layers.silver.filter(F.col("event_timestamp") >= "2024-01-01T00:30"), filled.path("silver"), TABLES["silver"])
    run_gold(filled)
    gold_equals_the_batch(spark, filled, layers.silver)
    filled.merge_late()
    gold_equals_the_batch(spark, filled, layers.silver)


def test_old_events_that_come_after_the_back_fill_are_in_no_part_twice_and_in_none_missing(spark, layers, filled):
    early = layers.silver.filter(F.col("event_timestamp") < "2024-01-01T00:20")
    old = early.limit(40).withColumn("event_id", F.concat(F.lit("late-"), "event_id"))
    old = old.unionByName(early.limit(3).withColumns({"event_id": F.lit("alone"), "cell_id": F.lit("no other event")}))
    old = spark.createDataFrame(old.collect(), old.schema)
    append(old, filled.path("silver"), TABLES["silver"])
    run_gold(filled)
    append(layers.silver.filter(F.col("event_timestamp") >= "2024-01-01T00:30"), filled.path("silver"), TABLES["silver"])
    run_gold(filled)
    everything = layers.silver.unionByName(old)
    found = stored(spark, filled, "sla_violations").drop("detected_at")
    assert rows(found) == rows(sla_violations(everything).drop("detected_at"))
    assert filled.gold("cell_kpis").agg(F.sum("event_count")).first()[0] < closed(cell_kpis(everything), everything).agg(F.sum("event_count")).first()[0]
    assert filled.merge_late() > 0
    gold_equals_the_batch(spark, filled, everything)
    tables = Layers.from_tables(spark, filled.base)
    assert rows(smooth(tables.cell_kpis)) == rows(smooth(filled.gold("cell_kpis")))
    files = set(os.listdir(filled.path("cell_kpis_revisions")))
    assert filled.merge_late() == 0
    assert set(os.listdir(filled.path("cell_kpis_revisions"))) == files
    assert rows(filled.late_events().select("event_id")) == rows(old.select("event_id"))


def test_windows_are_revised_again_when_more_late_events_come(spark, layers, filled):
    append(layers.silver.filter(F.col("event_timestamp") >= "2024-01-01T00:30"), filled.path("silver"), TABLES["silver"])
    run_gold(filled)
    everything = layers.silver
    for i in range(2):
        late = [r for r in layers.silver.limit(5).withColumn("event_id", F.lit(f"late {i}")).collect()]
        late = spark.createDataFrame(late, layers.silver.schema)
        append(late, filled.path("silver"), TABLES["silver"])
        everything = everything.unionByName(late)
        run_gold(filled)
        assert filled.merge_late() > 0
        gold_equals_the_batch(spark, filled, everything)


def test_windows_that_gold_has_not_closed_are_left_to_it(spark, layers, filled):
    run_gold(filled)
    append(layers.silver.filter(F.col("event_timestamp") >= "2024-01-01T00:30"), filled.path("silver"), TABLES["silver"])
    late = spark.createDataFrame(layers.silver.filter(F.col("event_timestamp") > "2024-01-01T00:40").limit(9).collect(), layers.silver.schema)
    append(late, filled.path("silver"), TABLES["silver"])
    assert filled.merge_late() == 0  # gold is behind
    run_gold(filled)
    filled.merge_late()
    gold_equals_the_batch(spark, filled, layers.silver.unionByName(late))


def test_a_new_checkpoint_at_the_old_path_is_a_new_writer(spark, layers, tmp_path):
    early, late = halves(layers)
    for i, part in enumerate((early, late)):
        add_file(part, tmp_path / f"in{i}", i)
        stream = bronze_to_silver(stream_table(spark, str(tmp_path / f"in{i}"), schemas.BRONZE))
        checkpoint = tmp_path / "checkpoint"
        for _ in range(2):  # one that goes on writes nothing again
            start_append(stream, str(tmp_path / "out"), "writer", str(checkpoint), trigger=None).awaitTermination()
        checkpoint.rename(tmp_path / f"checkpoint{i}")
    assert rows(written(spark, tmp_path / "out").drop("ingested_at")) == rows(layers.silver.drop("ingested_at"))


def test_rows_read_are_counted_once_for_every_stream(spark, layers, tmp_path):
    medallion = Medallion(spark, str(tmp_path / "tables"))
    medallion.create_tables()
    append(layers.bronze, medallion.path("bronze"), TABLES["bronze"])
    silver = medallion.start_silver(trigger=None)
    silver.awaitTermination()
    assert sum(rows_read(p) for p in silver.recentProgress) == layers.bronze.count()
    for query in medallion.start_gold(trigger=None):
        query.awaitTermination()
        assert sum(rows_read(p) for p in query.recentProgress if p["numInputRows"]) == layers.silver.count()


@pytest.mark.parametrize("name", ["stream_silver_events", "stream_cell_kpis", "stream_slice_kpis", "stream_sla_violations", "stream_payload_failures"])
def test_registered_streams_read_a_log_of_several_files_and_leave_nothing_behind(spark, folder, tmp_path, name):
    log = spark.read.parquet(f"{folder}/events.parquet")
    log.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    query = catalog()[name]
    assert rows(query(spark, str(tmp_path))) == rows(query(spark, folder))
    assert os.listdir(f"{shared_folder(spark)}/runs") == []


def test_which_events_a_write_may_find_closed_windows_for():
    at = [NOON + datetime.timedelta(minutes=m) for m in range(9)]
    writes = [Write("s-0", 0), Write("s-1", 10**6), Write("job_a", 2 * 10**6), Write("s-2", 2 * 10**6 + 1), Write("s-3", 4 * 10**6)]
    newest = {"s-0": at[3], "s-1": at[1], "job_a": at[5], "s-2": at[2], "s-3": at[8]}
    # A stream's own batches are in order; a job beside it counts for the batch just before it, too.
    assert lateness(writes, newest, None) == {"s-1": at[3], "job_a": at[3], "s-2": at[5], "s-3": at[5]}
    assert lateness(writes, newest, at[4]) == {"s-0": at[4], "s-1": at[4], "job_a": at[4], "s-2": at[5], "s-3": at[5]}
    assert lateness([Write("job_b", 0), Write("s-9", 1)], {"job_b": at[1], "s-9": at[2]}, None) == {"job_b": at[2], "s-9": at[1]}
