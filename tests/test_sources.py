import datetime
import json

from pyspark.sql import functions as F

from ranlens import schemas
from ranlens.functions.timing import recent
from ranlens.operators.silver import bronze_to_silver
from ranlens.plans.layers import Layers
from ranlens.sources.payloads import events_of, failures_of, judged_payload, parse_payload
from ranlens.sources.tables import TABLES, TABLES_BY_KEY, WRITE, append, ensure_table, read_table, register_table, register_views
from tests.conftest import rows

NOW = datetime.datetime(2024, 1, 1, 1)


def test_append_and_read_back(spark, layers, tmp_path):
    path = str(tmp_path / "silver")
    silver = bronze_to_silver(layers.bronze, NOW)
    append(silver, path, TABLES["silver"])
    back = read_table(spark, path, schemas.SILVER)
    assert back.columns == [*schemas.SILVER.names, "event_date", WRITE]
    assert rows(back.drop("event_date", WRITE)) == rows(silver)
    append(silver, path, TABLES["silver"])
    assert read_table(spark, path).count() == 2 * silver.count()


def test_layout_by_key(spark, layers, tmp_path):
    path = str(tmp_path / "silver")
    append(layers.silver, path, TABLES_BY_KEY["silver"])
    found = {p.name for p in (tmp_path / "silver").iterdir() if p.is_dir()}
    assert {"slice_type=eMBB", "slice_type=__HIVE_DEFAULT_PARTITION__"} <= found
    assert read_table(spark, path, schemas.SILVER).filter("slice_type IS NULL").count() > 0


def test_partitioned_append_writes_few_files(layers, tmp_path):
    append(layers.silver.repartition(16), str(tmp_path / "silver"), TABLES["silver"])
    directories = [p for p in (tmp_path / "silver").glob("event_date=*/slice_type=*/*")]
    assert len(directories) == 5
    assert all(len(list(d.glob("*.parquet"))) <= 2 for d in directories)


def test_ensure_table_creates_once_and_registers(spark, layers, tmp_path):
    path = str(tmp_path / "it's" / "ue_events")
    ensure_table(spark, path, TABLES["silver"], "silver_ensured")
    assert spark.table("silver_ensured").count() == 0
    append(bronze_to_silver(layers.bronze, NOW), path, TABLES["silver"])
    ensure_table(spark, path, TABLES["silver"], "silver_ensured")
    assert read_table(spark, path).count() == layers.silver.count()
    assert spark.table("silver_ensured").count() == layers.silver.count()


def test_tables_with_the_same_last_path_part_stay_apart(spark, tmp_path):
    for layer in ("bronze", "silver"):
        ensure_table(spark, str(tmp_path / layer / "ue_events"), TABLES[layer], f"{layer}_apart")
    assert spark.table("bronze_apart").schema["rsrp_dbm"].dataType.simpleString() == "string"
    assert spark.table("silver_apart").schema["rsrp_dbm"].dataType.simpleString() == "double"
    description = spark.sql("DESCRIBE TABLE EXTENDED silver_apart").filter("col_name = 'Comment'").first()
    assert description.data_type == TABLES["silver"].comment


def test_register_is_idempotent(spark, tmp_path):
    append(spark.createDataFrame([("1",)], "event_id string"), str(tmp_path / "t"))
    for _ in range(2):
        register_table(spark, "twice", str(tmp_path / "t"), TABLES["bronze"])
    assert spark.table("twice").count() == 1


def test_views(spark, layers):
    layers.register(spark)
    assert spark.sql("SELECT count(*) FROM silver_events").first()[0] == layers.silver.count()
    register_views(spark, {"one": spark.range(1)})
    assert spark.table("one").count() == 1


def test_layers_from_tables(spark, layers, tmp_path):
    for name, df in (("bronze", layers.bronze), ("silver", layers.silver), ("cell_kpis", layers.cell_kpis),
                     ("slice_kpis", layers.slice_kpis), ("sla_violations", layers.violations)):
        append(df, str(tmp_path / name), TABLES[name])
    stored = Layers.from_tables(spark, str(tmp_path))
    assert stored.bronze.count() == layers.bronze.count()
    assert rows(stored.violations.select(*schemas.SLA_VIOLATIONS.names)) == rows(layers.violations)


def test_look_back_prunes_days_and_reaches_the_scan(spark, layers, tmp_path):
    path = str(tmp_path / "silver")
    old = layers.silver.withColumn("event_timestamp", F.col("event_timestamp") - F.expr("INTERVAL 3 DAYS"))
    append(layers.silver.unionByName(old), path, TABLES["silver"])
    newest = layers.silver.agg(F.max("event_timestamp")).first()[0]
    found = recent(read_table(spark, path, schemas.SILVER), "event_timestamp", "15 minutes", newest)
    assert rows(found.select("event_id")) == rows(recent(layers.silver, "event_timestamp", "15 minutes", newest).select("event_id"))
    text = found._jdf.queryExecution().executedPlan().toString()
    partitions = text[text.index("PartitionFilters"):text.index("PushedFilters")]
    pushed = text[text.index("PushedFilters"):text.index("ReadSchema")]
    assert "event_date" in partitions and "GreaterThanOrEqual(event_timestamp" in pushed


def test_look_back_is_inclusive_and_open_ended(spark):
    at = datetime.datetime(2024, 1, 1, 12)
    data = spark.createDataFrame([(at,), (at - datetime.timedelta(microseconds=1),), (at + datetime.timedelta(days=9),)], "ts timestamp")
    assert recent(data, "ts", "15 minutes", at + datetime.timedelta(minutes=15)).count() == 2
    now = spark.sql("SELECT current_timestamp() AS ts UNION ALL SELECT current_timestamp() - INTERVAL 1 DAY")
    assert recent(now, "ts", "1 hour").count() == 1


def test_payloads(spark):
    good = json.dumps({"event_id": "1", "cell_id": "c", "ue_id": "u", "event_timestamp": "2024-01-01T00:00:00.5Z", "other": 1})
    messages = spark.createDataFrame([(good.encode(), 7), (b"{broken", 8)], "body binary, offset long")
    events = parse_payload(messages, "body")
    assert events.columns == schemas.BRONZE.names
    assert events.count() == bronze_to_silver(events).count() == 1


def test_payloads_that_hold_no_event_are_kept_with_the_reason(spark):
    good = '{"event_id": "1"}'
    broken = {
        '{"event_id": "1"': "broken", "{broken": "broken", "[]": "no_object", f"[{good}]": "no_object", "null": "no_object",
        "12": "no_object", '"text"': "no_object", "": "empty", " ": "empty", None: "empty",
    }
    messages = spark.createDataFrame([(v,) for v in [*broken, good, "{}", '{"event_id": "1", "_corrupt": "x"}']], "value string")
    judged = judged_payload(messages)
    assert {(r.payload, r.failure) for r in failures_of(judged).collect()} == set(broken.items())
    assert events_of(judged).columns == schemas.BRONZE.names
    assert [r.event_id for r in events_of(judged).collect()] == ["1", None, "1"]
    assert rows(failures_of(judged).drop("received_at")) == rows(judged.where("failure IS NOT NULL").select("payload", "failure"))
