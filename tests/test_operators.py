import datetime
import random
from functools import reduce

import pytest
from pyspark.sql import Window, functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from ranlens import schemas
from ranlens.functions.sla import limits_table
from ranlens.functions.sql import register_functions
from ranlens.operators.latest import latest_per_key
from ranlens.operators import percentiles
from ranlens.operators.percentiles import exact_percentiles, with_percentiles
from ranlens.operators.running import running_total
from ranlens.operators.silver import bronze_to_silver
from ranlens.operators.violations import sla_violations
from ranlens.operators.windows import cell_kpis, slice_kpis
from ranlens.settings import SLA_LIMITS, SLA_RULES
from tests.conftest import plan_of, rows

FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def union_of_rules(silver):
    """One filtered copy of the table per slice and rule."""
    parts = []
    for name, limits in SLA_LIMITS.items():
        for rule in SLA_RULES:
            sign = "<" if rule.bound == "min" else ">"
            part = silver.filter(f"slice_type = '{name}' AND sla_breach AND {rule.kpi} {sign} {limits[rule.kpi]}D")
            parts.append(
                part.selectExpr(
                    *schemas.SLA_VIOLATIONS.names[:6], f"'{rule.violation_type}' AS violation_type", f"'{rule.kpi}' AS kpi_name",
                    f"{rule.kpi} AS kpi_value", f"{limits[rule.kpi]}D AS threshold_value", f"'{rule.severity}' AS severity",
                )
            )
    return reduce(lambda a, b: a.unionByName(b), parts)


def test_violations_equal_the_union_of_rules(layers):
    ours = sla_violations(layers.silver).drop("detected_at")
    theirs = union_of_rules(layers.silver)
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0


def test_violations_and_breaches_cover_each_other(layers):
    breaching = layers.silver.filter("sla_breach").select("event_id")
    violating = sla_violations(layers.silver).select("event_id").distinct()
    assert rows(breaching) == rows(violating)


def test_violations_scan_once_without_shuffle(spark, layers, tmp_path):
    layers.silver.write.parquet(str(tmp_path / "silver"))
    plan = plan_of(sla_violations(spark.read.parquet(str(tmp_path / "silver"))))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "EvalPython" not in plan


def test_nan_kpi_is_no_violation(spark, layers):
    nan = layers.silver.filter("slice_type = 'eMBB' AND sla_breach").withColumn("jitter_ms", F.lit(float("nan")))
    assert sla_violations(nan).filter("kpi_name = 'jitter_ms'").count() == 0


def sample_values(seed=7):
    """Three groups: one with a third of all rows on one value, one wild, one without values."""
    rng = random.Random(seed)
    wild = [0.0, -0.0, 5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), float("nan"), 1e-9, -1e-9, 42.0]
    data = [("hot", 5.0) for _ in range(400)] + [("hot", rng.gauss(5, 2)) for _ in range(300)]
    data += [("wild", rng.choice(wild + [rng.uniform(-1e6, 1e6)])) for _ in range(300)]
    data += [(None, round(rng.uniform(-140, -44), 1)) for _ in range(200)]
    data += [("empty", None)] * 5 + [("single", 3.25)]
    return data


FRACTIONS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
WANTED = {f"p{int(p * 100)}": ("value", p) for p in FRACTIONS}


@pytest.mark.parametrize("most", [percentiles.MOST, 3, 0])
def test_percentiles_equal_the_built_in_aggregate(spark, monkeypatch, most):
    monkeypatch.setattr(percentiles, "MOST", most)
    data = spark.createDataFrame(sample_values(), "kind string, value double").repartition(7)
    found = exact_percentiles(data, ["kind"], WANTED)
    built_in = data.groupBy("kind").agg(*(F.percentile("value", p).alias(name) for name, (_, p) in WANTED.items()))
    assert rows(found) == rows(built_in.filter("kind IS NULL OR kind <> 'empty'"))


def test_percentiles_of_two_columns_and_no_keys(spark, layers):
    wanted = {"a": ("rsrp_dbm", 0.25), "b": ("sinr_db", 0.05), "c": ("sinr_db", 0.5)}
    found = exact_percentiles(layers.silver, [], wanted)
    built_in = layers.silver.agg(*(F.percentile(c, p).alias(name) for name, (c, p) in wanted.items()))
    assert rows(found) == rows(built_in)


def test_summary_keeps_groups_without_values(spark):
    data = spark.createDataFrame(sample_values(), "kind string, value double")
    summary = data.groupBy("kind").agg(F.count("*").alias("n"))
    report = with_percentiles(summary, data, ["kind"], {"p50": ("value", 0.5)})
    assert report.count() == 5
    assert report.filter("kind = 'empty'").first().p50 is None


def test_percentiles_share_one_counted_shuffle(spark, tmp_path):
    spark.createDataFrame(sample_values(), "kind string, value double").write.parquet(str(tmp_path / "t"))
    found = exact_percentiles(spark.read.parquet(str(tmp_path / "t")), ["kind"], WANTED)
    found.collect()
    plan = plan_of(found)
    final = plan[: plan.index("== Initial Plan ==")]
    assert "ReusedExchange" in final
    assert final.count("Join") == 1 and final.count("FileScan") == 1  # no bucket had to be cut


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=40), st.floats(0, 1))
def test_percentile_property(spark, values, p):
    data = spark.createDataFrame([(v,) for v in values], "value double")
    found = exact_percentiles(data, [], {"p": ("value", p)}).first().p
    assert repr(found + 0.0) == repr(data.agg(F.percentile("value", p)).first()[0] + 0.0)


def plain_cells(silver):
    """The cell table as a single aggregate with a distinct count."""
    averages = [name[4:] for name in schemas.CELL_KPIS.names if name.startswith("avg_")]
    return (
        silver.groupBy(F.window("event_timestamp", "1 minute", "30 seconds"), "cell_id", "gnb_id")
        .agg(
            *(F.avg(name).alias(f"avg_{name}") for name in averages),
            F.percentile_approx("dl_throughput_mbps", 0.95).alias("p95_dl_throughput_mbps"),
            F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"),
            F.count("*").alias("event_count"),
            F.count_distinct("ue_id").alias("unique_ues"),
            F.expr("coalesce(sum(cast(sla_breach AS bigint)), 0)").alias("sla_breach_count"),
            F.expr("coalesce(sum(cast(is_anomaly AS bigint)), 0)").alias("anomaly_count"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*")
        .select(*schemas.CELL_KPIS.names)
    )


def smooth(df):
    return df.withColumns({c: F.round(F.round(c, 11), 6) for c in df.columns if c.startswith("avg_")})


def test_cells_equal_the_single_aggregate(layers):
    assert rows(smooth(cell_kpis(layers.silver))) == rows(smooth(plain_cells(layers.silver)))


def test_schemas_of_gold(layers):
    for df, schema in ((layers.cell_kpis, schemas.CELL_KPIS), (layers.slice_kpis, schemas.SLICE_KPIS),
                       (layers.violations, schemas.SLA_VIOLATIONS)):
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


def test_missing_base_station_and_slice_form_groups(layers):
    silver = layers.silver.withColumn("gnb_id", F.lit(None).cast("string"))
    assert cell_kpis(silver).filter("gnb_id IS NULL").agg(F.sum("event_count")).first()[0] == 2 * silver.count()
    lost = slice_kpis(layers.silver).filter("slice_type IS NULL").agg(F.sum("event_count")).first()[0]
    assert lost == 2 * layers.silver.filter("slice_type IS NULL").count()


def test_windows_are_half_open_and_sliding(spark, layers):
    at = datetime.datetime(2024, 1, 1, 12, 0, 30)
    one = layers.silver.limit(1).withColumn("event_timestamp", F.lit(at))
    starts = [row.window_start for row in cell_kpis(one).orderBy("window_start").collect()]
    assert starts == [at - datetime.timedelta(seconds=30), at]
    assert cell_kpis(one, duration="1 minute", slide="1 minute").count() == 1


def test_approximate_ues_are_exact_for_few(layers):
    exact, sketch = cell_kpis(layers.silver), cell_kpis(layers.silver, approx_ues=True)
    assert exact.agg(F.sum("unique_ues")).first()[0] == sketch.agg(F.sum("unique_ues")).first()[0]


def test_all_null_flags_count_zero(layers):
    silver = layers.silver.withColumn("is_anomaly", F.lit(None).cast("boolean"))
    assert cell_kpis(silver).filter("anomaly_count <> 0 OR anomaly_count IS NULL").count() == 0


def test_latest_equals_the_join_with_the_maximum(spark):
    kpis = spark.createDataFrame(
        [("a", "g1", 1), ("a", "g1", 3), ("a", "g2", 3), ("b", "g1", 2), ("b", "g3", 1)], "cell_id string, gnb_id string, window_end int"
    )
    newest = kpis.groupBy("cell_id").agg(F.max("window_end").alias("window_end"))
    assert rows(latest_per_key(kpis, ["cell_id"], "window_end")) == rows(kpis.join(newest, ["cell_id", "window_end"]).select(*kpis.columns))
    assert "WindowGroupLimit" in plan_of(latest_per_key(kpis, ["cell_id"], "window_end"))


def test_running_total_equals_one_window(spark):
    start = datetime.datetime(2024, 1, 1, 22)
    data = [(start + datetime.timedelta(minutes=17 * i), i) for i in range(200)] + [(None, 5)]
    series = spark.createDataFrame(data, "ts timestamp, n long")
    whole = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    expected = series.withColumn("upto", F.sum("n").over(whole)).withColumn("first", F.lit(start))
    assert rows(running_total(series, "ts", "n", "upto", "first").select("ts", "n", "upto", "first")) == rows(expected)


def test_percentiles_of_a_narrow_hot_range_are_spread(spark):
    """Two million values within a hundredth of a percent of each other, in one group."""
    hot = spark.range(2_000_000).selectExpr("1 AS k", "5 + 0.0005 * rand(1) AS v")
    wanted = {"p50": ("v", 0.5), "p999": ("v", 0.999)}
    expected = hot.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.999))).alias("p")).first().p
    found = exact_percentiles(hot, ["k"], wanted)
    row = found.first()
    assert [row.p50, row.p999] == expected
    sorted_rows = largest_sort(found)
    assert 0 < sorted_rows < 20_000


def below(node):
    """The nodes under a node of an executed plan, through the stages of adaptive execution."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    if name.endswith("QueryStage"):
        return [node.plan()]
    return [node.children().apply(i) for i in range(node.children().size())]


def largest_sort(df):
    """Most rows that reach a window of the executed plan: the output of the nearest node under it that counts its rows."""

    def counted(node):
        metric = node.metrics().get("numOutputRows")
        return metric.get().value() if metric.isDefined() else max((counted(n) for n in below(node)), default=0)

    def windows(node):
        found = [counted(n) for n in below(node)] if node.nodeName() == "Window" else []
        return max(found + [windows(n) for n in below(node)], default=0)

    df.collect()
    return windows(df._jdf.queryExecution().executedPlan())


def test_violations_without_rules_or_limits_are_an_empty_table(layers):
    for empty in (sla_violations(layers.silver, rules=()), sla_violations(layers.silver, limits={})):
        assert empty.count() == 0 and empty.columns == schemas.SLA_VIOLATIONS.names


def test_limits_are_an_input(spark, layers):
    limits = {name: dict(own) for name, own in SLA_LIMITS.items()} | {"Unknown": {"latency_ms": 0.5}}
    limits["eMBB"]["latency_ms"] = 1e9
    silver = bronze_to_silver(layers.bronze, limits=limits)
    flagged = silver.filter("sla_breach")
    assert flagged.filter("slice_type = 'Unknown'").count() > 0
    by_mapping = sla_violations(silver, F.col("event_timestamp"), limits)
    by_table = sla_violations(silver, F.col("event_timestamp"), limits_table(spark, limits))
    assert rows(by_mapping) == rows(by_table)
    assert {r.kpi_name for r in by_mapping.filter("slice_type = 'Unknown'").collect()} == {"latency_ms"}
    assert by_mapping.filter("slice_type = 'eMBB' AND kpi_name = 'latency_ms'").count() == 0
    register_functions(spark, limits)
    names = "slice_type, dl_throughput_mbps, ul_throughput_mbps, latency_ms, packet_loss_pct, jitter_ms"
    assert silver.filter(F.expr(f"breaches_sla({names}) <> sla_breach")).count() == 0
    register_functions(spark)


def test_a_windowed_aggregate_with_many_groups_does_not_sort(layers):
    plan = plan_of(cell_kpis(layers.silver))
    assert "ObjectHashAggregate" in plan and layers.silver.sparkSession.conf.get(FALLBACK) == "65536"
