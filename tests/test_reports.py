import datetime

import pytest
from pyspark.sql import functions as F

from ranlens.plans import dashboard, network, quality
from tests.conftest import rows

LATER = datetime.datetime(2030, 1, 1)

# SQL text over the views, with the built-in aggregates, against the report of the same name.
SQL = {
    network.network_overview: """SELECT slice_type, count(1), round(100 * mean(int(is_anomaly)), 2),
        size(collect_set(cell_id)), size(collect_set(ue_id)), min(event_timestamp), max(event_timestamp)
        FROM silver_events GROUP BY ALL""",
    network.latency_by_slice: """SELECT slice_type, round(p[0], 3), round(p[1], 3), round(p[2], 3), round(slowest, 3),
        round(jitter, 3), round(loss, 5)
        FROM (SELECT slice_type, percentile(latency_ms, array(0.5, 0.95, 0.99)) AS p, max(latency_ms) AS slowest,
          mean(jitter_ms) AS jitter, mean(packet_loss_pct) AS loss FROM silver_events
          WHERE latency_ms IS NOT NULL GROUP BY slice_type)""",
    network.signal_percentiles: """SELECT slice_type, round(r[0], 1), round(r[1], 1), round(r[2], 1), round(r[3], 1),
        round(r[4], 1), round(s[0], 1), round(s[1], 1)
        FROM (SELECT slice_type, percentile(rsrp_dbm, array(0, 0.25, 0.5, 0.75, 1)) AS r,
          percentile(sinr_db, array(0.5, 0.05)) AS s FROM silver_events
          WHERE isnotnull(rsrp_dbm) AND isnotnull(sinr_db) GROUP BY slice_type)""",
    network.latest_cell_kpis: """SELECT cell_id, gnb_id, round(avg_rsrp_dbm, 1), round(avg_sinr_db, 1),
        round(avg_dl_throughput_mbps, 1), round(avg_latency_ms, 2), round(avg_rb_utilization_pct, 1),
        event_count, unique_ues, sla_breach_count, anomaly_count
        FROM cell_kpis WHERE (cell_id, window_end) IN (SELECT cell_id, max(window_end) FROM cell_kpis GROUP BY cell_id)""",
    network.sla_compliance: """SELECT slice_type, n, bad, round((n - bad) / n * 100, 2)
        FROM (SELECT slice_type, count(1) AS n, count_if(sla_breach) AS bad FROM silver_events GROUP BY slice_type)
        WHERE isnotnull(slice_type)""",
}


@pytest.mark.parametrize("report", SQL, ids=lambda report: report.__name__)
def test_report_equals_the_sql_on_the_views(spark, layers, report):
    layers.register(spark)
    assert rows(report(layers)) == rows(spark.sql(SQL[report]))


def test_gauge_is_one_row_without_recent_events(layers):
    row = dashboard.urllc_latency_gauge(layers, LATER).collect()
    assert [tuple(r) for r in row] == [("URLLC", None, None, None, 1.0, None)]


def test_look_backs_are_empty_later(layers):
    for report in (dashboard.event_rate_recent, dashboard.sla_scorecard, dashboard.latency_recent, dashboard.rb_utilisation):
        assert report(layers, LATER).count() == 0


def test_null_load_is_low(layers):
    silver = layers.silver.withColumn("rb_utilization_pct", F.lit(None).cast("double"))
    report = dashboard.rb_utilisation(type(layers)({"silver": lambda: silver}), datetime.datetime(2024, 1, 1))
    assert {row.load_status for row in report.collect()} == {"Low Load"}


def test_limits_are_the_report_not_a_sample(layers):
    assert network.worst_cells(layers).count() == 10
    assert network.worst_cells(layers, rows=1000).count() == layers.silver.select("cell_id", "gnb_id").distinct().count()


def test_reports_are_ordered(layers):
    worst = [(-row.sla_breaches, row.avg_rsrp_dbm) for row in network.worst_cells(layers).collect()]
    assert worst == sorted(worst)
    labels = [row.signal_quality_class for row in network.signal_class_distribution(layers).filter("slice_type = 'eMBB'").collect()]
    assert labels == ["Excellent", "Good", "Fair", "Poor"]
    newest = [row.event_timestamp for row in quality.latest_events(layers).collect()]
    assert newest == sorted(newest, reverse=True)


def test_shares_of_a_slice_sum_to_all(layers):
    shares = network.signal_class_distribution(layers).groupBy("slice_type").agg(F.sum("pct_of_slice").alias("pct"))
    assert shares.filter("abs(pct - 100) > 0.05").count() == 0


def test_parse_failures_find_the_planted_defects(layers):
    found = {row.column_name: (row.failed, row.total) for row in quality.parse_failures(layers).collect()}
    events = layers.bronze.count()
    assert found["rsrp_dbm"] == (layers.bronze.filter("rsrp_dbm = 'n/a'").count(), events)
    assert found["event_timestamp"][0] == layers.bronze.filter("event_timestamp = 'bad'").count()
    assert sum(failed for name, (failed, _) in found.items() if name not in ("rsrp_dbm", "event_timestamp")) == 0


def test_expectations_count_what_breaks_them(spark, layers):
    broken = layers.silver.limit(10).withColumns(
        {"cqi": F.lit(16), "ue_id": F.lit(""), "gnb_id": F.lit(None).cast("string"), "latency_ms": F.lit(float("nan")),
         "rsrp_dbm": F.lit(None).cast("double")}
    )
    found = {row.rule: (row.failed, row.total) for row in quality.range_expectations(type(layers)({"silver": lambda: broken})).collect()}
    assert found["cqi_in_range"] == found["ue_id_not_empty"] == found["gnb_id_not_empty"] == (10, 10)
    assert found["latency_ms_positive"] == (10, 10)
    assert found["rsrp_dbm_in_range"] == (0, 0) and found["mcs_index_in_range"] == (0, 10)


def test_audit_totals_end_at_all_events(layers):
    audit = quality.ingest_audit(layers).collect()
    assert audit[-1].total_events == layers.bronze.count() == sum(row.events for row in audit)
    assert audit[0].minute is None and audit[0].events_per_sec is None
