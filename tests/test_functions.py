import pytest
from pyspark.sql import functions as F

from ranlens.functions.bands import alert_flag, kpi_band
from ranlens.functions.signal import anomaly_proxy_type, load_status, signal_class_order, signal_quality_class, signal_score
from ranlens.functions.sla import limits_table, sla_breach
from ranlens.functions.sql import register_functions
from ranlens.operators.violations import with_table_breach
from ranlens.settings import ALERTS, KPI_BANDS, SIGNAL_CLASS_FLOORS, SLA_LIMITS, SLA_RULES

NAN = float("nan")

def signal_cases():
    """Each class floor, just under it, and between it and the next; nothing and no number."""
    floors = [*SIGNAL_CLASS_FLOORS, ("Poor", SIGNAL_CLASS_FLOORS[-1][1] - 40)]
    cases = [(None, "Unknown"), (NAN, "Poor"), (floors[0][1] + 30, floors[0][0])]
    for (name, floor), (lower, _) in zip(floors, floors[1:]):
        cases += [(floor, name), (floor - 0.001, lower), (floor - 5, lower)]
    return cases


def breach_cases():
    """For each slice and KPI: at the limit, just inside and just outside it, missing and no number; the rest is fine or missing."""
    kpis = [rule.kpi for rule in SLA_RULES]
    cases = []
    for name, limits in SLA_LIMITS.items():
        fine = {rule.kpi: limits[rule.kpi] * (2 if rule.bound == "min" else 0.5) for rule in SLA_RULES}
        for rest in (fine, dict.fromkeys(kpis), limits, dict.fromkeys(kpis, NAN)):
            cases.append((name, *(rest[k] for k in kpis), False))
            for rule in SLA_RULES:
                inward = 1.001 if rule.bound == "min" else 0.999
                values = {1.0: False, inward: False, 2 - inward: True}
                judged = [(limits[rule.kpi] * by, bad) for by, bad in values.items()] + [(None, False), (NAN, False)]
                cases += [(name, *(v if k == rule.kpi else rest[k] for k in kpis), bad) for v, bad in judged]
    worst = tuple(0.0 if rule.bound == "min" else 1e6 for rule in SLA_RULES)
    return cases + [(slice_type, *worst, False) for slice_type in ("Unknown", "", None)]


SIGNAL_CASES, SLA_CASES = signal_cases(), breach_cases()

SLA_COLUMNS = """slice_type string, dl_throughput_mbps double, ul_throughput_mbps double, latency_ms double,
    packet_loss_pct double, jitter_ms double, expected boolean"""


@pytest.fixture(scope="module")
def sla_cases(spark):
    return spark.createDataFrame(SLA_CASES, SLA_COLUMNS)


def test_signal_class_decision_table(spark):
    cases = spark.createDataFrame(SIGNAL_CASES, "rsrp_dbm double, expected string")
    assert cases.filter(~signal_quality_class().eqNullSafe(F.col("expected"))).count() == 0


def test_breach_decision_table(sla_cases):
    assert sla_cases.filter(~sla_breach().eqNullSafe(F.col("expected"))).count() == 0


def test_breach_by_limits_table_agrees(spark, sla_cases):
    judged = with_table_breach(sla_cases, limits_table(spark))
    assert judged.count() == len(SLA_CASES)
    assert judged.filter("NOT (sla_breach <=> expected)").count() == 0


def test_sql_functions_agree(spark, sla_cases):
    register_functions(spark)
    sla_cases.createOrReplaceTempView("sla_cases")
    wrong = spark.sql(
        """SELECT * FROM sla_cases WHERE NOT (expected <=> breaches_sla(slice_type, dl_throughput_mbps,
        ul_throughput_mbps, latency_ms, packet_loss_pct, jitter_ms))"""
    )
    assert wrong.count() == 0
    spark.createDataFrame(SIGNAL_CASES, "rsrp double, expected string").createOrReplaceTempView("signal_cases")
    assert spark.sql("SELECT * FROM signal_cases WHERE NOT (expected <=> signal_quality(rsrp))").count() == 0


def test_scores_and_order(spark):
    labels = spark.createDataFrame([("Excellent",), ("Good",), ("Fair",), ("Poor",), ("Unknown",), (None,)], "label string")
    found = labels.select("label", signal_score(F.col("label")), signal_class_order(F.col("label"))).collect()
    assert [tuple(row) for row in found] == [
        ("Excellent", 4, 1), ("Good", 3, 2), ("Fair", 2, 3), ("Poor", 1, 4), ("Unknown", 0, 5), (None, 0, 5),
    ]


def test_load_status(spark):
    cases = spark.createDataFrame(
        [(85.0, "Congested"), (84.9, "High Load"), (60.0, "High Load"), (30.0, "Normal"), (29.9, "Low Load"), (None, "Low Load")],
        "rb double, expected string",
    )
    assert cases.filter(load_status(F.col("rb")) != F.col("expected")).count() == 0


def test_anomaly_proxy_takes_the_first_match(spark):
    cases = spark.createDataFrame(
        [
            (-1.0, -111.0, 500.0, 99.0, "Interference"),
            (-1.0, -110.0, 500.0, 99.0, "Handover / Backhaul"),
            (5.0, -111.0, 100.0, 85.1, "Cell Congestion"),
            (5.0, -80.0, 1.0, 85.0, "Other"),
            (None, None, None, None, "Other"),
        ],
        "sinr_db double, rsrp_dbm double, latency_ms double, rb_utilization_pct double, expected string",
    )
    assert cases.filter(anomaly_proxy_type() != F.col("expected")).count() == 0


@pytest.mark.parametrize(
    ("kpi", "slice_type", "cases"),
    [
        ("rsrp_dbm", None, [(-80.0, "Good"), (-80.1, "Fair"), (-100.0, "Fair"), (-100.1, "Poor"), (None, None), (NAN, None)]),
        ("cqi", None, [(10.0, "Good"), (9.0, "Fair"), (5.0, "Fair"), (4.0, "Poor")]),
        ("dl_throughput_mbps", "eMBB", [(200.0, "Good"), (50.0, "Fair"), (49.9, "Poor")]),
        ("dl_throughput_mbps", "mMTC", [(200.0, None)]),
        ("latency_ms", "URLLC", [(0.5, "Good"), (1.0, "Fair"), (1.1, "Poor"), (NAN, None)]),
        ("latency_ms", "eMBB", [(0.5, None)]),
        ("bler_pct", None, [(2.0, "Good"), (10.0, "Fair"), (10.1, "Poor")]),
        ("rb_utilization_pct", None, [(60.0, "Good"), (85.0, "Fair"), (85.1, "Poor")]),
    ],
)
def test_bands(spark, kpi, slice_type, cases):
    band = next(band for band in KPI_BANDS if band.kpi == kpi)
    data = spark.createDataFrame(cases, f"{kpi} double, expected string").withColumn("slice_type", F.lit(slice_type))
    assert data.filter(~kpi_band(band).eqNullSafe(F.col("expected"))).count() == 0


def test_alerts_are_strict_and_ignore_nan(spark):
    for name, (kpi, side, limit) in ALERTS.items():
        step = -0.1 if side == "below" else 0.1
        data = spark.createDataFrame([(limit, False), (limit + step, True), (NAN, False), (None, None)], f"{kpi} double, expected boolean")
        assert data.filter(~alert_flag(name).eqNullSafe(F.col("expected"))).count() == 0
