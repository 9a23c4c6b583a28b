"""SQL forms of the two scalar functions, for users who write SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ranlens.functions.sla import Limits
from ranlens.settings import SIGNAL_CLASS_FLOORS, SLA_LIMITS, SLA_RULES


def register_functions(spark: SparkSession, limits: Limits = SLA_LIMITS) -> None:
    """Create the temporary SQL functions ``signal_quality`` and ``breaches_sla``.

    They are SQL expressions that the optimizer inlines; no Python runs per row.
    """
    floors = " ".join(f"WHEN rsrp >= {floor}D THEN '{name}'" for name, floor in SIGNAL_CLASS_FLOORS)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION signal_quality(rsrp DOUBLE) RETURNS STRING
        RETURN CASE WHEN rsrp IS NULL THEN 'Unknown' WHEN isnan(rsrp) THEN 'Poor' {floors} ELSE 'Poor' END"""
    )
    argument = {rule.kpi: rule.kpi.rsplit("_", 1)[0] for rule in SLA_RULES}
    cases = []
    for name, own in limits.items():
        checks = [
            f"{argument[rule.kpi]} < {own[rule.kpi]}D"
            if rule.bound == "min"
            else f"({argument[rule.kpi]} > {own[rule.kpi]}D AND NOT isnan({argument[rule.kpi]}))"
            for rule in SLA_RULES
            if rule.kpi in own
        ]
        slice_name = name.replace("\\", "\\\\").replace("'", "\\'")
        cases.append(f"WHEN slice = '{slice_name}' THEN coalesce({' OR '.join(checks) or 'false'}, false)")
    parameters = ", ".join(f"{argument[rule.kpi]} DOUBLE" for rule in SLA_RULES)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION breaches_sla(slice STRING, {parameters}) RETURNS BOOLEAN
        RETURN CASE WHEN slice IS NULL THEN false {' '.join(cases)} ELSE false END"""
    )
