"""DuckDB SQL for every registered query, over the same event log.

The statements build the layers as common table expressions from ``events`` and
use nothing of the library, so they check it independently. ``as_of`` is the
newest event time, and a violation counts as detected when its event happened.
"""

from __future__ import annotations

import re

BASE = """
log AS (
  SELECT event_id AS e, user_id AS u, event_type AS kind,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
         make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 720) AS happened
  FROM events
),
hashed AS (
  SELECT *, (e * 7919 + u * 104729 + k * 31) % 1000003 AS h, k % 20 AS c,
         (kind = 'error' AND e % 4 = 1) OR e % 20 = 0 AS is_anomaly,
         ['LON', 'MAN', 'BIR', 'LEE', 'GLA'][k % 20 % 5 + 1] AS city,
         CASE kind WHEN 'view' THEN 'eMBB' WHEN 'click' THEN 'URLLC' WHEN 'purchase' THEN 'mMTC'
           WHEN 'error' THEN ['eMBB', 'URLLC', 'mMTC'][e % 3 + 1]
           ELSE CASE WHEN e % 2 = 0 THEN NULL ELSE 'Unknown' END END AS slice_type
  FROM log
),
mapped AS (
  SELECT e, happened, is_anomaly, slice_type,
    'GNB-' || city || '-' || lpad(CAST(c // 5 + 1 AS VARCHAR), 3, '0') AS gnb_id,
    'CELL-' || city || '-' || lpad(CAST(c AS VARCHAR), 3, '0') AS cell_id,
    CASE WHEN e % 389 <> 0 THEN 'UE-' || lpad(CAST(u AS VARCHAR), 5, '0') END AS ue_id,
    CASE slice_type WHEN 'eMBB' THEN 'S1' WHEN 'URLLC' THEN 'S2' WHEN 'mMTC' THEN 'S3' END AS slice_id,
    CASE WHEN e % 97 <> 0 THEN (h % 961 - 1400) / 10.0::DOUBLE END AS rsrp_dbm,
    (h * 41 % 166 - 195) / 10.0::DOUBLE AS rsrq_db,
    (h * 13 % 631 - 230) / 10.0::DOUBLE AS sinr_db,
    CAST(h * 43 % 16 AS INTEGER) AS cqi,
    CASE slice_type WHEN 'URLLC' THEN 900 + h * 17 % 3000 WHEN 'mMTC' THEN 80 + h * 17 % 400
      ELSE 8000 + h * 17 % 40000 END / 100.0::DOUBLE AS dl_throughput_mbps,
    CASE slice_type WHEN 'URLLC' THEN 450 + h * 19 % 1000 WHEN 'mMTC' THEN 45 + h * 19 % 100
      ELSE 1800 + h * 19 % 8000 END / 100.0::DOUBLE AS ul_throughput_mbps,
    CASE WHEN is_anomaly AND e % 8 <> 5 THEN (5000 + h * 23 % 45000) / 100.0::DOUBLE
      WHEN slice_type = 'URLLC' THEN (100 + h * 23 % 1000) / 1000.0::DOUBLE
      WHEN slice_type = 'mMTC' THEN (1000 + h * 23 % 10000) / 100.0::DOUBLE
      ELSE (100 + h * 23 % 1000) / 100.0::DOUBLE END AS latency_ms,
    CASE slice_type WHEN 'URLLC' THEN h * 29 % 550 WHEN 'mMTC' THEN h * 29 % 55000
      ELSE h * 29 % 5500 END / 1000.0::DOUBLE AS jitter_ms,
    CASE slice_type WHEN 'URLLC' THEN (h * 31 % 1100) / 1000000.0::DOUBLE
      WHEN 'mMTC' THEN (h * 31 % 11000) / 10000.0::DOUBLE
      ELSE (h * 31 % 1100) / 10000.0::DOUBLE END AS packet_loss_pct,
    CAST(h * 47 % 29 AS INTEGER) AS mcs_index,
    (h * 53 % 501) / 10.0::DOUBLE AS bler_pct,
    (h * 37 % 1001) / 10.0::DOUBLE AS rb_utilization_pct,
    (490000 + h * 61 % 120001) / 10000.0::DOUBLE AS latitude,
    (h * 59 % 100001 - 80000) / 10000.0::DOUBLE AS longitude,
    CAST(h % 3 AS INTEGER) AS handover_count
  FROM hashed
)"""

BRONZE = BASE + """,
bronze AS (
  SELECT CAST(e AS VARCHAR) AS event_id,
    CASE WHEN e % 211 = 0 THEN 'bad' ELSE strftime(happened, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS event_timestamp,
    gnb_id, cell_id, ue_id, slice_id, slice_type,
    CASE WHEN e % 97 = 0 THEN 'n/a' ELSE CAST(CAST(rsrp_dbm AS DECIMAL(12,6)) AS VARCHAR) END AS rsrp_dbm,
    CAST(CAST(rsrq_db AS DECIMAL(12,6)) AS VARCHAR) AS rsrq_db,
    CAST(CAST(sinr_db AS DECIMAL(12,6)) AS VARCHAR) AS sinr_db,
    CAST(cqi AS VARCHAR) AS cqi,
    CAST(CAST(dl_throughput_mbps AS DECIMAL(12,6)) AS VARCHAR) AS dl_throughput_mbps,
    CAST(CAST(ul_throughput_mbps AS DECIMAL(12,6)) AS VARCHAR) AS ul_throughput_mbps,
    CAST(CAST(latency_ms AS DECIMAL(12,6)) AS VARCHAR) AS latency_ms,
    CAST(CAST(jitter_ms AS DECIMAL(12,6)) AS VARCHAR) AS jitter_ms,
    CAST(CAST(packet_loss_pct AS DECIMAL(12,6)) AS VARCHAR) AS packet_loss_pct,
    CAST(mcs_index AS VARCHAR) AS mcs_index,
    CAST(CAST(bler_pct AS DECIMAL(12,6)) AS VARCHAR) AS bler_pct,
    CAST(CAST(rb_utilization_pct AS DECIMAL(12,6)) AS VARCHAR) AS rb_utilization_pct,
    CAST(CAST(latitude AS DECIMAL(12,6)) AS VARCHAR) AS latitude,
    CAST(CAST(longitude AS DECIMAL(12,6)) AS VARCHAR) AS longitude,
    CAST(handover_count AS VARCHAR) AS handover_count,
    CAST(is_anomaly AS VARCHAR) AS is_anomaly
  FROM mapped
)"""

SILVER = BASE + """,
silver AS (
  SELECT CAST(e AS VARCHAR) AS event_id, happened AS event_timestamp, gnb_id, cell_id, ue_id, slice_id, slice_type,
    rsrp_dbm, rsrq_db, sinr_db, cqi, dl_throughput_mbps, ul_throughput_mbps, latency_ms, jitter_ms,
    packet_loss_pct, mcs_index, bler_pct, rb_utilization_pct, latitude, longitude, handover_count, is_anomaly,
    CASE WHEN rsrp_dbm IS NULL THEN 'Unknown' WHEN rsrp_dbm >= -80 THEN 'Excellent'
      WHEN rsrp_dbm >= -90 THEN 'Good' WHEN rsrp_dbm >= -100 THEN 'Fair' ELSE 'Poor' END AS signal_quality_class,
    COALESCE(
      (slice_type = 'eMBB' AND (dl_throughput_mbps < 100 OR ul_throughput_mbps < 20 OR latency_ms > 10
        OR packet_loss_pct > 0.1::DOUBLE OR jitter_ms > 5))
      OR (slice_type = 'URLLC' AND (dl_throughput_mbps < 10 OR ul_throughput_mbps < 5 OR latency_ms > 1
        OR packet_loss_pct > 0.001::DOUBLE OR jitter_ms > 0.5::DOUBLE))
      OR (slice_type = 'mMTC' AND (dl_throughput_mbps < 1 OR ul_throughput_mbps < 0.5::DOUBLE OR latency_ms > 100
        OR packet_loss_pct > 1 OR jitter_ms > 50)), FALSE) AS sla_breach
  FROM mapped WHERE e % 211 <> 0 AND e % 389 <> 0
)"""

LIMITS = """
limits(slice_type, violation_type, kpi_name, severity, threshold_value) AS (VALUES
  ('eMBB', 'LOW_DL_THROUGHPUT', 'dl_throughput_mbps', 'WARNING', 100.0::DOUBLE),
  ('eMBB', 'LOW_UL_THROUGHPUT', 'ul_throughput_mbps', 'WARNING', 20.0::DOUBLE),
  ('eMBB', 'HIGH_LATENCY', 'latency_ms', 'CRITICAL', 10.0::DOUBLE),
  ('eMBB', 'HIGH_PACKET_LOSS', 'packet_loss_pct', 'CRITICAL', 0.1::DOUBLE),
  ('eMBB', 'HIGH_JITTER', 'jitter_ms', 'WARNING', 5.0::DOUBLE),
  ('URLLC', 'LOW_DL_THROUGHPUT', 'dl_throughput_mbps', 'WARNING', 10.0::DOUBLE),
  ('URLLC', 'LOW_UL_THROUGHPUT', 'ul_throughput_mbps', 'WARNING', 5.0::DOUBLE),
  ('URLLC', 'HIGH_LATENCY', 'latency_ms', 'CRITICAL', 1.0::DOUBLE),
  ('URLLC', 'HIGH_PACKET_LOSS', 'packet_loss_pct', 'CRITICAL', 0.001::DOUBLE),
  ('URLLC', 'HIGH_JITTER', 'jitter_ms', 'WARNING', 0.5::DOUBLE),
  ('mMTC', 'LOW_DL_THROUGHPUT', 'dl_throughput_mbps', 'WARNING', 1.0::DOUBLE),
  ('mMTC', 'LOW_UL_THROUGHPUT', 'ul_throughput_mbps', 'WARNING', 0.5::DOUBLE),
  ('mMTC', 'HIGH_LATENCY', 'latency_ms', 'CRITICAL', 100.0::DOUBLE),
  ('mMTC', 'HIGH_PACKET_LOSS', 'packet_loss_pct', 'CRITICAL', 1.0::DOUBLE),
  ('mMTC', 'HIGH_JITTER', 'jitter_ms', 'WARNING', 50.0::DOUBLE)
)"""

VIOLATIONS = SILVER + "," + LIMITS + """,
measured AS (
  SELECT s.event_id, s.event_timestamp, s.cell_id, s.ue_id, s.slice_id, s.slice_type,
    l.violation_type, l.kpi_name,
    CASE l.kpi_name WHEN 'dl_throughput_mbps' THEN s.dl_throughput_mbps WHEN 'ul_throughput_mbps' THEN s.ul_throughput_mbps
      WHEN 'latency_ms' THEN s.latency_ms WHEN 'packet_loss_pct' THEN s.packet_loss_pct ELSE s.jitter_ms END AS kpi_value,
    l.threshold_value, l.severity
  FROM silver s JOIN limits l ON s.slice_type = l.slice_type
),
violations AS (
  SELECT * FROM measured
  WHERE CASE WHEN violation_type LIKE 'LOW%' THEN kpi_value < threshold_value ELSE kpi_value > threshold_value END
)"""

WINDOWED = SILVER + """,
windowed AS (
  SELECT time_bucket(INTERVAL 30 SECOND, event_timestamp) - o.n * INTERVAL 30 SECOND AS window_start, s.*
  FROM silver s CROSS JOIN (VALUES (0), (1)) o(n)
)"""

CELLS = WINDOWED + """,
cells AS (
  SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, cell_id, gnb_id,
    avg(rsrp_dbm) AS avg_rsrp_dbm, avg(rsrq_db) AS avg_rsrq_db, avg(sinr_db) AS avg_sinr_db, avg(cqi) AS avg_cqi,
    avg(dl_throughput_mbps) AS avg_dl_throughput_mbps, avg(ul_throughput_mbps) AS avg_ul_throughput_mbps,
    quantile_disc(dl_throughput_mbps, 0.95) AS p95_dl_throughput_mbps,
    avg(latency_ms) AS avg_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms,
    avg(jitter_ms) AS avg_jitter_ms, avg(packet_loss_pct) AS avg_packet_loss_pct, avg(bler_pct) AS avg_bler_pct,
    avg(rb_utilization_pct) AS avg_rb_utilization_pct,
    count(*) AS event_count, count(DISTINCT ue_id) AS unique_ues,
    CAST(sum(CAST(sla_breach AS INTEGER)) AS BIGINT) AS sla_breach_count,
    CAST(sum(CAST(is_anomaly AS INTEGER)) AS BIGINT) AS anomaly_count
  FROM windowed GROUP BY ALL
)"""

SLICES = WINDOWED + """,
slices AS (
  SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, slice_id, slice_type,
    avg(dl_throughput_mbps) AS avg_dl_throughput_mbps, avg(ul_throughput_mbps) AS avg_ul_throughput_mbps,
    avg(latency_ms) AS avg_latency_ms, quantile_disc(latency_ms, 0.99) AS p99_latency_ms,
    avg(packet_loss_pct) AS avg_packet_loss_pct, avg(jitter_ms) AS avg_jitter_ms,
    count(*) AS event_count, count(DISTINCT ue_id) AS unique_ues,
    CAST(sum(CAST(sla_breach AS INTEGER)) AS BIGINT) AS sla_breach_count,
    round((1.0::DOUBLE - sum(CAST(sla_breach AS INTEGER)) / count(*)) * 100.0::DOUBLE, 2) AS sla_compliance_pct
  FROM windowed GROUP BY ALL
)"""

# Averages of a window are compared at nine digits. Engines add in different orders; the
# inner rounding removes that noise, so that a tie is the same tie on both sides.
CELL_COLUMNS = """window_start, window_end, cell_id, gnb_id,
  round(round(avg_rsrp_dbm, 12), 9) AS avg_rsrp_dbm, round(round(avg_rsrq_db, 12), 9) AS avg_rsrq_db, round(round(avg_sinr_db, 12), 9) AS avg_sinr_db,
  round(round(avg_cqi, 12), 9) AS avg_cqi, round(round(avg_dl_throughput_mbps, 12), 9) AS avg_dl_throughput_mbps,
  round(round(avg_ul_throughput_mbps, 12), 9) AS avg_ul_throughput_mbps, p95_dl_throughput_mbps,
  round(round(avg_latency_ms, 12), 9) AS avg_latency_ms, p95_latency_ms, round(round(avg_jitter_ms, 12), 9) AS avg_jitter_ms,
  round(round(avg_packet_loss_pct, 12), 9) AS avg_packet_loss_pct, round(round(avg_bler_pct, 12), 9) AS avg_bler_pct,
  round(round(avg_rb_utilization_pct, 12), 9) AS avg_rb_utilization_pct, event_count, unique_ues, sla_breach_count, anomaly_count"""

SLICE_COLUMNS = """window_start, window_end, slice_id, slice_type,
  round(round(avg_dl_throughput_mbps, 12), 9) AS avg_dl_throughput_mbps, round(round(avg_ul_throughput_mbps, 12), 9) AS avg_ul_throughput_mbps,
  round(round(avg_latency_ms, 12), 9) AS avg_latency_ms, p99_latency_ms, round(round(avg_packet_loss_pct, 12), 9) AS avg_packet_loss_pct,
  round(round(avg_jitter_ms, 12), 9) AS avg_jitter_ms, event_count, unique_ues, sla_breach_count, sla_compliance_pct"""

CLOSED = "window_end <= (SELECT max(event_timestamp) FROM silver) - INTERVAL 30 SECOND"


def half_up(sql: str) -> str:
    """Write each ``round(x, n)`` as rounding the decimal text of ``x`` half up.

    That is how the reports are defined. DuckDB rounds a double after scaling it,
    which turns values just below a tie, such as 176.92499999999998, into ties.
    """
    start = sql.find("round(")
    if start < 0:
        return sql
    depth, comma, end = 0, 0, start + len("round")
    for end in range(start + len("round"), len(sql)):
        depth += (sql[end] == "(") - (sql[end] == ")")
        if sql[end] == "," and depth == 1:
            comma = end
        if depth == 0:
            break
    value, digits = sql[start + len("round("):comma], sql[comma + 1:end].strip()
    exact = f"CAST(CAST({half_up(value)} AS VARCHAR) AS DECIMAL(38, 20))"
    places = f"CAST(CAST({exact} AS DECIMAL(38, {digits})) AS VARCHAR)"
    return f"{sql[:start]}CAST({places} AS DOUBLE){half_up(sql[end + 1:])}"


# Reports of percentiles at one digit over values of one digit: every second median is a tie, which the
# last bit of the interpolation turns. All others are checked with quantile_cont as it is.
TIES = ("signal_percentiles",)


def interpolated(sql: str) -> str:
    """Write ``quantile_cont`` as the weighted mean of the two neighbouring values.

    The weights are applied as the reports define them; another order of the same
    operations may differ in the last bit, and on a value near a tie in the report.
    """

    def weighted(match: re.Match) -> str:
        x, p = match.groups()
        at = f"({p}::DOUBLE * (count({x}) - 1))"
        low, high = (f"list({x} ORDER BY {x})[CAST({side}({at}) AS BIGINT) + 1]" for side in ("floor", "ceil"))
        between = f"(ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high}"
        return f"CASE WHEN {low} = {high} THEN {low} ELSE {between} END"

    return re.sub(r"quantile_cont\((\w+), ([\d.]+)\)", weighted, sql)


def _since(interval: str, column: str = "event_timestamp") -> str:
    return f"{column} >= (SELECT max(event_timestamp) FROM silver) - INTERVAL {interval}"


def _flags(flag: str) -> str:
    return f"CAST(sum(CAST({flag} AS INTEGER)) AS BIGINT)"


def _share(flag: str, digits: int = 2) -> str:
    return f"round(sum(CAST({flag} AS INTEGER)) * 100.0::DOUBLE / count(*), {digits})"


def _compliance() -> str:
    return "round((1 - sum(CAST(sla_breach AS INTEGER)) / count(*)) * 100, 2)"


def _band_counts() -> str:
    bands = [  # fixed values: KPI, comparison of the better side, edge of Good, edge of Fair, slice condition
        ("rsrp_dbm", ">=", -80, -100, "TRUE"),
        ("rsrq_db", ">=", -10, -15, "TRUE"),
        ("sinr_db", ">=", 10, 0, "TRUE"),
        ("cqi", ">=", 10, 5, "TRUE"),
        ("dl_throughput_mbps", ">=", 200, 50, "slice_type = 'eMBB'"),
        ("latency_ms", "<=", 0.5, 1.0, "slice_type = 'URLLC'"),
        ("bler_pct", "<=", 2, 10, "TRUE"),
        ("rb_utilization_pct", "<=", 60, 85, "TRUE"),
    ]
    parts = [
        f"""SELECT slice_type, '{kpi}' AS kpi,
        CASE WHEN {kpi} {better} {good} THEN 'Good' WHEN {kpi} {better} {fair} THEN 'Fair' ELSE 'Poor' END AS band
        FROM silver WHERE {kpi} IS NOT NULL AND {condition}"""
        for kpi, better, good, fair, condition in bands
    ]
    return f"SELECT slice_type, kpi, band, count(*) AS event_count FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _expectations() -> str:
    rules = {
        "rsrp_dbm_in_range": ("rsrp_dbm", "rsrp_dbm BETWEEN -140 AND -44"),
        "cqi_in_range": ("cqi", "cqi BETWEEN 0 AND 15"),
        "mcs_index_in_range": ("mcs_index", "mcs_index BETWEEN 0 AND 28"),
        "rb_utilization_pct_in_range": ("rb_utilization_pct", "rb_utilization_pct BETWEEN 0 AND 100"),
        "latitude_in_range": ("latitude", "latitude BETWEEN 49 AND 61"),
        "longitude_in_range": ("longitude", "longitude BETWEEN -8 AND 2"),
        "dl_throughput_mbps_positive": ("dl_throughput_mbps", "dl_throughput_mbps > 0"),
        "ul_throughput_mbps_positive": ("ul_throughput_mbps", "ul_throughput_mbps > 0"),
        "latency_ms_positive": ("latency_ms", "latency_ms > 0"),
        "packet_loss_pct_not_negative": ("packet_loss_pct", "packet_loss_pct >= 0"),
        "event_id_not_empty": ("1", "coalesce(event_id, '') <> ''"),
        "gnb_id_not_empty": ("1", "coalesce(gnb_id, '') <> ''"),
        "cell_id_not_empty": ("1", "coalesce(cell_id, '') <> ''"),
        "ue_id_not_empty": ("1", "coalesce(ue_id, '') <> ''"),
        "slice_type_known": ("slice_type", "slice_type IN ('eMBB', 'URLLC', 'mMTC')"),
        "slice_id_known": ("slice_id", "slice_id IN ('S1', 'S2', 'S3')"),
    }
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count({subject}) - count(CASE WHEN {ok} THEN 1 END) AS failed, "
        f"count({subject}) AS total FROM silver"
        for rule, (subject, ok) in rules.items()
    )


def _payload_failures() -> str:
    return """SELECT failure, count(*) AS payloads FROM (
      SELECT CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty'
        WHEN NOT json_valid(value) THEN CASE WHEN value LIKE '{%' THEN 'broken' ELSE 'no_object' END
        WHEN json_type(value) <> 'OBJECT' THEN 'no_object' END AS failure
      FROM (SELECT CASE WHEN e % 101 = 0 THEN left(whole, length(whole) - 3) WHEN e % 103 = 0 THEN '[' || whole || ']'
          WHEN e % 107 = 0 THEN ' ' WHEN e % 113 = 0 THEN '17' WHEN e % 109 <> 0 THEN whole END AS value
        FROM (SELECT event_id::BIGINT AS e, to_json(bronze)::VARCHAR AS whole FROM bronze)))
    WHERE failure IS NOT NULL GROUP BY failure ORDER BY failure"""


def _parse_failures() -> str:
    kinds = dict.fromkeys(
        ["rsrp_dbm", "rsrq_db", "sinr_db", "dl_throughput_mbps", "ul_throughput_mbps", "latency_ms", "jitter_ms",
         "packet_loss_pct", "bler_pct", "rb_utilization_pct", "latitude", "longitude"], "DOUBLE",
    ) | dict.fromkeys(["cqi", "mcs_index", "handover_count"], "INTEGER")
    kinds |= {"is_anomaly": "BOOLEAN", "event_timestamp": "TIMESTAMP"}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, count({name}) - count(TRY_CAST({name} AS {kind})) AS failed, "
        f"count({name}) AS total FROM bronze"
        for name, kind in kinds.items()
    )


#: Reports that are also made from the minute roll-up.
ROLLED_UP = ("event_rate_recent", "sla_scorecard", "cell_signal_quality", "anomaly_rate_recent", "rb_utilisation", "breach_leaderboard")


def statements() -> dict[str, str]:
    """Query name to SQL."""
    cells, slices = f"SELECT {CELL_COLUMNS} FROM cells", f"SELECT {SLICE_COLUMNS} FROM slices"
    body: dict[str, tuple[str, str]] = {
        "silver_events": (SILVER, "SELECT * FROM silver"),
        "sla_breach_flag": (SILVER, "SELECT event_id, slice_type, sla_breach FROM silver"),
        "cell_kpis": (CELLS, cells),
        "slice_kpis": (SLICES, slices),
        "sla_violations": (VIOLATIONS, "SELECT * FROM violations"),
        "network_overview": (SILVER, """SELECT slice_type, count(*) AS total_events,
            round(avg(CAST(is_anomaly AS INTEGER)) * 100, 2) AS anomaly_rate_pct,
            count(DISTINCT cell_id) AS unique_cells, count(DISTINCT ue_id) AS unique_ues,
            min(event_timestamp) AS earliest_event, max(event_timestamp) AS latest_event
            FROM silver GROUP BY slice_type"""),
        "events_per_minute": (SILVER, """SELECT date_trunc('minute', event_timestamp) AS event_minute, slice_type,
            count(*) AS events FROM silver GROUP BY ALL"""),
        "signal_class_distribution": (SILVER, """SELECT slice_type, signal_quality_class, count(*) AS event_count,
            round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY slice_type), 2) AS pct_of_slice
            FROM silver WHERE rsrp_dbm IS NOT NULL GROUP BY slice_type, signal_quality_class"""),
        "signal_percentiles": (SILVER, """SELECT slice_type, round(min(rsrp_dbm), 1) AS rsrp_min,
            round(quantile_cont(rsrp_dbm, 0.25), 1) AS rsrp_p25, round(quantile_cont(rsrp_dbm, 0.5), 1) AS rsrp_p50,
            round(quantile_cont(rsrp_dbm, 0.75), 1) AS rsrp_p75, round(max(rsrp_dbm), 1) AS rsrp_max,
            round(quantile_cont(sinr_db, 0.5), 1) AS sinr_p50, round(quantile_cont(sinr_db, 0.05), 1) AS sinr_p5_worst
            FROM silver WHERE rsrp_dbm IS NOT NULL AND sinr_db IS NOT NULL GROUP BY slice_type"""),
        "throughput_by_slice": (SILVER, """SELECT slice_type, round(avg(dl_throughput_mbps), 2) AS avg_dl_mbps,
            round(quantile_cont(dl_throughput_mbps, 0.5), 2) AS p50_dl_mbps,
            round(quantile_cont(dl_throughput_mbps, 0.95), 2) AS p95_dl_mbps,
            round(avg(ul_throughput_mbps), 2) AS avg_ul_mbps,
            round(quantile_cont(ul_throughput_mbps, 0.95), 2) AS p95_ul_mbps
            FROM silver WHERE dl_throughput_mbps IS NOT NULL GROUP BY slice_type"""),
        "throughput_trend": (SLICES, """SELECT window_start, slice_type, round(avg_dl_throughput_mbps, 2) AS avg_dl_mbps,
            round(avg_ul_throughput_mbps, 2) AS avg_ul_mbps, event_count FROM slices"""),
        "latency_by_slice": (SILVER, """SELECT slice_type, round(quantile_cont(latency_ms, 0.5), 3) AS p50_latency_ms,
            round(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms,
            round(quantile_cont(latency_ms, 0.99), 3) AS p99_latency_ms, round(max(latency_ms), 3) AS max_latency_ms,
            round(avg(jitter_ms), 3) AS avg_jitter_ms, round(avg(packet_loss_pct), 5) AS avg_packet_loss_pct
            FROM silver WHERE latency_ms IS NOT NULL GROUP BY slice_type"""),
        "latency_trend_top": (CELLS, """SELECT window_start, cell_id, round(avg_latency_ms, 2) AS avg_latency_ms,
            round(p95_latency_ms, 2) AS p95_latency_ms, event_count FROM cells
            ORDER BY window_start, round(cells.avg_latency_ms, 2) DESC, cell_id, gnb_id LIMIT 200"""),
        "latest_cell_kpis": (CELLS, """SELECT c.cell_id, gnb_id, round(avg_rsrp_dbm, 1) AS rsrp_dbm,
            round(avg_sinr_db, 1) AS sinr_db, round(avg_dl_throughput_mbps, 1) AS dl_mbps,
            round(avg_latency_ms, 2) AS latency_ms, round(avg_rb_utilization_pct, 1) AS rb_util_pct,
            event_count, unique_ues, sla_breach_count, anomaly_count
            FROM cells c JOIN (SELECT cell_id, max(window_end) AS newest FROM cells GROUP BY cell_id) n
            ON c.cell_id = n.cell_id AND c.window_end = n.newest"""),
        "sla_compliance": (SILVER, f"""SELECT slice_type, count(*) AS total_events, {_flags('sla_breach')} AS sla_breaches,
            {_compliance()} AS compliance_pct FROM silver WHERE slice_type IS NOT NULL GROUP BY slice_type"""),
        "sla_compliance_trend": (SLICES, """SELECT window_start, slice_type, sla_compliance_pct, sla_breach_count,
            event_count FROM slices"""),
        "violation_breakdown": (VIOLATIONS, """SELECT violation_type, severity, slice_type, count(*) AS violation_count,
            count(DISTINCT cell_id) AS affected_cells, count(DISTINCT ue_id) AS affected_ues,
            round(avg(kpi_value), 3) AS avg_kpi_value, round(avg(threshold_value), 3) AS threshold
            FROM violations GROUP BY violation_type, severity, slice_type"""),
        "violations_per_minute": (VIOLATIONS, """SELECT date_trunc('minute', event_timestamp) AS minute, violation_type,
            severity, count(*) AS violation_count FROM violations GROUP BY ALL"""),
        "worst_cells": (SILVER, f"""SELECT cell_id, gnb_id, count(*) AS total_events,
            round(avg(rsrp_dbm), 1) AS avg_rsrp_dbm, round(avg(sinr_db), 1) AS avg_sinr_db,
            round(avg(latency_ms), 2) AS avg_latency_ms, round(avg(rb_utilization_pct), 1) AS avg_rb_util_pct,
            {_flags('sla_breach')} AS sla_breaches, {_flags('is_anomaly')} AS anomaly_count,
            {_share('sla_breach')} AS breach_rate_pct FROM silver GROUP BY cell_id, gnb_id
            ORDER BY sla_breaches DESC, avg_rsrp_dbm, cell_id, gnb_id LIMIT 10"""),
        "anomaly_trend": (SILVER, f"""SELECT date_trunc('minute', event_timestamp) AS minute, slice_type,
            count(*) AS total_events, {_flags('is_anomaly')} AS anomaly_count, {_share('is_anomaly')} AS anomaly_rate_pct
            FROM silver GROUP BY ALL"""),
        "anomaly_proxy_breakdown": (SILVER, """SELECT CASE WHEN sinr_db < 0 AND rsrp_dbm < -110 THEN 'Interference'
            WHEN latency_ms > 100 THEN 'Handover / Backhaul' WHEN rb_utilization_pct > 85 THEN 'Cell Congestion'
            ELSE 'Other' END AS anomaly_proxy_type, slice_type, count(*) AS "count"
            FROM silver WHERE is_anomaly GROUP BY ALL"""),
        "total_events": (SILVER, "SELECT count(*) AS total_events FROM silver"),
        "event_rate_recent": (SILVER, f"""SELECT date_trunc('minute', event_timestamp) AS ts,
            count(*) AS events_per_minute FROM silver WHERE {_since('1 HOUR')} GROUP BY ALL"""),
        "sla_scorecard": (SILVER, f"""SELECT slice_type, {_compliance()} AS sla_compliance_pct FROM silver
            WHERE slice_type IS NOT NULL AND {_since('15 MINUTE')} GROUP BY slice_type"""),
        "throughput_recent": (SILVER, f"""SELECT slice_type, round(avg(dl_throughput_mbps), 2) AS avg_dl_mbps,
            round(quantile_cont(dl_throughput_mbps, 0.95), 2) AS p95_dl_mbps,
            round(avg(ul_throughput_mbps), 2) AS avg_ul_mbps,
            round(quantile_cont(ul_throughput_mbps, 0.95), 2) AS p95_ul_mbps
            FROM silver WHERE {_since('15 MINUTE')} GROUP BY slice_type"""),
        "latency_recent": (SILVER, f"""SELECT slice_type, round(quantile_cont(latency_ms, 0.5), 3) AS p50_ms,
            round(quantile_cont(latency_ms, 0.95), 3) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 3) AS p99_ms,
            round(max(latency_ms), 3) AS max_ms FROM silver WHERE {_since('15 MINUTE')} GROUP BY slice_type"""),
        "cell_signal_quality": (SILVER, f"""SELECT cell_id, gnb_id, round(avg(rsrp_dbm), 1) AS avg_rsrp_dbm,
            round(avg(sinr_db), 1) AS avg_sinr_db, round(avg(cqi), 2) AS avg_cqi,
            round(avg(CASE signal_quality_class WHEN 'Excellent' THEN 4 WHEN 'Good' THEN 3 WHEN 'Fair' THEN 2
              WHEN 'Poor' THEN 1 ELSE 0 END), 2) AS signal_score, count(*) AS event_count
            FROM silver WHERE {_since('15 MINUTE')} GROUP BY cell_id, gnb_id"""),
        "top_violations": (VIOLATIONS, f"""SELECT violation_type, severity, slice_type, count(*) AS violation_count,
            count(DISTINCT cell_id) AS cells_affected, count(DISTINCT ue_id) AS ues_affected,
            round(avg(kpi_value), 4) AS avg_kpi_value, round(max(kpi_value), 4) AS max_kpi_value,
            round(avg(threshold_value), 4) AS sla_threshold FROM violations WHERE {_since('15 MINUTE')}
            GROUP BY violation_type, severity, slice_type
            ORDER BY violation_count DESC, violation_type, severity, slice_type LIMIT 20"""),
        "anomaly_rate_recent": (SILVER, f"""SELECT date_trunc('minute', event_timestamp) AS ts,
            round(avg(CAST(is_anomaly AS INTEGER)) * 100, 2) AS anomaly_rate_pct, count(*) AS total_events,
            {_flags('is_anomaly')} AS anomaly_count FROM silver WHERE {_since('1 HOUR')} GROUP BY ALL"""),
        "rb_utilisation": (SILVER, f"""SELECT cell_id, round(avg(rb_utilization_pct), 1) AS avg_rb_util_pct,
            CASE WHEN avg(rb_utilization_pct) >= 85 THEN 'Congested' WHEN avg(rb_utilization_pct) >= 60 THEN 'High Load'
              WHEN avg(rb_utilization_pct) >= 30 THEN 'Normal' ELSE 'Low Load' END AS load_status
            FROM silver WHERE {_since('15 MINUTE')} GROUP BY cell_id
            ORDER BY avg_rb_util_pct DESC, cell_id LIMIT 20"""),
        "breach_leaderboard": (SILVER, f"""SELECT cell_id, gnb_id, {_flags('sla_breach')} AS breach_count,
            count(*) AS total_events, {_share('sla_breach', 1)} AS breach_rate_pct,
            round(avg(rsrp_dbm), 1) AS avg_rsrp_dbm, round(avg(latency_ms), 2) AS avg_latency_ms
            FROM silver WHERE {_since('30 MINUTE')} GROUP BY cell_id, gnb_id
            ORDER BY breach_count DESC, cell_id, gnb_id LIMIT 10"""),
        "urllc_latency_gauge": (SILVER, f"""SELECT 'URLLC' AS slice,
            round(quantile_cont(latency_ms, 0.99), 3) AS p99_latency_ms,
            round(quantile_cont(latency_ms, 0.95), 3) AS p95_latency_ms, round(avg(latency_ms), 3) AS avg_latency_ms,
            1.0::DOUBLE AS sla_target_ms, {_share('latency_ms > 1.0::DOUBLE')} AS pct_exceeding_sla
            FROM silver WHERE slice_type = 'URLLC' AND {_since('5 MINUTE')} AND latency_ms IS NOT NULL"""),
        "latest_events": (BRONZE, """SELECT * FROM bronze ORDER BY TRY_CAST(rtrim(event_timestamp, 'Z') AS TIMESTAMP) DESC NULLS LAST,
            event_timestamp DESC, event_id DESC LIMIT 20"""),
        "latest_events_by_text": (BRONZE, "SELECT * FROM bronze ORDER BY event_timestamp DESC, event_id DESC LIMIT 20"),
        "bronze_anomaly_breakdown": (BRONZE, """SELECT slice_type, is_anomaly, count(*) AS event_count FROM bronze
            GROUP BY ALL"""),
        "ingest_audit": (BRONZE, """SELECT minute, events, anomalies, total_events,
            round(total_events / (epoch(minute) - min(epoch(minute)) OVER () + 60), 2) AS events_per_sec
            FROM (SELECT minute, events, anomalies,
              CAST(sum(events) OVER (ORDER BY minute NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_events
              FROM (SELECT date_trunc('minute', TRY_CAST(rtrim(event_timestamp, 'Z') AS TIMESTAMP)) AS minute,
                count(*) AS events, count(*) FILTER (WHERE is_anomaly = 'true') AS anomalies FROM bronze GROUP BY 1))"""),
        "kpi_band_counts": (SILVER, _band_counts()),
        "alert_counts": (SILVER, """SELECT cell_id, count(*) AS total_events,
            count(*) FILTER (WHERE rsrp_dbm < -110) AS poor_rsrp, count(*) FILTER (WHERE rsrq_db < -15) AS poor_rsrq,
            count(*) FILTER (WHERE sinr_db < 0) AS poor_sinr, count(*) FILTER (WHERE bler_pct > 10) AS high_bler,
            count(*) FILTER (WHERE rb_utilization_pct > 85) AS rb_congestion FROM silver GROUP BY cell_id"""),
        "range_expectations": (SILVER, _expectations()),
        "coverage_summary": (SILVER, """SELECT count(*) AS total_events,
            round(avg(CAST(is_anomaly AS INTEGER)) * 100, 2) AS anomaly_rate_pct,
            count(DISTINCT cell_id) AS distinct_cells,
            CAST(count(DISTINCT CASE WHEN slice_type IN ('eMBB', 'URLLC', 'mMTC') THEN slice_type END) AS INTEGER)
              AS known_slices_present FROM silver"""),
        "parse_failures": (BRONZE, _parse_failures()),
        "payload_failures": (BRONZE, _payload_failures()),
        "stream_payload_failures": (BRONZE, _payload_failures()),
        "sla_breach_by_table": (SILVER, "SELECT event_id, slice_type, sla_breach FROM silver"),
        "sql_function_flags": (SILVER, "SELECT event_id, signal_quality_class, sla_breach FROM silver"),
        "json_payload_silver": (SILVER, "SELECT * FROM silver"),
        "stream_silver_events": (SILVER, "SELECT * FROM silver"),
        "stream_cell_kpis": (CELLS, f"{cells} WHERE {CLOSED}"),
        "stream_slice_kpis": (SLICES, f"{slices} WHERE {CLOSED}"),
        "sla_violations_by_table": (VIOLATIONS, "SELECT * FROM violations"),
        "stream_sla_violations": (VIOLATIONS, "SELECT * FROM violations"),
    }
    # Sums of sums add in another order; the inner rounding removes that noise, so that a tie is the same tie on both sides.
    even = {name: re.sub(r"\bavg\(([^()]+)\)", r"round(avg(\1), 12)", body[name][1]) for name in ROLLED_UP}
    body |= {f"rollup_{name}": (body[name][0], even[name]) for name in ROLLED_UP}
    written = {name: f"WITH {tables.strip()}\n{select}" for name, (tables, select) in body.items()}
    return {name: half_up(interpolated(sql) if name in TIES else sql) for name, sql in written.items()}
