"""Bronze telemetry from a generic event log.

The log has ``event_id, ts, user_id, event_type, value, props``. Each row becomes
one device event; integer arithmetic gives every KPI, so any engine that follows
the same rule computes the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ranlens.schemas import BRONZE

# Fixed values of the mapping: log time starts at 2024-01-01T00:00:00Z, and thirty
# days of it become one hour.
EPOCH_MICROS = 1_704_067_200_000_000
TIME_SHRINK = 720

ROW_FACTS = {
    "h": "(e * 7919 + u * 104729 + k * 31) % 1000003",
    "c": "k % 20",
    "city": "array('LON', 'MAN', 'BIR', 'LEE', 'GLA')[cast(k % 20 % 5 AS int)]",
    "anomaly": "(kind = 'error' AND e % 4 = 1) OR e % 20 = 0",
    "slice": """CASE kind WHEN 'view' THEN 'eMBB' WHEN 'click' THEN 'URLLC' WHEN 'purchase' THEN 'mMTC'
        WHEN 'error' THEN array('eMBB', 'URLLC', 'mMTC')[cast(e % 3 AS int)]
        ELSE CASE WHEN e % 2 <> 0 THEN 'Unknown' END END""",
    "at": f"timestamp_micros({EPOCH_MICROS} + (unix_micros(cast(ts AS timestamp)) - {EPOCH_MICROS}) div {TIME_SHRINK})",
}


def _by_slice(urllc: str, mmtc: str, other: str) -> str:
    return f"CASE slice WHEN 'URLLC' THEN {urllc} WHEN 'mMTC' THEN {mmtc} ELSE {other} END"


NUMBERS = {
    "rsrp_dbm": "(h % 961 - 1400) / 10D",
    "rsrq_db": "(h * 41 % 166 - 195) / 10D",
    "sinr_db": "(h * 13 % 631 - 230) / 10D",
    "dl_throughput_mbps": _by_slice("900 + h * 17 % 3000", "80 + h * 17 % 400", "8000 + h * 17 % 40000") + " / 100D",
    "ul_throughput_mbps": _by_slice("450 + h * 19 % 1000", "45 + h * 19 % 100", "1800 + h * 19 % 8000") + " / 100D",
    "latency_ms": "CASE WHEN anomaly AND e % 8 <> 5 THEN (5000 + h * 23 % 45000) / 100D ELSE "
    + _by_slice("(100 + h * 23 % 1000) / 1000D", "(1000 + h * 23 % 10000) / 100D", "(100 + h * 23 % 1000) / 100D")
    + " END",
    "jitter_ms": _by_slice("h * 29 % 550", "h * 29 % 55000", "h * 29 % 5500") + " / 1000D",
    "packet_loss_pct": _by_slice("h * 31 % 1100 / 1000000D", "h * 31 % 11000 / 10000D", "h * 31 % 1100 / 10000D"),
    "bler_pct": "(h * 53 % 501) / 10D",
    "rb_utilization_pct": "(h * 37 % 1001) / 10D",
    "latitude": "(490000 + h * 61 % 120001) / 10000D",
    "longitude": "(h * 59 % 100001 - 80000) / 10000D",
}

# Defects are planted as in a real feed: signal values that do not parse, bad
# timestamps and missing device ids.
TEXTS = {
    "event_id": "cast(e AS string)",
    "event_timestamp": """CASE WHEN e % 211 = 0 THEN 'bad'
        ELSE date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") END""",
    "gnb_id": "concat('GNB-', city, '-', lpad(cast(c div 5 + 1 AS string), 3, '0'))",
    "cell_id": "concat('CELL-', city, '-', lpad(cast(c AS string), 3, '0'))",
    "ue_id": "CASE WHEN e % 389 <> 0 THEN concat('UE-', lpad(cast(u AS string), 5, '0')) END",
    "slice_id": "CASE slice WHEN 'eMBB' THEN 'S1' WHEN 'URLLC' THEN 'S2' WHEN 'mMTC' THEN 'S3' END",
    "slice_type": "slice",
    "cqi": "cast(h * 43 % 16 AS string)",
    "mcs_index": "cast(h * 47 % 29 AS string)",
    "handover_count": "cast(h % 3 AS string)",
    "is_anomaly": "cast(anomaly AS string)",
}


def bronze_from_log(log: DataFrame) -> DataFrame:
    """Map a batch or streaming event log to bronze; all columns are text.

    The facts of a row go through a one-element generator: no filter is pushed
    below it, so each is computed once however many columns refer to it.
    """
    # Six decimal places hold every number exactly.
    texts = TEXTS | {name: f"cast(cast({rule} AS decimal(12, 6)) AS string)" for name, rule in NUMBERS.items()}
    texts["rsrp_dbm"] = f"CASE WHEN e % 97 = 0 THEN 'n/a' ELSE {texts['rsrp_dbm']} END"
    facts = ", ".join(f"'{name}', {rule}" for name, rule in ROW_FACTS.items())
    return (
        log.selectExpr(
            "event_id AS e", "user_id AS u", "event_type AS kind", "ts",
            "try_cast(get_json_object(props, '$.k') AS bigint) AS k",
        )
        .selectExpr("e", "u", f"inline(array(named_struct({facts})))")
        .selectExpr(*(f"{texts[name]} AS {name}" for name in BRONZE.names))
    )
