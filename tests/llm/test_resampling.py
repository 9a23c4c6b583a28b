import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from ranlens.llm import resampling
from ranlens.llm.catalog import op11_importance_resampling, oracle_sql


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, aims, percent=10, least=20, n=10_000):
    """Every row's numbers, from the definition; rows are (id, text)."""

    def bucket(word):
        return zlib.crc32(word.encode()) % n

    def counted(texts):
        counts = [0] * n
        for text in texts:
            for word in words_of(text):
                counts[bucket(word)] += 1
        return counts

    s, t = counted(text for _, text in docs), counted(aims)
    all_s, all_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + n) / ((a + 1) * (all_t + n)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        words = words_of(text)
        weight = sum(gain[bucket(w)] for w in words)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc, len(words), weight, score, None])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(long[: percent * len(long) // 100], 1):
        row[4] = rank
    return rows


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x or 0) for x in r])


def test_the_query_equals_its_sql_and_brute_force(spark, folder, documents):
    got = in_order(op11_importance_resampling(spark, folder).collect())
    aims = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got == in_order(brute([(r.doc_id, r.text) for r in documents.collect()], aims))
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        assert got == in_order(db.execute(oracle_sql()["op11_importance_resampling"]).fetchall())


@pytest.mark.parametrize("thresholds, range_rows", [(31, 200_000), (1, 7)])
def test_ties_and_repeated_rows(spark, monkeypatch, thresholds, range_rows):
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(resampling.least_reaching, "__defaults__", (thresholds,))
    text = "a b c d e f g h i j k l m n o p q r s t"
    docs = [(5, text)] * 40 + [(i, text) for i in range(6, 40)] + [(None, text)] * 30 + [(7, "Zß zß 1 ß, " * 9)] * 3 + [(8, "few words")]
    docs = [(d, t, None, None, None) for d, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, place long, `rank` int")
    aims = spark.createDataFrame([("a b c zß",), (None,)], "text string")
    for percent in (0, 1, 10, 50, 90, 100):
        got = in_order(resampling.resampled(df, aims, percent).collect())
        assert got == in_order(brute([d[:2] for d in docs], ["a b c zß", None], percent))


def test_odd_and_no_rows(spark, odd_documents, no_documents):
    aims = spark.createDataFrame([("the first text of the table",), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = in_order(resampling.resampled(odd_documents, aims, 50, least_words=1).collect())
    assert got == in_order(brute(rows, ["the first text of the table", ""], 50, 1))
    assert resampling.resampled(no_documents, aims).collect() == []
    got = in_order(resampling.resampled(odd_documents, aims.limit(0), least_words=1).collect())
    assert got == in_order(brute(rows, [], 10, 1))


def test_longer_runs():
    assert resampling.features("One two, THREE".encode(), 3) == [b"one", b"two", b"three", b"one two", b"two three", b"one two three"]
    assert resampling.features(None, 2) == [] == resampling.features(b" .,", 2)


def test_bisection_finds_the_least_number(spark):
    values = [int(x) for x in np.random.default_rng(3).integers(-1000, 1000, 500)]
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    for wanted in (1, 2, 250, 499, 500):
        for thresholds in (1, 4, 31):
            assert resampling.least_reaching(rows, "x", wanted, thresholds) == sorted(values)[wanted - 1]
