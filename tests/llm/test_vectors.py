import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from ranlens.llm import vectors
from ranlens.llm.catalog import op7_top_k, oracle_sql

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int"


def brute(rows, k=10):
    """The expected rows (query, rank, id, score) by full sorting."""
    sound = [
        (i, [math.floor(1024 * Fraction(float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for q, query in (r for r in sound if r[0] % 100 == 0):
        scores = [(-sum(a * b for a, b in zip(query, v)), i) for i, v in sound if i != q and len(v) == len(query)]
        found += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def floats(vector):
    return vector and [x if x is None else float(x) for x in vector]


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_the_query_equals_brute_force_and_its_sql(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = got(op7_top_k(spark, folder))
    assert found == brute(rows)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        assert found == sorted(db.execute(oracle_sql()["op7_top_k"]).fetchall())


@pytest.mark.parametrize("rows_a_block", [32_768, 50])
def test_ties_nulls_and_blocks(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows_a_block)
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=6).tolist()) for i in range(0, 500)]
    rows += [(i, [0.5] * 6) for i in range(1_000, 1_200)]  # ties
    rows += [(2_000, None), (2_001, []), (2_400, []), (2_002, []), (2_100, [1.0, None, 0, 0, 0, 0]), (2_200, [math.nan] * 6), (2_300, [math.inf] * 6)]
    rows += [(3_000, [1.0, 2.0]), (3_001, [1.0, -2.0]), (None, [1.0] * 6), (3_100, [0.0] * 6), (3_200, [2000.0, -3000.0, 1, 1, 1, 1e6])]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, floats(v), 0, "x", 1) for i, v in rows], SCHEMA)
    assert got(vectors.top_k(df, df.where("vec_id % 100 = 0"))) == brute(rows)


DOUBLES = "vec_id long, embedding array<double>"


def doubles(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], DOUBLES)


@pytest.mark.parametrize("power", [21, 30, 43, 52, 60])
def test_large_components_are_scored_exactly(spark, power):
    random = np.random.default_rng(6)
    # A third of the rows is large in a component that only some queries look at, with a weight that keeps scores in 64 bits.
    rows = [(i, [*random.normal(size=3) * 100, (2.0**power if i % 3 == 0 else 1) * random.normal()]) for i in range(1, 100)]
    rows += [(100, [1, 2, 3, 0]), (200, [0.5, -0.25, 7, 0]), (300, [0, 0, 0, 2.0**-10 if power < 52 else 0]), (400, [-1, -1, -1, 0])]
    df = doubles(spark, rows)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    expected = [r for r in brute(rows) if r[0] < 500]
    assert all(-(2**63) <= score < 2**63 for *_, score in expected)
    assert got(vectors.top_k(df, df.where("vec_id >= 100"))) == expected


def test_only_a_returned_score_must_be_a_long(spark):
    rows = [(100, [-1.0]), (1, [2.0**30]), (2, [1024.0]), (3, [-(2.0**31)]), (4, [2.0**53]), (5, [1e300]), (6, [0.5])]
    df = doubles(spark, rows)
    query = df.where("vec_id = 100")
    found = vectors.top_k(df, query, k=4).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(3, 2**51), (6, -(2**19)), (2, -(2**30)), (1, -(2**50))]
    with pytest.raises(Exception, match="no 64-bit integer"):  # below
        vectors.top_k(df, query, k=6).collect()
    probe = doubles(spark, [(100, [2.0**30]), (1, [1024.0]), (2, [-(2.0**31)]), (3, [2.0**53]), (4, [2.0**20])])
    with pytest.raises(Exception, match="no 64-bit integer"):  # above
        vectors.top_k(probe, probe.where("vec_id = 100"), k=1).collect()


def test_repeated_rows_are_candidates_each_time(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    assert got(vectors.top_k(df, df.where("vec_id = 100"), k=3)) == [(100, 1, 1, 1 << 20), (100, 2, 1, 1 << 20), (100, 3, 2, 1 << 19)]


def test_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.top_k(none, none).collect() == []


def test_sums_of_bitmaps():
    random = np.random.default_rng(4)
    values = random.integers(0, 2, size=(37, 200), dtype=np.uint8)
    weights = random.integers(0, 6, size=37)
    packed = np.packbits(np.pad(values, ((0, 0), (0, 56))), axis=1, bitorder="little").view(np.uint64)
    slices = vectors.added({int(w): packed[weights == w] for w in set(weights)})
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[:200].astype(int) for s in slices]
    assert (sum(b << i for i, b in enumerate(bits)) == (values.astype(int) << weights[:, None]).sum(axis=0)).all()


def test_candidates_are_few_and_hold_the_best():
    random = np.random.default_rng(5)
    x = np.floor(random.normal(size=(5_000, 64)) * 128).astype(np.int64)
    index = vectors.Index(np.arange(5_000), x)
    for i in range(20):
        rows = index.candidates(x[i], index.ids == i, 10)
        scores = x @ x[i]
        scores[i] = -(1 << 62)
        assert set(np.argsort(-scores)[:10]) <= set(rows) and len(rows) < 500
