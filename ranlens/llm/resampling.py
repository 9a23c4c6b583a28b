"""Documents drawn by importance towards a target distribution (operator 11).

Features are runs of consecutive words (single words by default), hashed into buckets. A bucket's gain is the
logarithm of how much more frequent it is in the target than in the documents, both smoothed by one, in whole
thousandths. A document's weight is the sum of the gains of its features: a look-up of all its buckets in one array. Its
score adds noise of Gumbel's distribution, taken from a digest of its id, so the highest scores are a sample without
replacement in proportion to the weights, and the same sample whenever it is drawn.

Bucket counts of both tables are summed in each task first, so that only buckets meet. The scores are written once,
and the cut between drawn and other documents is found by bisection over the numbers: each step counts, exactly and
over all stored scores, how many reach each of some thresholds. Ties at the last score are cut likewise by
doc_id, and rows alike in both by their place in the stored table. The drawn rows are then dealt out by range, and a row's rank is its
number in its range after those of the ranges before. No ordering of all documents takes place anywhere.

Words are runs of ASCII digits and letters and of anything beyond ASCII; only A-Z are lower-cased. Null and empty
texts have no features, the weight 0, and are never drawn. A null id has the noise of an empty one, and comes last among ties. Repeated
rows are documents of their own. Other columns are not read. Empty tables give gains of an empty distribution, and no rows.
Texts of any length are read whole; bytes that are no UTF-8 count as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ranlens.llm.common import mapped, slices, written

#: A word, in UTF-8 and lower case.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, LONGEST_RUN, LEAST_WORDS, SEED = 10_000, 1, 20, 2024
#: Thresholds counted by one job of the bisection, and rows of a range of drawn documents.
THRESHOLDS, RANGE_ROWS = 31, 200_000
HASHES = 1 << 32


def features(text: bytes | None, longest: int = LONGEST_RUN) -> list[bytes]:
    """All runs of 1 to ``longest`` words of a text, each time they occur."""
    words = WORD.findall((text or b"").lower())
    found = list(words)
    for n in range(2, longest + 1):
        found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return found


def buckets(text: bytes | None, longest: int = LONGEST_RUN, n: int = BUCKETS) -> np.ndarray:
    found = features(text, longest)
    return np.fromiter(map(crc32, found), dtype=np.int64, count=len(found)) % n


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST_RUN, n: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has: ``n`` numbers, however many texts there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in slices(batches, text):
            for t in batch.column(text).cast(pa.binary()).to_pylist():
                total += np.bincount(buckets(t, longest, n), minlength=n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    counts = np.zeros(n, dtype=np.int64)
    for row in mapped(docs.select(text), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: how much more frequent it is in the target, as a logarithm in whole thousandths."""
    all_source, all_target, n = float(source.sum()), float(target.sum()), len(source)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def noise(key: object, seed: int = SEED) -> int:
    """Gumbel noise of an id, in whole thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / HASHES)))


def scored(
    docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", longest: int = LONGEST_RUN, seed: int = SEED
) -> DataFrame:
    """Per row: the key, and ``n_features``, ``weight``, ``score`` and ``n_words``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in slices(batches, text):
            rows = []
            for t, k in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(key).to_pylist()):
                found = buckets(t, longest, len(gain))
                words = len(found) if longest == 1 else len(features(t, 1))
                weight = int(gain[found].sum())
                rows.append((len(found), weight, weight + noise(k, seed), words))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(c, pa.int64()) for c in columns)],
                [key, "n_features", "weight", "score", "n_words"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text), score, f"`{key}` {kind}, n_features long, weight long, score long, n_words long")


def least_reaching(rows: DataFrame, column: str, wanted: int, thresholds: int = THRESHOLDS) -> int:
    """The least whole number x such that at least ``wanted`` rows have a value of x or less.

    Bisection by exact counts over all rows, each job at some evenly spaced numbers. ``wanted`` is at least 1
    and at most the rows whose value is not null.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = max(1, -(-(high - low) // (thresholds + 1)))
        at = [x for x in range(low, high, step)][: thresholds + 1]
        counts = rows.agg(*(F.count_if(F.col(column) <= x).alias(f"c{i}") for i, x in enumerate(at))).first()
        reached = [x for x, n in zip(at, counts) if n >= wanted]
        missed = [x for x, n in zip(at, counts) if n < wanted]
        low, high = (max(missed) + 1 if missed else low), (min(reached) if reached else high)
    return low


def drawn(scores: DataFrame, wanted: int, key: str = "doc_id") -> Column:
    """The test that exactly ``wanted`` rows pass: the highest scores, then the least keys, then the first places.

    ``scores`` is a stored table with the whole numbers ``score``, ``key`` and ``place``; all its rows take part.
    """
    if wanted <= 0:
        return F.lit(False)
    cut = -least_reaching(scores.select((-F.col("score")).alias("fall")), "fall", wanted)
    ties = scores.where(F.col("score") == cut)
    left = wanted - scores.where(F.col("score") > cut).count()
    keyed = ties.where(F.col(key).isNotNull()).count()
    above, tied = F.col("score") > cut, F.col("score") == cut
    if left > keyed:  # all ids, and some rows without one
        last = least_reaching(ties.where(F.col(key).isNull()), "place", left - keyed)
        return above | (tied & (F.col(key).isNotNull() | (F.col("place") <= last)))
    edge = least_reaching(ties, key, left)
    left -= ties.where(F.col(key) < edge).count()
    last = least_reaching(ties.where(F.col(key) == edge), "place", left)
    return above | (tied & ((F.col(key) < edge) | ((F.col(key) == edge) & (F.col("place") <= last))))


def numbered(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The rows with their ``rank`` in an order, dealt out by range; ``n`` is how many rows there are."""
    ranges = max(1, -(-n // RANGE_ROWS))
    dealt = written(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    # One row a range: a few thousand for a thousand million drawn rows.
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("range").count()
    before = sizes.select("range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("rank", within.cast("long")).join(F.broadcast(before), "range").withColumn(
        "rank", F.col("rank") + F.col("before")
    ).drop("range", "before")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    text: str = "text",
    key: str = "doc_id",
    longest: int = LONGEST_RUN,
    n_buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document's features, weight and score, and the rank of the drawn ones.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn. The key is a whole number.
    """
    source, aim = (bucket_counts(df, text, longest, n_buckets) for df in (docs, target))
    rows = scored(docs, gains(source, aim), text, key, longest, seed)
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "scores")
    long_enough = F.col("n_words") >= least_words
    eligible = rows.where(long_enough)
    wanted = percent * eligible.count() // 100
    taken = long_enough & drawn(eligible, wanted, key)
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("place")]
    ranked = numbered(rows.where(taken), wanted, order)
    others = rows.where(~F.coalesce(taken, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(key, "n_features", "weight", "score", "rank")


def _crc32_sql(data: str) -> str:
    """The unsigned crc32 of a list of bytes, as DuckDB computes it from the definition (reflected polynomial 0xEDB88320)."""
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = f"list_reduce(list_prepend(xor(acc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, unused: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda acc, x: {byte}), 4294967295)"


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
  aims AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
  uses AS (SELECT place, unnest(words) AS word FROM docs),
  vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM uses UNION ALL SELECT word FROM aims)),
  spelled AS (SELECT word, hex(encode(word)) AS digits FROM vocabulary),
  listed AS (SELECT word, [('0x' || digits[i : i + 1])::BIGINT FOR i IN range(1, length(digits) + 1, 2)] AS data FROM spelled),
  hashed AS (SELECT word, {_crc32_sql('data')} % {BUCKETS} AS bucket FROM listed),
  source AS (SELECT bucket, count(*) AS s FROM uses JOIN hashed USING (word) GROUP BY bucket),
  target AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
  totals AS (SELECT (SELECT count(*) FROM uses)::DOUBLE AS all_s, (SELECT count(*) FROM aims)::DOUBLE AS all_t),
  gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS})
      / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS g FROM source FULL JOIN target USING (bucket), totals),
  weights AS (SELECT place, sum(g)::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY place),
  scores AS (SELECT docs.place, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
        + 0.5::DOUBLE) / {HASHES}::DOUBLE))))::BIGINT AS score FROM docs LEFT JOIN weights USING (place)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, place) AS r,
      count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""
