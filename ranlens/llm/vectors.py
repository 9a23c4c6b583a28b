"""Exact top-k search by inner product over a bit-sliced index (operator 7).

Vectors become integers, floor(1024 x) for each component x. Rows lie in blocks; a block's index has, for every
attribute, one bitmap over its rows for each bit of the attribute's value. A query's scores are summed for all
rows of a block at once: its own bits choose the bitmaps, which carry-save adders of bitmap arithmetic add, three
at a time. Attributes enter quantised to their leading bits, so a sum is a lower bound whose distance
from the score is bounded for the query. The top rows are selected from the most significant slice of the sums
downward; every row whose bound reaches the k-th is then scored exactly, and ties go to the smaller id.

Rows are dealt into blocks of bounded size, by a spread that does not depend on their values, so equal vectors do not
gather anywhere. A block's index is built once, and all queries stream past it in batches; each gets k rows of the block at
most, of which the best k of all blocks are kept by rank.

Every vector without null or non-finite components takes part, however large its components are: rows with components
of 2^61 or more after scaling stay out of the bitmaps and are always candidates, and scores that may pass 64 bits are computed
with integers of any size. A score that is no 64-bit integer is an error if it is among those to return, and none otherwise.
A vector meets those of its own length (vectors without components, too; their scores are 0). Null vectors and rows
without an id take no part. Rows with the query's id are its own and are no candidates. A repeated row is a
candidate, or a query, each time. Other columns are not read.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ranlens.llm.common import mapped

#: Rows of a block; a small table is cut further for the sake of the cores, down to LEAST_ROWS.
BLOCK_ROWS, LEAST_ROWS = 32_768, 4_096
#: Leading bits of attributes and of a query's components that enter the bitmap sums.
ATTRIBUTE_BITS, QUERY_BITS = 8, 9
SCALE = 1024
#: Components below this (after scaling) enter the index, and sums of products below that are added as 64-bit integers.
LARGE, SAFE = float(1 << 61), float(1 << 62)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(values: np.ndarray) -> np.ndarray:
    """The integers of finite doubles: 64-bit ones, or of any size (as objects) if one is too large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not values.size or np.abs(scaled).max() < LARGE:
        return scaled.astype(np.int64)
    # A double beyond 2^52 is a whole number, so nothing is cut off by scaling it afterwards.
    whole = [math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def products(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """The exact inner products of rows with a query."""
    if not rows.size:
        return [0] * len(rows)
    if rows.dtype == object or query.dtype == object:
        return [sum(map(operator.mul, row, query.tolist())) for row in rows.tolist()]
    if np.abs(rows.astype(float)).max(axis=0) @ np.abs(query.astype(float)) < SAFE:
        return (rows @ query).tolist()
    return products(rows.astype(object), query)


def added(bitmaps: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The sum of bitmaps by their weight (as a power of two), as slices from the least significant."""
    slices, weight = [], 0
    pending = {w: [b] for w, b in bitmaps.items()}
    while pending:
        here = pending.pop(weight, None)
        if here is None:
            slices.append(None)
            weight += 1
            continue
        rows = np.concatenate(here) if len(here) > 1 else here[0]
        carries = []
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            differ = a ^ b
            carries.append((a & b) | (differ & c))
            rows = np.concatenate([differ ^ c, rows[3 * third :]])
        if len(rows) == 2:
            carries.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
        slices.append(rows[0])
        if carries:
            pending.setdefault(weight + 1, []).extend(carries)
        weight += 1
    return slices


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


class Index:
    """The bit-sliced index of a block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low = vectors.min(axis=0)
        values = vectors - self.low
        self.bits = int(values.max()).bit_length()
        self.dropped = max(0, self.bits - ATTRIBUTE_BITS)
        self.kept = self.bits - self.dropped
        words = -(-len(ids) // 64)
        padded = np.zeros((vectors.shape[1], words * 64), dtype=np.int64)
        padded[:, : len(ids)] = values.T
        planes = [
            np.packbits((padded >> (self.dropped + j)) & 1 == 1, axis=1, bitorder="little").view(np.uint64)
            for j in range(self.kept)
        ]
        one = np.stack(planes, axis=1) if planes else np.zeros((vectors.shape[1], 0, words), np.uint64)
        self.slices = np.stack([one, ~one])  # of a value, and of what it lacks to the largest
        self.used = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Scores (negated) and ids of the rows among which the k best are that are not the query's own."""
        rows = self.candidates(query, self.ids == query_id, k)
        return [(-score, i) for score, i in zip(products(self.vectors[rows], query), self.ids[rows].tolist())]

    def candidates(self, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Places of rows among which the k best are: all whose bound reaches the k-th best bound."""
        if not self.kept or not len(query) or len(self.ids) - own.sum() <= k:
            return np.flatnonzero(~own)
        size = np.abs(query).astype(object)
        cut = max(0, int(size.max()).bit_length() - QUERY_BITS)
        leading = size >> cut
        # score = constant + 2^(cut + dropped) * sum of slices + what lies between 0 and slack
        slack = int(((leading << cut) * ((1 << self.dropped) - 1)).sum() + ((size - (leading << cut)) << self.bits).sum())
        slack = -(-int(slack) >> (cut + self.dropped)) + 1
        leading = leading.astype(np.int64)
        negative = (query < 0).astype(int)
        chosen: dict[int, list[np.ndarray]] = {}
        for i in range(int(leading.max()).bit_length()):
            attributes = np.flatnonzero((leading >> i) & 1)
            if len(attributes):
                for j in range(self.kept):
                    chosen.setdefault(i + j, []).append(self.slices[negative[attributes], attributes, j])
        if not chosen:
            return np.flatnonzero(~own)
        sums = added({w: np.concatenate(b) if len(b) > 1 else b[0] for w, b in chosen.items()})
        allowed = self.used
        if own.any():
            padded = np.zeros(len(self.used) * 64, dtype=bool)
            padded[: len(own)] = own
            allowed = self.used & ~np.packbits(padded, bitorder="little").view(np.uint64)
        least = self.at_least(sums, max(0, self.kth(sums, allowed, k) - slack), allowed)
        return np.flatnonzero(np.unpackbits(least.view(np.uint8), bitorder="little"))

    @staticmethod
    def kth(sums: list[np.ndarray], allowed: np.ndarray, k: int) -> int:
        """The k-th largest sum of the allowed rows, from the most significant slice downward."""
        above, equal, value = 0, allowed, 0
        for i in range(len(sums) - 1, -1, -1):
            ones = equal & sums[i] if sums[i] is not None else equal & np.uint64(0)
            n = count(ones)
            if above + n >= k:
                equal, value = ones, value | (1 << i)
            else:
                above, equal = above + n, equal & ~ones
        return value

    @staticmethod
    def at_least(sums: list[np.ndarray], least: int, allowed: np.ndarray) -> np.ndarray:
        """The allowed rows whose sum is at least that value."""
        above, equal = np.zeros_like(allowed), allowed
        for i in range(len(sums) - 1, -1, -1):
            ones = equal & sums[i] if sums[i] is not None else np.zeros_like(allowed)
            if (least >> i) & 1:
                equal = ones
            else:
                above, equal = above | ones, equal & ~ones
        return above | equal if least < 1 << len(sums) else np.zeros_like(allowed)


class Block:
    """The rows of a block by the length of their vectors: an index of most of them, and those with large or no components."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.indexes: dict[int, Index] = {}
        self.large: dict[int, tuple[list[int], np.ndarray]] = {}
        for length, ids, values in by_length(parts):
            with np.errstate(over="ignore"):
                fits = (np.abs(values * SCALE) < LARGE).all(axis=1) & (length > 0)
            if fits.any():
                self.indexes[length] = Index(ids[fits], quantised(values[fits]))
            if not fits.all():
                self.large[length] = (ids[~fits].tolist(), quantised(values[~fits]))

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Scores and ids of the k best rows that are not the query's own, the best first."""
        found = self.indexes[len(query)].top(query_id, query, k) if len(query) in self.indexes else []
        if len(query) in self.large:
            ids, rows = self.large[len(query)]
            found += [(-score, i) for score, i in zip(products(rows, query), ids) if i != query_id]
        return [(-score, i) for score, i in sorted(found)[:k]]


def by_length(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of batches by the length of their vectors: the length, ids, and components."""
    table = pa.Table.from_batches(parts)
    lengths = table["length"].to_numpy()
    for length in np.unique(lengths).tolist():
        own = table.filter(pa.array(lengths == length))
        flat = own["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield length, own["vec_id"].to_numpy(), flat.reshape(own.num_rows, length)


FOUND = "place long, query_id long, vec_id long, score long, below boolean"


def met(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task: for each of its blocks, first the rows come, then the queries."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            kinds = 2 * blocks.astype(np.int64) + asks
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if blocks[begin] != current:
                    current, parts, block = blocks[begin], [], None
                if not asks[begin]:
                    parts.append(part)
                    continue
                if parts:
                    block, parts = Block(parts), []
                if block is not None:
                    yield answers(block, part, k)

    return meet


def answers(block: Block, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k best rows of a block for each query. A score below 64 bits is marked: it may be returned for want of others only."""
    found: list[tuple] = []
    places = dict(zip(queries.column("place").to_pylist(), range(queries.num_rows)))
    for length, at, values in by_length([queries.set_column(queries.schema.get_field_index("vec_id"), "vec_id", queries.column("place"))]):
        for place, vector in zip(at.tolist(), values):
            query_id = queries.column("vec_id")[places[place]].as_py()
            for score, i in block.top(query_id, quantised(vector), k):
                if score > MOST:
                    raise ValueError(f"the score of query {query_id} and row {i} is no 64-bit integer: {score}")
                found.append((place, query_id, i, max(score, LEAST), score < LEAST))
    columns = list(zip(*found)) if found else [()] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in FOUND.split(", ")])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best rows for each query."""

    def taking_part(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        # Places follow the order in which files are read, which is the same when a task runs again.
        return df.where(F.col("vec_id").isNotNull() & sound).withColumn("place", F.monotonically_increasing_id())

    rows, queries = taking_part(rows), taking_part(queries)
    n = rows.count()
    blocks = max(-(-n // BLOCK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS), 1)
    held = rows.withColumn("block", (F.col("place") % blocks).cast("int")).withColumn("asks", F.lit(False))
    asking = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    both = held.unionByName(asking).withColumn("length", F.size("embedding"))
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "asks")
    found = mapped(dealt, met(k), FOUND)
    best = Window.partitionBy("place").orderBy("below", F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    no_long = F.raise_error(F.format_string("the score of query %d and row %d is no 64-bit integer", "query_id", "vec_id"))
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("below"), no_long.cast("long")).otherwise(F.col("score")).alias("score"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e, len(embedding) AS n, row_number() OVER () AS place
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
  scored AS (SELECT q.vec_id AS query_id, q.place, r.vec_id,
      coalesce(list_sum([q.e[i] * r.e[i] FOR i IN range(1, q.n + 1)]), 0)::BIGINT AS score
    FROM v q JOIN v r ON q.n = r.n AND q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
