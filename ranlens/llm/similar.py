"""Jaccard similarity join of whole texts on word n-grams, with Bayesian pruning of candidates (operator 8).

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The steps:

1. Each text gives, where it is read, the key of its shingle set and ``HASHES`` MinHash values; bands of them are its buckets.
   At similarity 0.8 a pair shares no bucket once in 300,000 times.
2. Texts with one shingle set become one: their number is counted, and no pair is made of them.
3. Sets that share a bucket are candidates. Within a bucket the MinHash values are compared a few at a time; a pair goes as soon as
   the posterior probability that its similarity reaches the threshold (uniform prior, binomial agreement) is
   under ``TOLERANCE``. A set is compared with those not yet connected to it, so a bucket of near copies costs about
   its size, and it returns a star of edges, not its pairs.
4. The connected components of these edges hold all pairs that may be linked. Within them the same comparison drops pairs, and so
   does the ratio of their sizes; the rest is verified exactly by the sizes of the shingles' intersection. Each set counts its links
   (the documents of linked sets, copies included), and links give the final classes.

Buckets and components of any size are cut into blocks by a hash of the set, and two blocks of one meet in a task
of their own, so memory is bounded and no pairs are rows. The bound is on rows and, for shingles, on their number. The blocks of a
component hold sets of one size class, and meet only those of the same and the next class, as no others can be linked. The
MinHash values of two blocks meet first; only sets with a pair left there go on to have their texts read and their shingles sent.

A text of one to four words has one shingle, all of it. A text without words (null or empty) is linked to none. A
repeated row is a document each time. Ids may be null or repeated: a document is told by its id and its text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ranlens.llm.common import mapped, of_fixed_width, slices, written
from ranlens.llm.components import components

SHINGLE_WORDS = 5
#: The threshold as a fraction, so that it is compared in whole numbers.
OVER, UNDER = 4, 5
BANDS, BAND_ROWS = 24, 4
HASHES = BANDS * BAND_ROWS
#: Posterior probability under which a pair is dropped, and MinHash values compared at a time.
TOLERANCE, COMPARED = 1e-7, 8
#: Sets of a block in a bucket; sets and shingles of a block in a component.
BUCKET_BLOCK, COMPONENT_BLOCK, SHINGLE_BLOCK = 2_048, 512, 400_000
#: Sets whose sizes differ by this factor or more cannot be linked; it is a little more than the inverse of the threshold.
SIZE_STEP = 1.26
#: Values of a hash by which rows are sorted out before a join: the list that is broadcast has as many integers at most.
SIEVE = 1 << 20
#: Columns of a dense block when intersections are counted by a product of matrices.
COLUMNS = 2_048

BASE, STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
MASK = (1 << 64) - 1
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True


@lru_cache(maxsize=1)
def coefficients() -> np.ndarray:
    """Odd multipliers and addends of the MinHash functions, the same everywhere."""
    return np.random.default_rng(20).integers(1, 1 << 63, size=(HASHES, 2), dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def stirred(x: np.ndarray) -> np.ndarray:
    """A mix of all bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, by one prefix sum over its bytes."""
    codes = np.frombuffer(data, dtype=np.uint8)
    word = ~IS_SPACE[codes]
    if not word.any():
        return np.array([], dtype=np.uint64)
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(16, (len(codes) - 1).bit_length())
    up, down = powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    return stirred((sums[end] - sums[begin]) * down[begin])


def shingles(text: str) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; empty for a text without words."""
    words = word_hashes(text.encode())
    n = min(SHINGLE_WORDS, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for offset in range(n):
        total = total * np.uint64(STEP) + words[offset : offset + len(total)]
    return np.unique(stirred(total + np.uint64(n)))


def set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def min_hashes(own: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each hash function over a set."""
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    factors = coefficients()
    for begin in range(0, len(own), 1_024):
        part = own[begin : begin + 1_024]
        values = (factors[:, :1] * part[None, :] + factors[:, 1:]) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1))
    return least.astype(np.uint32)


@lru_cache(maxsize=1)
def least_agreements() -> list[int]:
    """For every number of values compared, the agreements a pair needs to stay.

    With m of n agreeing and a uniform prior the similarity is Beta(m + 1, n - m + 1), and the probability that it reaches
    t is that of m successes at most in n + 1 trials of probability t.
    """
    t, needed = OVER / UNDER, []
    for n in range(HASHES + 1):
        reach = np.cumsum([math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 1)])
        needed.append(int(np.searchsorted(reach, TOLERANCE)))
    return needed


def still_likely(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the others whose agreement with one keeps them likely to reach the threshold."""
    places, agreeing, needed = np.arange(len(others)), np.zeros(len(others), dtype=np.int64), least_agreements()
    for begin in range(0, HASHES, COMPARED):
        end = begin + COMPARED
        agreeing += (others[places, begin:end] == one[..., begin:end]).sum(axis=1)
        stay = agreeing >= needed[end]
        if not stay.all():
            places, agreeing = places[stay], agreeing[stay]
            one = one[stay] if one.ndim > 1 else one
        if not len(places):
            break
    return places


def connected(values: np.ndarray) -> np.ndarray:
    """For each row of MinHash values the place of the first row that likely pairs connect it to."""
    root, waiting = np.arange(len(values)), np.arange(len(values))
    while len(waiting) > 1:
        first, waiting = waiting[0], waiting[1:]
        frontier = [first]
        while frontier and len(waiting):
            found = still_likely(values[frontier.pop()], values[waiting])
            frontier.extend(waiting[found])
            root[waiting[found]] = first
            waiting = np.delete(waiting, found)
    return root


def likely_pairs(sizes: list[np.ndarray], least: list[np.ndarray]) -> np.ndarray:
    """A matrix of the pairs of two lists of sets, given their sizes and MinHash values, that are not dropped."""
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    kept = UNDER * small >= OVER * large
    for i, own in enumerate(least[0]):
        near = np.flatnonzero(kept[i])
        kept[i] = False
        kept[i, near[still_likely(own, least[1][near])]] = True
    return kept


def linked(first: list[np.ndarray], second: list[np.ndarray], likely: np.ndarray) -> np.ndarray:
    """A matrix of which sets of the first list are linked to which of the second, verified for the likely pairs."""
    sizes = np.array([len(s) for s in first])[:, None] + np.array([len(s) for s in second])[None, :]
    common = np.zeros(sizes.shape, dtype=np.int64)
    if likely.sum() <= max(64, likely.size // 100):
        for i, j in zip(*np.nonzero(likely)):
            a, b = first[i], second[j]
            common[i, j] = len(np.intersect1d(a, b, assume_unique=True)) if a is not b else len(a)
    else:
        values, column, count = np.unique(np.concatenate(first + second), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(first) + len(second)), [len(s) for s in first + second])
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [begin, begin + COLUMNS])
            part = np.zeros((len(first) + len(second), COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - begin] = 1
            common += np.rint(part[: len(first)] @ part[len(first) :].T).astype(np.int64)
    return likely & ((OVER + UNDER) * common >= OVER * sizes)


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Per row: its id, the hash of its text, and its shingle set's key, size and MinHash values (their low 16 bits)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingles(t or "") for t in batch.column(text).to_pylist()]
            least = [min_hashes(s).astype(np.uint16).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(map(set_key, sets), pa.binary()),
                    pa.array(map(len, sets), pa.int32()),
                    pa.array(least, pa.binary()),
                ],
                ["doc", "set", "size", "least"],
            )

    rows = docs.select(document(text, key).alias("doc"), text)
    return mapped(rows, sketch, "doc struct<id:long,hash:long>, set binary, size int, least binary")


def document(text: str, key: str) -> Column:
    """What tells a document: its id and the hash of its text."""
    return F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("hash"))


def in_blocks(rows: DataFrame, blocks: Column, by: str = "set") -> DataFrame:
    """Adds ``block`` by a hash of the set, and repeats each row for every pair ``a`` <= ``b`` of blocks with its own."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col(by)), blocks).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), (blocks - 1).cast("int")),
        lambda j: F.struct(F.least("block", j).alias("a"), F.greatest("block", j).alias("b")),
    )
    return rows.withColumn("pair", F.explode(others)).select("*", "pair.a", "pair.b").drop("pair")


def sieved(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that may be among ``chosen`` (``how`` left_semi), or surely are not (left_anti), by ``doc`` of both.

    So that few texts are shuffled when few are chosen. The broadcast side has SIEVE integers at most; where
    they are all taken every row may be among the chosen, and the join after it decides alone.
    """
    slot = F.pmod(F.xxhash64("doc"), SIEVE).alias("slot")
    slots = F.broadcast(chosen.select(slot).distinct())
    return docs.join(slots, F.pmod(F.xxhash64(docs["doc"]), SIEVE) == slots["slot"], how)


def likely_edges(sets: DataFrame) -> DataFrame:
    """Edges ``x``, ``y`` that connect the sets of likely pairs."""
    # A bucket is the hash of a band's place and values. Two sets with one short key would be candidates too much, no more.
    width = 2 * BAND_ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substr("least", i * width + 1, F.lit(width)))
    )
    short = F.xxhash64("set").alias("short")
    buckets = sets.select(short, F.explode(bands).alias("bucket"))
    filled = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = in_blocks(buckets.join(filled, "bucket"), F.ceil(F.col("n") / BUCKET_BLOCK), "short")
    met = members.join(sets.select(short, "set", "least"), "short").groupBy("bucket", "a", "b")
    blocks = met.agg(F.collect_list(F.struct("set", "least")).alias("members")).select("members")

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            held = members.flatten()
            values = of_fixed_width(held.field("least"), 2 * HASHES).view(np.uint16)
            ends = np.cumsum([0, *pa.compute.list_value_length(members).to_pylist()])
            begins, sizes = ends[:-1], np.diff(ends)
            twos = begins[sizes == 2]
            likely = [twos[begin : begin + 10_000] for begin in range(0, len(twos), 10_000)]
            likely = [part[still_likely(values[part], values[part + 1])] for part in likely]
            x, y = list(likely), [part + 1 for part in likely]
            for begin, size in zip(begins[sizes > 2], sizes[sizes > 2]):
                root = connected(values[begin : begin + size])
                own = np.flatnonzero(root != np.arange(size))
                x.append(begin + own)
                y.append(begin + root[own])
            places = [pa.array(np.concatenate([*part, np.array([], dtype=np.int64)])) for part in (x, y)]
            yield pa.RecordBatch.from_arrays([held.field("set").take(p) for p in places], ["x", "y"])

    return mapped(blocks, connect, "x binary, y binary").distinct()


MEETING = "struct<ca:int,a:int,cb:int,b:int>"


def meetings(members: DataFrame) -> DataFrame:
    """Adds to ``set``, ``size`` and ``label``: ``cut`` (more than one block), ``class``, ``block``, and ``meets``, where the set's block meets others.

    A component of one block meets itself. Of a larger one, blocks are made in each size class, and meet those of their own and the next class.
    """
    measured = [F.count("*").alias("n"), F.sum("size").alias("total")]
    blocks = F.greatest(F.ceil(F.col("n") / COMPONENT_BLOCK), F.ceil(F.col("total") / SHINGLE_BLOCK)).cast("int")
    cut = members.groupBy("label").agg(*measured).select("label", (blocks > 1).alias("cut"))
    size_class = F.when(F.col("cut"), F.floor(F.log("size") / math.log(SIZE_STEP))).otherwise(0).cast("int")
    rows = written(members.join(cut, "label").withColumn("class", size_class), "classed")
    own = written(rows.groupBy("label", "class").agg(*measured).select("label", "class", blocks.alias("here")), "blocks")
    for name, step in (("below", 1), ("above", -1)):
        beside = own.select("label", (F.col("class") + step).alias("class"), F.col("here").alias(name))
        rows = rows.join(beside, ["label", "class"], "left")
    rows = rows.join(own, ["label", "class"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "set"), F.col("here")).cast("int"))

    def met(n: Column, meeting) -> Column:
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda j: F.struct(*(x.cast("int").alias(k) for k, x in zip(("ca", "a", "cb", "b"), meeting(j)))))

    c, i = F.col("class"), F.col("block")
    meets = F.concat(
        met(F.col("here"), lambda j: (c, F.least(i, j), c, F.greatest(i, j))),
        met(F.coalesce("above", F.lit(0)), lambda j: (c, i, c + 1, j)),
        met(F.coalesce("below", F.lit(0)), lambda j: (c - 1, j, c, i)),
    )
    return rows.withColumn("meets", meets).drop("here", "above", "below", "total", "n")


def surviving(members: DataFrame) -> DataFrame:
    """The sets with ``meets`` cut down to the meetings in which the set has a likely partner; sets without any go.

    ``members`` is as ``meetings`` gives it, with ``least``. Components of one block are left to the verification.
    """

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for held, meeting in zip(batch.column("members"), batch.column("meeting").to_pylist()):
                sides = sides_of(held.as_py(), meeting)
                kept = likely_pairs(*matrices(sides))
                if same_block(meeting):
                    np.fill_diagonal(kept, False)
                left = [m["set"] for m, any_ in zip(sides[0], kept.any(axis=1)) if any_]
                right = [] if same_block(meeting) else [m["set"] for m, any_ in zip(sides[1], kept.any(axis=0)) if any_]
                found += [(key, meeting) for key in left + right]
            sets, places = zip(*found) if found else ((), ())
            kind = pa.struct([(k, pa.int32()) for k in ("ca", "a", "cb", "b")])
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(places, kind)], ["set", "meeting"])

    large = members.where("cut").withColumn("meeting", F.explode("meets"))
    met = large.groupBy("label", "meeting").agg(F.collect_list(F.struct("set", "class", "block", "size", "least")).alias("members"))
    kept = mapped(met.select("members", "meeting"), screen, f"set binary, meeting {MEETING}")
    kept = kept.groupBy("set").agg(F.collect_list("meeting").alias("kept"))
    cut = members.where("cut").join(kept, "set").withColumn("meets", F.col("kept")).drop("kept")
    return cut.unionByName(members.where("NOT cut"))


def same_block(meeting: dict) -> bool:
    return (meeting["ca"], meeting["a"]) == (meeting["cb"], meeting["b"])


def sides_of(members: list[dict], meeting: dict) -> list[list[dict]]:
    """The sets of the two blocks of a meeting; a document, and so its set, may be repeated."""
    own = {m["set"]: m for m in members}
    blocks = [(meeting["ca"], meeting["a"]), (meeting["cb"], meeting["b"])]
    return [[m for m in own.values() if (m["class"], m["block"]) == block] for block in blocks]


def matrices(sides: list[list[dict]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sizes and MinHash values of the sets of both sides."""
    sizes = [np.array([m["size"] for m in side], dtype=np.int64) for side in sides]
    least = [np.frombuffer(b"".join(m["least"] for m in side), dtype=np.uint16).reshape(-1, HASHES) for side in sides]
    return sizes, least


def verified(docs: DataFrame, members: DataFrame, text: str, key: str) -> DataFrame:
    """For each set and meeting of its block: ``links``, ``root``, the first set its links lead to there, and ``pairs``, how many were verified.

    ``members`` has a set's ``set``, ``doc`` (one that holds it), ``copies``, ``size``, ``least`` and ``label`` of its component.
    """
    columns = ("set", "copies", "size", "least", "label", "cut", "class", "block", "meets")
    chosen = written(surviving(meetings(members)).select(*columns, "doc"), "members")
    texts = sieved(docs.select(document(text, key).alias("doc"), text), chosen, "left_semi")
    found = texts.join(chosen, texts["doc"].eqNullSafe(chosen["doc"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            sets = [shingles(t or "") for t in batch.column(text).to_pylist()]
            same = pa.array([set_key(s) == k for s, k in zip(sets, batch.column("set").to_pylist())], pa.bool_())
            held = [batch.column(name) for name in columns] + [pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(held, [*columns, "shingles"]).filter(same)

    kinds = ", ".join(f"`{name}` {chosen.schema[name].dataType.simpleString()}" for name in columns)
    shingled = mapped(found.select(*columns, text), cut, f"{kinds}, shingles binary").withColumn("meeting", F.explode("meets"))
    held = F.struct("set", "copies", "size", "least", "class", "block", "shingles")
    groups = shingled.groupBy("label", "cut", "meeting").agg(F.collect_list(held).alias("members"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("members"), batch.column("cut").to_pylist(), batch.column("meeting").to_pylist())
            for held, cut, meeting in rows:
                sides = sides_of(held.as_py(), meeting)
                sets = [[np.frombuffer(m["shingles"], dtype=np.uint64) for m in side] for side in sides]
                likely, same = likely_pairs(*matrices(sides)), same_block(meeting)
                if same:
                    np.fill_diagonal(likely, False)
                links = linked(*sets, likely)
                copies = [np.array([m["copies"] for m in side], dtype=np.int64) for side in sides]
                counted = [links @ copies[1]] + ([] if same else [links.T @ copies[0]])
                tried = [likely.sum(axis=1)] + ([] if same else [likely.sum(axis=0)])
                keys = [m["set"] for m in sides[0]] + ([] if same else [m["set"] for m in sides[1]])
                roots = first_linked(links, same)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array(np.concatenate(counted), pa.int64()),
                        pa.array([keys[r] for r in roots], pa.binary()),
                        pa.array([cut] * len(keys)),
                        pa.array(np.concatenate(tried), pa.int64()),
                    ],
                    ["set", "links", "root", "cut", "pairs"],
                )

    return mapped(groups.select("members", "cut", "meeting"), verify, "set binary, links long, root binary, cut boolean, pairs long")


def first_linked(links: np.ndarray, same: bool) -> np.ndarray:
    """For each set of both sides the place of the first that links lead to; the sides are one if ``same``."""
    n = len(links) if same else sum(links.shape)
    whole = links
    if not same:
        whole = np.zeros((n, n), dtype=bool)
        whole[: len(links), len(links) :] = links
        whole[len(links) :, : len(links)] = links.T
    root, waiting = np.arange(n), np.ones(n, dtype=bool)
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first] = False
        frontier = [first]
        while frontier:
            found = np.flatnonzero(whole[frontier.pop()] & waiting)
            waiting[found] = False
            root[found] = first
            frontier.extend(found)
    return root


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each shingle set: ``copies``, ``links`` to documents of other sets, ``first`` and least ``id`` (nulls ignored) of its class."""
    sketches = written(sketched(docs, text, key), "sketches")
    sets = written(
        sketches.where("size > 0")
        .groupBy("set")
        .agg(
            F.min("doc").alias("doc"),
            F.min("doc.id").alias("id"),
            F.count("*").alias("copies"),
            F.any_value("size").alias("size"),
            F.any_value("least").alias("least"),
        ),
        "sets",
    )
    labels = components(likely_edges(sets)).withColumnRenamed("node", "set")
    members = sets.select("set", "doc", "copies", "size", "least").join(labels, "set")
    checked = written(verified(docs, members, text, key), "checked")
    across = components(checked.where("cut AND set <> root").select(F.col("set").alias("x"), F.col("root").alias("y")))
    links = checked.groupBy("set").agg(F.sum("links").alias("links"), F.max("cut").alias("cut"), F.min("root").alias("root"))
    own = sets.select("set", "doc", "id", "copies").join(links, "set", "left").join(across.withColumnRenamed("node", "set"), "set", "left")
    # In a component of one block the root is that of the class; in a cut one the label is, or the set stands alone.
    of_class = own.withColumn("class", F.coalesce("label", F.when(~F.col("cut"), F.col("root")), "set"))
    firsts = of_class.groupBy("class").agg(F.min("doc").alias("first"), F.min("id").alias("class_id"))
    found = of_class.join(firsts, "class").select("set", "copies", F.coalesce("links", F.lit(0)).alias("links"), "first", "class_id")
    return sketches, written(found, "classes")


def joined(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: its id, ``class_id`` (the least id of its class that is not null) and ``n_links``, the documents its text is linked to."""
    sketches, sets = classes(docs, text, key)
    found = sketches.select("doc", "set", "size").join(sets, "set", "left")
    return found.select(
        F.col("doc.id").alias(key),
        F.coalesce(F.when(F.col("size") > 0, F.col("class_id")), F.col("doc.id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("copies") - 1 + F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows without those of a class but its first; of rows alike in id and text one stays."""
    sketches, sets = classes(docs, text, key)
    judged = sketches.select("doc", "set", "size").join(sets.select("set", "first"), "set", "left")
    stays = (F.col("size") == 0) | F.col("doc").eqNullSafe(F.col("first"))
    counted = judged.groupBy("doc").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    affected = written(counted.where("n > 1 OR NOT stays").select(F.col("doc").alias("other"), "stays"), "affected")
    rows = docs.select(F.struct("*").alias("row"), document(text, key).alias("doc"))
    slots = affected.select(F.col("other").alias("doc"))
    untouched = sieved(rows, slots, "left_anti").select("row.*")
    doubtful = sieved(rows, slots, "left_semi")
    left = doubtful.join(affected, F.col("doc").eqNullSafe(F.col("other")), "left").where("stays IS NULL OR stays")
    return untouched.unionByName(left.dropDuplicates(["doc"]).select("row.*"))
