"""The trie of conversation prefixes (operator 13).

Conversations are rebuilt first: the turns are put in order, and each conversation begins with the first turns of its
base. A turn is known by the digest of its role and text, so texts are read once and never move.

The trie is made from matrices of turn ids, a row a conversation, padded at the right. Rows lie in shards by the
range of their turn digests, so a prefix is a contiguous run of rows. In a shard, numpy's lexsort puts the rows in
order; a mask per column marks where a row's turn differs from that of the row before, and an OR accumulated over
columns turns marks into node starts at every depth; reduceat over the starts gives the members, the least member and
the ends of all nodes of a depth at once, and sums over subtrees run from the deepest column to the first. A node that touches
the first or last row of its shard may go on in another one: only these boundary nodes, at most two a depth and shard, are
recombined by their key, and the sums of a boundary node are those of its closed children and of all boundary nodes below it.

Long conversations are cut into segments of ``width`` turns, so a matrix has that many columns at most. A segment
lies under its context, the digest of all turns before it, which is made of digests of blocks of segments, level by level. Each
context has a trie of its own. What lies under a context is summed by doubling (of the next segment, of
the next two, four, ...) and enters the last column of the segment above as if it were there.

Equal conversations are dealt out by their id, a conversation of any length by its turns, so neither gathers in one task;
a shard has about ``SHARD_ROWS`` segments. One thing is sequential by its nature: the digest of the ends of a node. The ids of a
boundary node's ends are joined in the shards, and one task feeds these strings to the digest, one after the other.

Turns without a conversation id take no part. A turn number that is null comes first; turns with one number come in the order
of their digests. Null roles and texts are empty; repeated rows are repeated turns. A base that is absent has no turns. For negative ids
the remainder is negative, as in SQL. Other columns are not read. An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ranlens.llm.common import mapped, sha256, superseded, written

#: Turns of a segment, and segments of a block (at each level) when contexts are made.
WIDTH = 32
BLOCK = 64
#: Segments of a shard, and turns of a range in which turns are numbered.
SHARD_ROWS, RANGE_ROWS = 20_000, 500_000
#: Conversations that share a base, and one more than the most turns taken from it.
FAMILY, DONATED = 100, 6
DIGEST = 16
NOTHING = sha256(b"")

NODE = (
    "shard int, closed boolean, key binary, parent binary, above array<binary>, seg int, ctx binary, depth int, next_ctx binary, "
    "conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, chars long, "
    "more_children long, more_leaves long, more_saved long, ends_sha256 string, ends string"
)


def digest(*columns: Column | str) -> Column:
    """The first DIGEST bytes of the SHA-256 of columns put together."""
    return F.unhex(F.substring(F.sha2(F.concat(*columns), 256), 1, 2 * DIGEST))


def put_together(items: Column) -> Column:
    """The binary values of an array as one."""
    return F.aggregate(items, F.expr("X''"), lambda whole, x: F.concat(whole, x))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``fp`` (the digest of role and text) and ``chars``, for every turn.

    Turns are dealt out by range, so the turns of one conversation may lie in several ranges; those of the ranges before count.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("fp"),
        F.length(text).cast("long").alias("chars"),
    )
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    order = [F.asc_nulls_first("turn"), F.asc("fp")]
    dealt = rows.repartitionByRange(ranges, "conv_id", *order).withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("range", "conv_id").orderBy(*order)
    dealt = written(dealt.withColumn("pos", F.row_number().over(inside) - 1).drop("turn"), "turns")
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row a range: that of the conversation which began before it.
    before = dealt.groupBy("conv_id", "range").count().withColumn("before", F.sum("count").over(ahead))
    before = before.where("before > 0").select("conv_id", "range", "before")
    joined = dealt.join(F.broadcast(before), ["conv_id", "range"], "left")
    return joined.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "fp", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``conv_id``, ``length``, ``pos``, ``fp``, ``chars`` of rebuilt conversations, and the ids of those without a turn.

    ``turns`` is as ``numbered_turns`` gives it.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % DONATED).cast("int")
    convs = sizes.withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_turns", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "head", "taken", "length"), "conversations")
    own = turns.join(convs, "conv_id").where("pos >= head").withColumn("pos", F.expr("pos - head + taken"))
    donors = turns.where(F.col("pos") < DONATED - 1).withColumnRenamed("conv_id", "base")
    given = donors.join(convs, "base").where("pos < taken")
    columns = ("conv_id", "length", "pos", "fp", "chars")
    return own.select(*columns).unionByName(given.select(*columns)), convs.where("length = 0").select("conv_id")


def segments(rows: DataFrame, turnless: DataFrame, width: int) -> DataFrame:
    """``conv_id``, ``seg``, ``more`` (whether another follows), ``path`` (the digests of its turns) and ``chars``."""
    seg = F.expr(f"cast(pos div {width} as int)")
    items = F.array_sort(F.collect_list(F.struct("pos", "fp", "chars")))
    found = rows.groupBy("conv_id", "length", seg.alias("seg")).agg(items.alias("items"))
    found = found.select(
        "conv_id",
        "seg",
        (F.col("length") > (F.col("seg") + 1) * width).alias("more"),
        put_together(F.col("items.fp")).alias("path"),
        F.col("items.chars").alias("chars"),
    )
    none = turnless.selectExpr("conv_id", "0 AS seg", "false AS more", "X'' AS path", "cast(array() AS array<bigint>) AS chars")
    return found.unionByName(none)


def contexts(parts: DataFrame) -> DataFrame:
    """``conv_id``, ``i`` and ``ctx``: the digest of all parts of a conversation before its i-th, from ``conv_id``, ``i``, ``fp``.

    Parts are put together in blocks, and what comes before a block is found in the same way, so no list is
    longer than a block, and each level has a fraction of the rows of that below.
    """
    blocks = parts.withColumn("block", F.expr(f"i div {BLOCK}"))
    ahead = Window.partitionBy("conv_id", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("ahead", put_together(F.collect_list("fp").over(ahead)))
    if parts.agg(F.max("i")).first()[0] < BLOCK:
        return blocks.select("conv_id", "i", digest("ahead").alias("ctx"))
    whole = blocks.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("i", "fp"))).alias("items"))
    whole = written(whole.select("conv_id", F.col("block").alias("i"), digest(put_together(F.col("items.fp"))).alias("fp")), "blocks")
    above = contexts(whole).withColumnsRenamed({"i": "block", "ctx": "above"})
    return blocks.join(above, ["conv_id", "block"]).select("conv_id", "i", digest("above", "ahead").alias("ctx"))


def key_of(seg: int, ctx: bytes, depth: int, path: bytes) -> bytes:
    """The name of a node: its context and the turns from there."""
    return hashlib.sha256(b"%d:%d:%d:" % (seg, depth, len(ctx)) + ctx + path[: DIGEST * depth]).digest()[:DIGEST]


def ids_of(paths: list[bytes]) -> np.ndarray:
    """A number for each turn of the paths, one after the other, in the order of their digests."""
    halves = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    differs = np.ones(len(halves), dtype=bool)
    differs[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
    ids = np.empty(len(halves), dtype=np.int64)
    ids[order] = np.cumsum(differs)
    return ids


def padded(values: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
    """Rows of the lengths given, filled up to the longest."""
    matrix = np.full((len(lengths), int(lengths.max())), fill, dtype=np.int64)
    matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = values
    return matrix


def shard_nodes(rows: pa.Table, segment: int) -> pa.RecordBatch:
    """The nodes of one shard, of segments of that many turns; those that touch its first or last row are left open."""
    paths, contexts_ = rows["path"].to_pylist(), list(zip(rows["seg"].to_pylist(), rows["ctx"].to_pylist()))
    lengths = np.array([len(p) // DIGEST for p in paths])
    chars = np.concatenate([np.array(c, dtype=np.int64) for c in rows["chars"].to_pylist()])
    turn, chars = padded(ids_of(paths), lengths, 0), padded(chars, lengths, 0)
    rank = {c: i for i, c in enumerate(sorted(set(contexts_)))}
    context = np.array([rank[c] for c in contexts_])
    conv = rows["conv_id"].to_numpy()
    order = np.lexsort((conv, *turn.T[::-1], context))
    conv, lengths, turn, chars, context = conv[order], lengths[order], turn[order], chars[order], context[order]
    more = rows["more"].to_numpy(zero_copy_only=False)[order]
    extra = {c: rows[c].to_numpy()[order] for c in ("more_children", "more_leaves", "more_saved")}
    next_ctx = rows["next_ctx"].to_pylist()
    n, width = turn.shape

    starts_node = np.ones((n, width + 1), dtype=bool)
    starts_node[1:, 0] = context[1:] != context[:-1]
    starts_node[1:, 1:] = turn[1:] != turn[:-1]
    np.logical_or.accumulate(starts_node, axis=1, out=starts_node)

    shard = rows["shard"][0].as_py()
    keys: dict[tuple[int, int], bytes] = {}

    def key(row: int, depth: int) -> bytes:
        if (row, depth) not in keys:
            keys[row, depth] = key_of(*contexts_[order[row]], depth, paths[order[row]])
        return keys[row, depth]

    found: list[tuple] = []
    below = None  # starts, closed, leaves, saved of the nodes one turn deeper, and their places in ``found``
    pending: list[tuple] = []
    for depth in range(width, -1, -1):
        runs = np.flatnonzero(starts_node[:, depth])
        real = lengths[runs] >= depth
        stops = np.append(runs[1:], n)[real]
        ends_here = (lengths == depth) & ~more
        n_ends = np.add.reduceat(ends_here.astype(np.int64), runs)[real]
        least = np.minimum.reduceat(conv, runs)[real]
        last_column = depth == segment
        added = {c: np.maximum.reduceat(v, runs)[real] if last_column else np.zeros(int(real.sum()), np.int64) for c, v in extra.items()}
        runs = runs[real]
        open_ = (runs == 0) | (stops == n)
        size = chars[runs, depth - 1] if depth else np.zeros(len(runs), np.int64)
        children, leaves, saved = (np.zeros(len(runs), np.int64) for _ in range(3))
        if below is not None:
            child_runs, child_closed, child_leaves, child_saved = below
            parents = np.searchsorted(runs, child_runs, side="right") - 1
            for total, part in ((children, child_closed), (leaves, child_leaves * child_closed), (saved, child_saved * child_closed)):
                np.add.at(total, parents, part)
            pending.append((depth, parents, runs, open_, least))
        else:
            pending.append((depth, None, runs, open_, least))
        closed = ~open_
        # An open node's own share is added when all its parts have met.
        children[closed] += added["more_children"][closed]
        leaves[closed] += np.where(children[closed] == 0, 1, added["more_leaves"][closed])
        saved[closed] += (stops[closed] - runs[closed] - 1) * size[closed] + added["more_saved"][closed]
        follows = np.flatnonzero(more) if last_column else np.array([], dtype=np.int64)
        for i, (start, stop) in enumerate(zip(runs.tolist(), stops.tolist())):
            seg, ctx = contexts_[order[start]]
            ends = ""
            if n_ends[i]:
                here = conv[start:stop][ends_here[start:stop]] if last_column else conv[start : start + int(n_ends[i])]
                ends = ",".join(map(str, here.tolist()))
            after = None
            if len(follows):
                at = np.searchsorted(follows, start)
                after = next_ctx[order[follows[at]]] if at < len(follows) and follows[at] < stop else None
            is_open = bool(open_[i])
            found.append(
                (
                    shard, not is_open, key(start, depth) if is_open else None, (depth, i),
                    [key(start, d) for d in range(depth + 1)] if is_open else None, seg, ctx, depth, after, int(least[i]), None,
                    stop - start, int(children[i]), int(leaves[i]), int(saved[i]), int(size[i]),
                    *(int(added[c][i]) for c in extra), None if is_open else sha256(ends.encode()), ends if is_open else None,
                )
            )
        below = (runs, closed.astype(np.int64), leaves, saved)

    return with_parents(found, pending, key)


def with_parents(found: list[tuple], levels: list[tuple], key) -> pa.RecordBatch:
    """The nodes with what is known of their parents: the least member of a closed one, the key of an open one."""
    # ``levels`` runs from the deepest level up; each holds the places of the parents of the level before it.
    parents_of = {levels[i - 1][0]: levels[i] for i in range(1, len(levels))}
    rows = []
    for row in found:
        depth, i = row[3]
        parent, conv = None, None
        if depth in parents_of:
            above, parents, runs, open_, least = parents_of[depth]
            p = parents[i]
            if open_[p]:
                parent = key(int(runs[p]), above)
            else:
                conv = int(least[p])
        rows.append((*row[:3], parent, *row[4:10], conv, *row[11:]))
    names = [part.split()[0] for part in NODE.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
    types = [kinds[part.split()[1]] for part in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def of_shards(segs: DataFrame, width: int) -> DataFrame:
    """The nodes of all shards, as NODE says, written once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held) if (held := list(batches)) else None
        if table is not None and table.num_rows:
            yield shard_nodes(table.combine_chunks(), width)

    shards = max(1, -(-segs.count() // SHARD_ROWS))
    dealt = segs.repartitionByRange(shards, "seg", "ctx", "path", "conv_id").withColumn("shard", F.spark_partition_id())
    return written(mapped(dealt, build, NODE), "nodes")


def ends_of_open(opened: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of boundary nodes: their joined ends, shard after shard, fed to one digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, empty = None, None, True
        done: list[tuple[bytes, str]] = []

        def given() -> pa.RecordBatch:
            keys, digests = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests)], ["key", "ends_sha256"])

        for batch in batches:
            for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if key != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state, empty = key, hashlib.sha256(), True
                if ends:
                    state.update((ends if empty else "," + ends).encode())
                    empty = False
            if done:
                yield given()
        if current is not None:
            done.append((current, state.hexdigest()))
            yield given()

    rows = opened.select("key", "shard", "ends").where("ends <> ''").repartition("key").sortWithinPartitions("key", "shard")
    return mapped(rows.select("key", "ends"), run, "key binary, ends_sha256 string")


def recombined(nodes: DataFrame) -> DataFrame:
    """All nodes of the segments, boundary nodes whole again: NODE's columns but those of the parts, with parents."""
    opened = nodes.where("NOT closed")
    sums = ("n_convs", "n_children", "n_leaves", "saved")
    tops = ("chars", "more_children", "more_leaves", "more_saved", "next_ctx")
    firsts = ("parent", "above", "seg", "ctx", "depth")
    folded = opened.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in sums),
        *(F.max(c).alias(c) for c in tops),
        *(F.first(c).alias(c) for c in firsts),
    )
    folded = written(folded, "boundary")
    children = folded.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("open_children")).where("key IS NOT NULL")
    folded = folded.join(children, "key", "left").withColumn(
        "n_children", F.expr("n_children + coalesce(open_children, 0) + more_children")
    )
    own = folded.withColumn("n_leaves", F.expr("n_leaves + CASE WHEN n_children = 0 THEN 1 ELSE more_leaves END")).withColumn(
        "saved", F.expr("saved + (n_convs - 1) * chars + more_saved")
    )
    totals = own.select(F.explode("above").alias("key"), "n_leaves", "saved")
    totals = totals.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    parents = folded.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    kept = ("seg", "ctx", "depth", "next_ctx", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    boundary = (
        own.drop("n_leaves", "saved").join(totals, "key").join(parents, "parent", "left").join(ends_of_open(opened), "key", "left")
    ).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    closed = nodes.where("closed")
    # A shard's closed nodes look up the boundary nodes of their own shard.
    here = opened.select("shard", F.col("key").alias("parent")).join(parents, "parent").withColumnRenamed("parent_conv_id", "found")
    closed = closed.join(here, ["shard", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    return boundary.select(*kept).unionByName(closed.select(*kept))


def with_contexts(segs: DataFrame) -> DataFrame:
    """Segments with ``ctx`` and, where another follows, ``next_ctx``; first segments have the empty context."""
    long = segs.where("more OR seg > 0")
    chain = written(contexts(long.select("conv_id", F.col("seg").alias("i"), digest("path").alias("fp"))), "contexts")
    own = chain.select("conv_id", F.col("i").alias("seg"), F.col("ctx").alias("own"))
    after = chain.select("conv_id", (F.col("i") - 1).alias("seg"), F.col("ctx").alias("next_ctx"))
    found = long.join(own, ["conv_id", "seg"]).join(after, ["conv_id", "seg"], "left")
    found = found.withColumn("ctx", F.expr("CASE WHEN seg = 0 THEN X'' ELSE own END")).drop("own")
    short = segs.where("NOT more AND seg = 0").withColumn("ctx", F.expr("X''")).withColumn("next_ctx", F.expr("cast(null AS binary)"))
    return found.unionByName(short)


def under_contexts(segs: DataFrame, width: int) -> DataFrame:
    """``seg``, ``ctx`` and the children, leaves and savings of all that lies under each context of later segments."""
    later = segs.where("seg > 0")
    # That something follows is known, so the last turn is no leaf; what follows is added by doubling.
    bare = later.withColumn("more_children", F.expr("cast(more AS bigint)"))
    bare = bare.withColumn("more_leaves", F.lit(0).cast("long")).withColumn("more_saved", F.lit(0).cast("long"))
    roots = recombined(of_shards(bare, width)).where("depth = 0")
    totals = written(roots.select("seg", "ctx", "n_children", "n_leaves", "saved"), "totals")
    chain = later.select("conv_id", "seg", "ctx")
    one = written(chain.groupBy("seg", "ctx").agg(F.min("conv_id").alias("conv_id")), "members")
    deepest, step = totals.agg(F.max("seg")).first()[0], 1
    while step < deepest:
        ahead = chain.select("conv_id", (F.col("seg") + step).alias("seg"), F.col("ctx").alias("over"))
        owed = one.join(ahead, ["conv_id", "seg"]).join(totals, ["seg", "ctx"])
        owed = owed.groupBy((F.col("seg") - step).alias("seg"), F.col("over").alias("ctx")).agg(
            F.sum("n_leaves").alias("owed_leaves"), F.sum("saved").alias("owed_saved")
        )
        joined = totals.join(owed, ["seg", "ctx"], "left")
        before, totals = totals, written(
            joined.select(
                "seg",
                "ctx",
                "n_children",
                F.expr("n_leaves + coalesce(owed_leaves, 0)").alias("n_leaves"),
                F.expr("saved + coalesce(owed_saved, 0)").alias("saved"),
            ),
            "totals",
        )
        superseded(before)
        step *= 2
    return totals


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row a node: least member, depth, the parent's least member, members, children, and the leaves and savings of its subtree.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``; ``width`` is the number of turns of a segment.
    """
    rows, turnless = rebuilt(numbered_turns(turns))
    segs = written(segments(rows, turnless, width), "segments")
    extra = ("more_children", "more_leaves", "more_saved")
    deep = not segs.where("seg > 0").isEmpty()
    if deep:
        segs = written(with_contexts(segs), "paths")
        under = under_contexts(segs, width).select(
            (F.col("seg") - 1).alias("seg"), F.col("ctx").alias("next_ctx"), *(F.col(a).alias(b) for a, b in zip(("n_children", "n_leaves", "saved"), extra))
        )
        segs = segs.join(under, ["seg", "next_ctx"], "left").fillna(0, list(extra))
    else:
        segs = segs.withColumns({"ctx": F.expr("X''"), "next_ctx": F.expr("cast(null AS binary)")} | {c: F.lit(0).cast("long") for c in extra})
    nodes = recombined(of_shards(segs, width))
    if deep:
        nodes = written(nodes, "trie")
        above = nodes.where("next_ctx IS NOT NULL").select(
            (F.col("seg") + 1).alias("seg"), F.col("next_ctx").alias("ctx"), F.lit(1).alias("depth"), F.col("conv_id").alias("found")
        )
        nodes = nodes.where("seg = 0 OR depth > 0").join(above, ["seg", "ctx", "depth"], "left")
        nodes = nodes.withColumn("parent_conv_id", F.coalesce("found", "parent_conv_id"))
    return nodes.select(
        "conv_id",
        (F.col("seg") * width + F.col("depth")).cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
