"""Mixing sources to target weights by weighted sampling without replacement (operator 5).

Sources in the order of their code points (null last) weigh 5, 2, 1, and so on in turn, and share the words of all
documents; a source's target stops at ``MAX_EPOCHS`` times its size, and what is over is shared anew.
From each source the mix takes whole epochs first, then a fraction: its documents in the order of exponential
keys, -ln(u) / w, u a hash of the row and w its quality weight, each taken if it still fits into what
is left of the target (Efraimidis and Spirakis). This goes by rounds: a prefix of the documents that are no longer than
the gap is taken, the one that would cross it is passed over, and the next round goes on behind it with the gap that is
left, until no document fits. Each round reads only what the round before left behind: documents behind the one it passed
over that are no longer than the gap, which soon are few. At last the one whose size comes nearest to the gap is added, if that is nearer
than nothing, so a source misses its target by half its smallest untaken document at most.

Only ids, sizes and keys are shuffled. A source's prefix sums are taken in two levels, over buckets of keys with
about ``BUCKET_ROWS`` rows and within them, so a source of any share spreads over all tasks; only buckets that begin
before the gap is full are summed within. What a source takes is one row (epochs, a range of keys and a gap for each
round, the added document), so the texts themselves never move: each row is compared with its
source's limits where it is read. The targets need one row a source in one task. Each round leaves a gap under the size
of the document it passed over, so a few rounds do; their number has no cap.

A null text has size 0, as has one without words; such documents are taken 0 times. Rows alike in id,
source and text have the same key and share their fate, as one document of their summed size. An empty table gives an empty mix. Other columns
are carried by ``mixed`` and not read by ``takings``. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranlens.llm.common import WORD_PATTERN, superseded, written

#: Weights of the sources in turn.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of a bucket of keys, about.
BUCKET_ROWS = 4_096
#: What lowers a document's quality weight, by its number for each word, and the least weight.
JUNK_PATTERN, LEAST_WEIGHT = r"[#*$%&|<>!]", 0.1


def size_of(text: str) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows with their size, quality weight, and place (exponential key, then id and hash) in their source."""
    hashed = F.xxhash64(text)
    junk = F.coalesce(F.regexp_count(text, F.lit(JUNK_PATTERN)), F.lit(0))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), hashed), 11) + 0.5) / 2.0**53
    return (
        docs.withColumn("_size", size_of(text))
        .withColumn("_weight", F.greatest(F.lit(LEAST_WEIGHT), 1 - junk / F.greatest("_size", F.lit(1))))
        .withColumn("_key", -F.log(uniform) / F.col("_weight"))
        .withColumn("_place", F.struct(F.col("_key"), F.col(key).cast("long"), hashed))
    )


def with_targets(sizes: DataFrame) -> DataFrame:
    """Sources with ``source_size``: their ``rank`` and ``target``.

    Filling works upward from the source whose limit is reached first: a source is capped if its limit is less than
    its share of what the sources before it leave.
    """
    by_name, everything = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    weights = F.array(*map(F.lit, WEIGHTS))
    by_limit = Window.orderBy("_limit_by_weight", "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
        .withColumn("_limit", MAX_EPOCHS * F.col("source_size").cast("double"))
        .withColumn("_limit_by_weight", F.col("_limit") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.sum("_w").over(onward))
        .withColumn("_capped", F.col("_limit_by_weight") < F.col("_level"))
        .withColumn("_first", F.min(F.when(~F.col("_capped"), F.struct("_limit_by_weight", "rank", "_level"))).over(everything))
        .withColumn("target", F.least("_limit", F.coalesce(F.col("_first._level") * F.col("_w"), F.col("_limit"))))
        .select("source", "rank", "source_size", "n_rows", "mean_weight", "target")
    )


def is_taken(place: Column, size: Column, rounds: Column) -> Column:
    """Whether a round took the document: its place is in the round's range and its size no more than the round's gap."""
    took = lambda r: F.coalesce(place > r["after"], F.lit(True)) & (place <= r["last"]) & (size <= r["gap"])
    return F.coalesce(F.exists(rounds, took), F.lit(False))


def filling(placed: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per ``rank`` the ``gap`` that is left when no document fits any more, and its ``rounds``.

    ``placed`` has rank, bucket, place and size of the documents, ``gaps`` the rank and gap of each source.
    """
    whole = gaps.select("rank", F.col("gap").cast("double").alias("gap"), F.lit(None).cast(placed.schema["place"].dataType).alias("after"))
    ahead = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("rank", "bucket").orderBy("place")  # rows alike end at the same sum
    pending, steps = written(whole, "gaps"), []
    rest = placed.where("size > 0")
    while True:
        fitting = rest.join(pending, "rank").where(F.col("size") <= F.col("gap"))
        starts = (
            fitting.groupBy("rank", "bucket", "gap")
            .agg(F.sum("size").alias("bucket_size"))
            .withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
            .where(F.col("start") < F.col("gap"))
            .select("rank", "bucket", "start")
        )
        starts = written(starts, "starts")
        summed = fitting.join(starts, ["rank", "bucket"]).withColumn(
            "end", F.col("start") + F.sum("size").over(within)
        )
        fits = F.col("end") <= F.col("gap")
        step = written(
            summed.groupBy("rank", "gap", "after").agg(
                F.max(F.when(fits, F.col("place"))).alias("last"),
                F.coalesce(F.max(F.when(fits, F.col("end"))), F.lit(0)).alias("filled"),
                F.min(F.when(~fits, F.col("place"))).alias("crossing"),
            ),
            "round",
        )
        steps.append(step)
        superseded(starts)
        going = step.where(F.col("crossing").isNotNull() & (F.col("filled") < F.col("gap")))
        if going.isEmpty():
            break
        pending = written(going.select("rank", (F.col("gap") - F.col("filled")).alias("gap"), F.col("crossing").alias("after")), "gaps")
        # What a round passes over or finds too long never fits again.
        behind = rest.join(pending, "rank").where((F.col("place") > F.col("after")) & (F.col("size") <= F.col("gap")))
        before, rest = rest, written(behind.select("rank", "bucket", "place", "size"), "rest")
        if len(steps) > 1:  # the first is all documents, which are needed to the end
            superseded(before)
    every = steps[0].withColumn("round", F.lit(0))
    for i, step in enumerate(steps[1:], 1):
        every = every.unionByName(step.withColumn("round", F.lit(i)))
    took = F.when(F.col("last").isNotNull(), F.struct("after", "last", "gap"))
    found = every.groupBy("rank").agg(F.collect_list(took).alias("rounds"), F.sum("filled").alias("filled"))
    left = gaps.join(found, "rank", "left").withColumn("gap", F.col("gap") - F.coalesce("filled", F.lit(0)))
    return written(left.select("rank", "gap", "rounds"), "filled")


def limits(rows: DataFrame) -> DataFrame:
    """For each source of the keyed rows its size, target, ``epochs``, the ``rounds`` that take beyond, and one ``added``."""
    sizes = rows.groupBy("source").agg(
        F.sum("_size").alias("source_size"), F.count("*").alias("n_rows"), F.avg("_weight").alias("mean_weight")
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = written(
        with_targets(sizes)
        .withColumn("epochs", epochs)
        .withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
        .withColumn("buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS)),
        "sources",
    )
    of_source = sources.select(F.col("source").alias("_source"), "rank", "mean_weight", "left", "buckets")
    spread = (1 - F.exp(-F.col("_key") * F.col("mean_weight"))) * F.col("buckets")
    placed = written(
        rows.join(of_source, rows["source"].eqNullSafe(F.col("_source")))
        .withColumn("bucket", F.least(F.floor(spread), F.col("buckets") - 1))
        .where("_size > 0 AND left > 0")
        .select("rank", "bucket", F.col("_size").alias("size"), F.col("_place").alias("place")),
        "mix",
    )
    filled = filling(placed, sources.select("rank", F.col("left").alias("gap")))
    off = F.abs(F.col("size") - F.col("gap"))
    untaken = ~is_taken(F.col("place"), F.col("size"), F.col("rounds"))
    added = (
        placed.join(filled, "rank")
        .where((F.col("size") < 2 * F.col("gap")) & untaken)
        .groupBy("rank", "place", "gap")
        .agg(F.sum("size").alias("size"))
        .where(off < F.col("gap"))
        .groupBy("rank")
        .agg(F.min(F.struct(off.alias("off"), "place")).alias("nearest"))
        .select("rank", F.col("nearest.place").alias("added"))
    )
    found = sources.join(filled, "rank").join(added, "rank", "left")
    return written(found.select("source", "source_size", "target", "epochs", "rounds", "added"), "limits")


def copies() -> Column:
    """How often a keyed row beside its source's limits is taken."""
    within = is_taken(F.col("_place"), F.col("_size"), F.col("rounds"))
    extra = (within | F.col("_place").eqNullSafe(F.col("added"))).cast("int")
    return F.when(F.col("_size") > 0, F.col("epochs") + extra).otherwise(0)


def beside_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The keyed rows beside the limits of their source; one row a source is joined, broadcast if Spark finds it small."""
    found = found.withColumnRenamed("source", "_source")
    return rows.join(found, rows["source"].eqNullSafe(found["_source"])).withColumn("_copies", copies())


def takings(docs: DataFrame) -> DataFrame:
    """Per row: its size, its source's size and target, and how many words of it the mix takes, repeats counted."""
    rows = written(keyed(docs.select("doc_id", "text", "source")).drop("text"), "keys")
    taken = beside_limits(rows, limits(rows))
    return taken.select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix, whole and each as often as it is taken."""
    rows = written(keyed(docs.select("doc_id", "text", "source")).drop("text"), "keys")
    whole = keyed(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")).drop("text")
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return beside_limits(whole, limits(rows)).where("_copies > 0").select("_row", repeated).select("_row.*")
