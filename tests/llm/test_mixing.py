import re

import pytest

from ranlens.llm import mixing
from ranlens.llm.catalog import op5_source_mix
from tests.conftest import plan_of


def brute_targets(sizes):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in capped]
        level = (total - sum(3 * sizes[n] for n in capped)) / sum(weight[n] for n in free) if free else 0
        over = {n for n in free if level * weight[n] > 3 * sizes[n]}
        if not over:
            return {n: 3 * sizes[n] if n in capped else level * weight[n] for n in names}
        capped |= over


def checked(rows, of):
    """Sizes, targets and takings of a mix; gives the distance from the target for each source."""
    sizes, taken, largest = {}, {}, {}
    for row in rows:
        source = of[row.doc_id][0]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", of[row.doc_id][1] or ""))
        assert row.size == words and row.taken <= 3 * words and (not words or row.taken % words == 0)
        sizes[source] = sizes.get(source, 0) + words
        taken[source] = taken.get(source, 0) + row.taken
        largest[source] = max(largest.get(source, 0), words)
    targets = brute_targets(sizes)
    for row in rows:
        source = of[row.doc_id][0]
        assert row.source_size == sizes[source] and row.target == pytest.approx(targets[source])
    return {s: (abs(taken[s] - targets[s]), largest[s]) for s in sizes}


def test_the_query_meets_its_targets_and_agrees_with_a_rerun(spark, folder, documents):
    of = {r.doc_id: (r.source, r.text) for r in documents.collect()}
    rows = op5_source_mix(spark, folder).collect()
    assert len(rows) == len(of)
    assert all(off <= largest / 2 for off, largest in checked(rows, of).values())
    assert sorted(rows) == sorted(op5_source_mix(spark, folder).collect())


def test_many_buckets_small_sources_caps_and_null_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i, "w " * (i % 13 + 1), None if i % 5 == 0 else "hot" if i % 5 < 3 else f"s{i % 37}") for i in range(600)]
    rows += [(1_000, "one", "tiny"), (1_001, None, "empty"), (1_002, "##!! junk", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    off = checked(mixing.takings(docs).collect(), {i: (s, t) for i, t, s in rows})
    assert all(distance <= largest / 2 for distance, largest in off.values())


def missed(docs, of):
    """For each source the distance of the mix from its target, and its smallest document that was left out (or taken once less)."""
    times = {r.doc_id: r.taken // r.size for r in mixing.takings(docs).collect() if r.size}
    off = checked(mixing.takings(docs).collect(), of)
    least = {}
    for doc, n in times.items():
        source, text = of[doc]
        least.setdefault(source, []).append((n, len(text.split())))
    return {s: (off[s][0], min((w for n, w in held if n == min(m for m, _ in held)), default=0)) for s, held in least.items()}


@pytest.mark.parametrize("bucket_rows", [4_096, 7])
def test_a_document_of_a_third_of_its_source_leaves_no_gap(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = []
    for source in range(12):
        small = [(source * 1_000 + i, "w " * (i % 9 + 2), f"s{source:02}") for i in range(1, 200)]
        rows += [(source * 1_000, "w " * (sum(len(t.split()) for _, t, _ in small) // 2), f"s{source:02}"), *small]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(off <= least / 2 for off, least in missed(docs, {i: (s, t) for i, t, s in rows}).values())


def test_rows_alike_are_one_document_of_their_summed_size(spark):
    rows = [(1, "w " * 30, "a")] * 5 + [(i, "w " * 7, "a") for i in range(2, 40)] + [(100 + i, "w " * 50, "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.takings(docs).collect()
    assert len({r.taken for r in taken if r.doc_id == 1}) == 1
    assert checked(taken, {i: (s, t) for i, t, s in rows})["a"][0] <= 7 / 2


def test_documents_of_more_quality_are_taken_more_often(spark):
    rows = [(i, "a good text of ten words with no signs in", "s") for i in range(2_000)]
    rows += [(i, "### *** a text of ten words with && || in", "s") for i in range(2_000, 4_000)]
    rows += [(i, "other words " * 30, "r") for i in range(4_000, 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.takings(docs).where("doc_id < 4000 AND taken = 0").selectExpr("doc_id < 2000 AS good").toPandas().good
    assert len(taken) == 0 or taken.mean() < 0.5
    half = mixing.keyed(docs.where("source = 's'")).orderBy("_place").limit(1_000).toPandas()
    assert (half.doc_id < 2_000).mean() > 0.7


def test_the_mix_repeats_whole_rows(odd_documents):
    mixed = mixing.mixed(odd_documents).collect()
    taken = {r.doc_id: (r.taken // r.size if r.size else 0) for r in mixing.takings(odd_documents).collect()}
    rows = odd_documents.collect()
    assert mixed and odd_documents.columns == list(mixed[0].asDict())
    for row in rows:
        assert mixed.count(row) == taken[row.doc_id] * rows.count(row)


def test_an_empty_table_and_the_plan(spark, folder, no_documents):
    assert mixing.takings(no_documents).collect() == [] == mixing.mixed(no_documents).collect()
    plan = plan_of(op5_source_mix(spark, folder))
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def plain_copies(keyed):
    """How often each row is taken, by a loop over each source's rows in the order of their keys."""
    sizes = {}
    for row in keyed:
        sizes[row.source] = sizes.get(row.source, 0) + row["_size"]
    targets, copies = brute_targets(sizes), {}
    for source, size in sizes.items():
        epochs = int(targets[source] // size) if size else 0
        gap = max(0.0, targets[source] - epochs * size)
        sums, each = {}, {}
        for row in keyed:
            if row.source == source and row["_size"]:
                place = tuple(row["_place"])
                sums[place], each[place] = sums.get(place, 0) + row["_size"], row["_size"]
        taken, rest = set(), sorted(sums)
        while rest:
            rest, filled, crossing = [p for p in rest if each[p] <= gap], 0, None
            for i, place in enumerate(rest):
                if filled + sums[place] > gap:
                    crossing = i
                    break
                filled += sums[place]
                taken.add(place)
            gap -= filled
            rest = rest[crossing + 1 :] if crossing is not None else []
        left = [(abs(sums[p] - gap), p) for p in sums if p not in taken and abs(sums[p] - gap) < gap]
        taken |= {min(left)[1]} if left else set()
        for place in sums:
            copies[source, place] = epochs + (place in taken)
    return copies


@pytest.mark.parametrize("bucket_rows", [4_096, 7])
def test_the_selection_equals_a_plain_loop(spark, monkeypatch, documents, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    odd = [(i, "w " * (i * i % 97 + 1 + 400 * (i % 50 == 0)), f"s{i % 4}" if i % 3 else None) for i in range(400)] + [(1, "w w", "s1")] * 5
    for docs in (documents, spark.createDataFrame(odd, "doc_id long, text string, source string")):
        keyed = mixing.keyed(docs.select("doc_id", "text", "source")).collect()
        expected = plain_copies(keyed)
        assert any(n == 0 for n in expected.values()) and any(n > 0 for n in expected.values())
        wanted = sorted((r.doc_id, r["_size"], r["_size"] * expected.get((r.source, tuple(r["_place"])), 0)) for r in keyed)
        assert sorted((r.doc_id, r.size, r.taken) for r in mixing.takings(docs).collect()) == wanted
