import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ranlens.llm import similar
from ranlens.llm.catalog import op8_jaccard_join
from ranlens.llm.components import components


VERIFIED = similar.verified


def brute(rows):
    """Links and the least id of the class of every row, by a full inverted index of word tuples."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    root, links, where = list(range(len(rows))), Counter(), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in where[s])
        for j, n in common.items():
            if 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
        for s in own:
            where[s].append(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, least[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def near_copies(seed=1):
    """Groups of near copies around and on both sides of the threshold, chains, copies, and short texts."""
    random = np.random.default_rng(seed)
    word = lambda: "".join(random.choice(list("abcdefgh"), 4))
    rows = []
    for size in (2, 3, 5, 40, 90):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for at in random.choice(120, random.integers(0, 3), replace=False):
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    chain = [word() for _ in range(100)]
    for _ in range(12):  # each is near the one before it only
        chain = chain[5:] + [word() for _ in range(5)]
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, text) for i, text in enumerate(["same text here"] * 4 + ["same text", "one", "one", "a b c d e", "a b c  d\ne"])]
    return rows


def test_the_query_equals_brute_force(spark, folder, texts):
    assert got(op8_jaccard_join(spark, folder)) == brute(list(texts.items()))


@pytest.mark.parametrize("block", [None, 16])
def test_near_copies_in_whole_and_cut_blocks(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(similar, "BUCKET_BLOCK", block)
        monkeypatch.setattr(similar, "COMPONENT_BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(similar.joined(docs)) == brute(rows)


def test_one_of_each_class_stays_whole(spark, odd_documents):
    rows = near_copies(2)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, doc string, hash long")
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in brute(rows)}
    left = similar.one_of_each(odd_documents).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 2, 3, 4, 5, 6, 7] and left[0].asDict().keys() == set(odd_documents.columns)


def test_a_null_id_in_a_class_leaves_the_class_whole(spark):
    rows = near_copies(3)[:10] + [(10, "same text here"), (11, "same text here")]
    expected = brute(rows)
    without = [(None if i in (0, 3, 11) else i, t) for i, t in rows]
    found = similar.joined(spark.createDataFrame(without, "doc_id long, text string")).collect()
    of_class = {i: c for i, c, _ in expected}
    least = {c: min(i for i, own in of_class.items() if own == c and i not in (0, 3, 11)) for c in of_class.values()}
    assert sorted(n for *_, n in expected) == sorted(r.n_links for r in found)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id) for r in found) == sorted(
        (-1 if i in (0, 3, 11) else i, least[c]) for i, c in of_class.items()
    )


def test_odd_rows(odd_documents, no_documents):
    rows = similar.joined(odd_documents).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in rows if r.n_links) == [(1, 1), (1, 1)]
    assert len(rows) == odd_documents.count()
    assert similar.joined(no_documents).collect() == [] == similar.one_of_each(no_documents).collect()


def test_words_and_shingles():
    for text in ("", " \n", "a", "a b c d", "a b c d e f", "é😀 b\tc\n\nd  e f g", "a b c d e a b c d e"):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert len(similar.word_hashes(text.encode())) == len(words)
        n = min(5, len(words))
        assert len(similar.shingles(text)) == (len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) if n else 0)
    assert len(set(similar.word_hashes(b"ab ba aab ab b").tolist())) == 4


def test_pruning_keeps_pairs_at_the_threshold_and_drops_others():
    random, needed = np.random.default_rng(7), similar.least_agreements()
    assert needed[0] == 0 and all(a <= b for a, b in zip(needed, needed[1:]))
    agree = random.random((20_000, similar.HASHES)) < 0.8
    apart = random.random((20_000, similar.HASHES)) < 0.4
    ours = np.zeros(similar.HASHES, dtype=np.uint16)
    assert len(similar.still_likely(ours, (~agree).astype(np.uint16))) >= 19_960
    assert len(similar.still_likely(ours, (~apart).astype(np.uint16))) <= 20


def test_dense_and_small_intersections_agree():
    random = np.random.default_rng(8)
    sets = [np.unique(random.choice(np.arange(60, dtype=np.uint64), 50)) for _ in range(30)]
    expected = [[len(np.intersect1d(a, b)) * 9 >= 4 * (len(a) + len(b)) for b in sets] for a in sets]
    every = np.ones((30, 30), dtype=bool)
    assert (similar.linked(sets, sets, every) == np.array(expected)).all()
    assert (similar.linked(sets[:3], sets[:4], every[:3, :4]) == np.array(expected)[:3, :4]).all()
    some = random.random((30, 30)) < 0.3
    assert (similar.linked(sets, sets, some) == (np.array(expected) & some)).all()


def test_pairs_of_a_component_are_pruned_before_they_are_verified(spark, monkeypatch):
    """A long chain, each text near the ones beside it, and some texts of other sizes that hold a part of one."""
    random = np.random.default_rng(9)
    word = lambda: "".join(random.choice(list("abcdefgh"), 4))
    chain, rows = [word() for _ in range(100)], []
    for i in range(150):
        chain = chain[2:] + [word() for _ in range(2)]
        rows.append((i, " ".join(chain[: 100 - i % 30])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    for block in (512, 16):
        monkeypatch.setattr(similar, "COMPONENT_BLOCK", block)
        kept = []
        monkeypatch.setattr(similar, "verified", lambda *args, run=VERIFIED: kept.append(similar.written(run(*args), "tried")) or kept[0])
        assert got(similar.joined(docs)) == expected
        pairs, linked = kept[0].groupBy().sum("pairs").first()[0], sum(n for *_, n in expected)
        assert linked > 500 and linked <= pairs <= 3 * linked and pairs < 150 * 149 / 6


def test_blocks_of_sizes_too_different_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "COMPONENT_BLOCK", 4)
    rows = [(bytes([i, j]), size, b"label") for i, size in enumerate((100, 101, 130, 160, 400)) for j in range(9)]
    found = similar.meetings(spark.createDataFrame(rows, "set binary, size int, label binary")).collect()
    of_class = {r["class"]: {(m.ca, m.cb) for m in r.meets} for r in found}
    assert all(b - a in (0, 1) for meets in of_class.values() for a, b in meets)
    sizes = {r["class"]: {x.size for x in found if x["class"] == r["class"]} for r in found}
    met = {(s, t) for a, b in set().union(*of_class.values()) if a in sizes and b in sizes for s in sizes[a] for t in sizes[b]}
    assert all((s, t) in met or (t, s) in met for s in (100, 101, 130, 160, 400) for t in (100, 101, 130, 160, 400) if 5 * min(s, t) >= 4 * max(s, t))
    # Two sets meet exactly once if their classes are near.
    places = {r.set: {(m.ca, m.a, m.cb, m.b) for m in r.meets} for r in found}
    blocks = {r.set: (r["class"], r.block) for r in found}
    for one in places:
        for other in places:
            together = places[one] & places[other]
            met_at = {m for m in together if {m[:2], m[2:]} == {blocks[one], blocks[other]}}
            assert len(met_at) == (abs(blocks[one][0] - blocks[other][0]) <= 1)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 3), (50, 51), (51, 50)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    expected = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)} | {50: 50, 51: 50}
    assert found == expected
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
