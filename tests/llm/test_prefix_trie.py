import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from ranlens.llm import prefix_trie
from ranlens.llm.catalog import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, shard int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """The expected rows, from sets of members of every prefix."""
    own, members, ends, children = (defaultdict(list) for _ in range(4))
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    own = {c: [turn[3:] for turn in sorted(turns)] for c, turns in own.items()}
    for conv in sorted(own):
        h, base = zlib.crc32(str(conv).encode()) % 6, conv - int(math.fmod(conv, 100))
        path = (*own.get(base, [])[:h], *own[conv][h:])
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
        ends[path].append(conv)
    leaves, saved = {}, {}
    for node in members:
        if node:
            children[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = sum(saved[c] for c in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def got(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert df.columns == list(names)
    return sorted(tuple(-1 if x is None else x for x in row) for row in df.collect())


def test_the_query_equals_sets_of_members(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(op13_prefix_trie(spark, folder)) == brute(map(tuple, rows))


def conversations_of_all_kinds():
    r = random.Random(2)
    rows = [(None, 1, "u", "x"), (3, 1, "u", "a"), (3, 1, "u", "a")]
    for conv in [*range(60), *range(100, 130), 205, -7, -100]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 9, 30])):
            rows.append((conv, turn if r.random() < 0.95 else None, r.choice(["u", None]), r.choice(["a", "bb", "ccc", None])))
    for conv in (100, 101, 102, 160, 161, 162, 163):  # long ones, alike to the end
        rows += [(conv, turn, "u", "alike") for turn in range(40)]
    return rows


@pytest.mark.parametrize("width", [3, 64])
def test_shards_and_segments(spark, monkeypatch, width):
    for name, value in (("SHARD_ROWS", 12), ("RANGE_ROWS", 60), ("BLOCK", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations_of_all_kinds()
    df = spark.createDataFrame([(*row, 0, "k", 1) for row in rows], SCHEMA)
    assert got(prefix_trie.prefix_trie(df, width)) == brute(rows)


def test_equal_conversations_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 5)
    rows = [(conv, turn, "u", f"text {turn}") for conv in range(600, 660) for turn in range(4)]
    rows += [(conv, 0, "u", "alone") for conv in range(700, 705)]
    df = spark.createDataFrame([(*row, 0, "k", 1) for row in rows], SCHEMA)
    assert got(prefix_trie.prefix_trie(df)) == brute(rows)


def test_a_conversation_may_lose_all_its_turns(spark):
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(conv, 0, "u", "a"), (conv, 1, "u", "b")]  # its base is absent
    df = spark.createDataFrame([(*row, 0, "k", 1) for row in rows], SCHEMA)
    assert got(prefix_trie.prefix_trie(df)) == brute(rows) and len(brute(rows)) == 1


def test_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
