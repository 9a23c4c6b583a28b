import math
import re
from collections import Counter

import numpy as np
import pytest

from ranlens.llm import quality
from ranlens.llm.catalog import op4_quality_rules

FALLING = [quality.FEATURES.index(name) for name in quality.FALLING]


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words),
        sum(len(w) for w in words),
        sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(again),
    )


def test_the_query_counts_as_by_brute_force_and_keeps_what_is_labelled_good(spark, folder, texts):
    rows = op4_quality_rules(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        counts = brute_counts(texts[row.doc_id])
        assert tuple(row[name] for name in quality.COUNTS) == counts
        assert row.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (row.base_failed and row.kept)


def test_verdicts_agree_with_labels_that_were_not_learned(spark, folder, documents):
    labels = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.1')}/labels.parquet")
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.1')}/documents.parquet")
    learned = labels.where("doc_id % 2 = 0")
    judged = quality.quality_verdicts(docs, learned).where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id")
    good, bad = (judged.where(f"quality = {q}").select("kept").toPandas().kept for q in (1, 0))
    assert good.mean() > 0.99 and bad.mean() < 0.05 and len(bad) > 20


def test_the_score_never_rises_with_a_constrained_feature():
    random = np.random.default_rng(1)
    x = random.random((400, len(quality.FEATURES)))
    y = (x[:, 0] + random.normal(size=400) * 0.3 > 0.5).astype(float)
    trees = quality.fit(x, y, FALLING)
    for j in FALLING:
        moved = np.repeat(x[:50], 40, axis=0)
        moved[:, j] = np.tile(np.linspace(-1, 2, 40), 50)
        assert (np.diff(trees.score(moved).reshape(50, 40), axis=1) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8


def test_words_in_repeated_windows():
    for words in ("a b c", "a b c a b c", "a a a a", "a a a", "x y z q x y z", "a b a b a b a", ""):
        _, *_, repeated = quality.statistics(words)[0]
        assert repeated == brute_counts(words)[4]


def test_odd_rows(odd_documents, no_documents, no_labels):
    rows = quality.quality_verdicts(odd_documents, no_labels).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert quality.quality_verdicts(no_documents, no_labels).collect() == []


def test_labels_may_be_null_repeated_or_of_unknown_ids(spark, odd_documents):
    schema = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (5, None, None), (None, 1, "y"), (99, 0, "z"), (6, 0, "")], schema)
    assert quality.quality_verdicts(odd_documents, labels).count() == odd_documents.count()


def plain_score(text, trees):
    """The probability of quality, by plain counts and by walking each tree from its root."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n, chars = len(words), sum(map(len, words))
    capital = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or ("À" <= c <= "Þ" and c != "×") for c in text)
    letter = capital + sum("a" <= c <= "z" or c >= "ß" for c in text)
    _, _, symbols, duplicates, repeated = brute_counts(text)
    features = [
        math.log1p(n), chars / n, symbols / n, duplicates / len(lines), repeated / n, capital / max(letter, 1), text.count("!") / n,
        len(set(words)) / n, letter / chars, sum("0" <= c <= "9" for c in text) / chars, math.log1p(n / len(lines)),
        sum(line.rstrip()[-1:] in (".", "!", "?", '"', ":", ";") for line in lines) / len(lines), max(Counter(words).values()) / n,
    ]
    odds = trees.base
    for node in trees.roots:
        while trees.left[node] != node:
            node = (trees.left if features[trees.feature[node]] <= trees.threshold[node] else trees.right)[node]
        odds += trees.value[node]
    return 1 / (1 + math.exp(-odds))


def test_verdicts_equal_plain_walks_of_the_trees(spark, folder, documents):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    x, y = quality.sample_features(documents, labels, "text", "doc_id", quality.SAMPLE_ROWS)
    trees = quality.fit(x, y, [quality.FEATURES.index(name) for name in quality.FALLING])
    texts = {r.doc_id: r.text for r in documents.collect()}
    judged = [r for r in quality.quality_verdicts(documents, labels).collect() if r.n_words]
    assert len(judged) > 100
    for row in judged:
        score = plain_score(texts[row.doc_id], trees)
        assert row.score == pytest.approx(score, abs=1e-9)
        assert row.kept == (not row.base_failed and score >= quality.KEEP_FROM) or abs(score - quality.KEEP_FROM) < 1e-9
