import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ranlens.llm import language
from ranlens.llm.catalog import op10_language_id


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_documents_are_told(spark, folder, documents):
    folder = folder.replace("sf0.001", "sf0.01")
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op10_language_id(spark, folder).collect()
    assert len(rows) == len(known)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= set(known.values()) | {"und"}
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.ambiguous for r in rows]) < 0.01


def test_predictions_read_nothing_but_the_text(documents):
    model = language.learned(documents)
    told = {(r.doc_id, r.lang_pred, r.score) for r in language.predictions(documents, model).collect()}
    blind = documents.selectExpr("doc_id", "text")
    assert told == {(r.doc_id, r.lang_pred, r.score) for r in language.predictions(blind, model).collect()}


@pytest.mark.parametrize("n", [2, 3, 5, 8, 30])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2) and (np.abs(code.sum(axis=0)) < n).all()


def test_odd_rows(odd_documents, no_documents, spark):
    model = language.learned(odd_documents)
    rows = language.predictions(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (2, 3, 4, 7))
    assert language.predictions(no_documents, language.learned(no_documents)).collect() == []
    assert language.learned(odd_documents.where("lang IS NULL")).languages == []
    one = language.learned(odd_documents.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predictions(odd_documents, one).collect()} <= {"en", "und"}


def test_many_languages_are_decoded(spark):
    random = np.random.default_rng(6)
    rows = []
    for lang in range(9):
        syllables = ["".join(random.choice(list("abcdefghijklmnop"), 3)) for _ in range(25)]
        rows += [(len(rows) + i, " ".join(random.choice(syllables, 60)), f"l{lang}") for i in range(60)]
    docs = spark.createDataFrame([(i * 9 + k, t, lang) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    told = language.predictions(docs, language.learned(docs), carried=("doc_id", "lang")).where(language.held_out("doc_id"))
    assert told.where("lang = lang_pred").count() / told.count() > 0.98


def test_no_language_is_left_out_however_many_there_are(spark):
    random = np.random.default_rng(8)
    rows = []
    for lang in range(90):
        syllables = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(25)]
        rows += [(len(rows) + i, " ".join(random.choice(syllables, 80)), f"l{lang}") for i in range(12 + lang // 9)]
    rows.append((10**6, "ein einziger text", "rare"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(docs)
    assert set(model.languages) == {lang for i, _, lang in rows if not is_held_out(i)}
    assert model.code.shape[1] <= np.ceil(10 * np.log2(len(model.languages)))
    told = language.predictions(docs, model, carried=("doc_id", "lang")).where(language.held_out("doc_id"))
    assert told.where("lang = lang_pred").count() / told.count() > 0.98


@pytest.mark.parametrize("n", [100, 1_500])
def test_many_codewords_are_apart(n):
    code = language.codewords(n)
    assert language.least_distance(code) == min((code.shape[1] - np.delete(code, i, 0) @ code[i]).min() / 2 for i in range(n)) >= 10


def test_losses_are_those_of_the_codewords(monkeypatch):
    monkeypatch.setattr(language, "LOSSES", 50)
    random, code = np.random.default_rng(9), language.codewords(20)
    model = language.Model([str(i) for i in range(20)], code, np.zeros((1, 1)), np.ones(code.shape[1]), random.random(code.shape[1]))
    margins = random.normal(size=(33, code.shape[1]))
    losses = np.sort([[(model.reliability * np.exp(-c * m)).sum() for c in code] for m in margins])
    best, score = model.decode(margins)
    assert score == pytest.approx(1 - losses[:, 0] / losses[:, 1])
    assert [(model.reliability * np.exp(-code[b] * m)).sum() for b, m in zip(best, margins)] == pytest.approx(losses[:, 0])


def plain_grams(text):
    """The buckets of a text's n-grams, counted one by one."""
    gaps = "".join(c if c.isalpha() else " " for c in text.lower())
    if not gaps.strip():
        return Counter()
    points = [ord(c) for c in " " + re.sub(" +", " ", gaps.strip()) + " "]
    if not gaps[-1].isalpha():
        points.append(32)
    points = ([32] if not gaps[0].isalpha() else []) + points
    low, found = (1 << 32) - 1, Counter()
    for i, c in enumerate(points):
        one = c * 2654435761
        hashes = [one]
        if i:
            two = points[i - 1] * 2654435761 * 31 + c * 2246822519
            hashes.append(two)
            if i > 1:
                hashes.append((points[i - 2] * 2654435761 * 31 + points[i - 1] * 2246822519) * 37 + c * 3266489917)
        for h in hashes:
            h &= low
            found[(((h ^ (h >> 15)) * 2246822519) & low) >> 18] += 1
    return found


def plain_model(sample, code):
    """Weights, scales and reliabilities of each bit as dictionaries and lists, from (language, text, measured) rows."""
    languages = sorted({name for name, text, measured in sample if not measured and plain_grams(text)})
    shares = {}
    for name in languages:
        total = Counter()
        for own, text, measured in sample:
            if own == name and not measured:
                total += plain_grams(text)
        shares[name] = {g: n / total.total() for g, n in total.items()}
    bits, grams = range(code.shape[1]), set().union(*shares.values())

    def share(gram, bit, value):
        own = [shares[name].get(gram, 0.0) for i, name in enumerate(languages) if code[i][bit] == value]
        return sum(own) / len(own)

    smooth = 0.1 / language.BUCKETS
    weights = {g: [math.log(share(g, b, 1) + smooth) - math.log(share(g, b, -1) + smooth) for b in bits] for g in grams}

    def margins(text):
        found = plain_grams(text)
        return [sum(n * weights[g][b] for g, n in found.items() if g in weights) / found.total() for b in bits]

    measured = [(languages.index(name), margins(text)) for name, text, kept in sample if kept and plain_grams(text)]
    scale = [2 / max(float(np.median([abs(m[b]) for _, m in measured])), 1e-6) for b in bits]
    right = [min(0.999, max(0.5, sum(code[i][b] * m[b] > 0 for i, m in measured) / len(measured))) for b in bits]
    reliability = [math.log(p / (1.001 - p)) + 0.01 for p in right]

    def decoded(text):
        if not plain_grams(text or ""):
            return "und", 0.0
        signed = [min(8.0, max(-8.0, m * s)) for m, s in zip(margins(text), scale)]
        losses = [sum(reliability[b] * math.exp(-code[i][b] * signed[b]) for b in bits) for i in range(len(languages))]
        least, second = sorted(losses)[:2]
        return languages[losses.index(least)], 1 - least / second

    return decoded


def test_predictions_equal_a_plain_version(documents):
    docs = documents.select("doc_id", "text", "lang")
    sample = [(r.language, r.text, r.measure) for r in language.training_sample(docs, "text", "doc_id", "lang").collect()]
    model = language.learned(docs)
    decoded = plain_model(sample, model.code)
    for row in language.predictions(docs, model, carried=("doc_id", "text")).collect():
        name, score = decoded(row.text)
        assert row.score == pytest.approx(score, abs=1e-3)
        assert row.lang_pred == name or score < 1e-3
