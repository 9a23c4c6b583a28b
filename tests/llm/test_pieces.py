import random

import pytest
import sentencepiece

from ranlens.llm import pieces
from ranlens.llm.catalog import op12_piece_round_trip
from ranlens.llm.common import sha256, tokenizer_path

PATH = tokenizer_path(pieces.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.pieces_of(PATH)


def texts_of_all_kinds(names, n=3_000):
    r = random.Random(7)
    kinds = (
        lambda: "".join(r.choice(names) for _ in range(r.randint(1, 12))).replace(pieces.SPACE, " "),
        lambda: "".join(r.choice(" \n\tab▁eéß中</s><unk>😀\x00‍0123456789") for _ in range(r.randint(0, 60))),
        lambda: " " * r.randint(0, 70) + r.choice(["", "the", "\n"]) + " " * r.randint(0, 40),
        lambda: "".join(r.choice("aeionrst") for _ in range(r.randint(1, 300))),
        lambda: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 30))),
    )
    return [r.choice(kinds)() for _ in range(n)]


def expected(library, doc, text):
    ids = library.encode(text or "", add_eos=True)
    return doc, len(ids), sha256(" ".join(map(str, ids)).encode()), sha256(library.decode(ids).encode())


def in_order(rows):
    return sorted(rows, key=repr)


def test_the_query_equals_the_library(spark, folder, texts, library):
    got = op12_piece_round_trip(spark, folder).collect()
    assert in_order(map(tuple, got)) == in_order(expected(library, *item) for item in texts.items())


def test_any_text_is_encoded_and_decoded_as_by_the_library(own, library):
    for text in texts_of_all_kinds(list(own.ids)):
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True), text
        assert own.decode(ids) == library.decode(ids), text


def test_any_ids_are_decoded_as_by_the_library(own, library):
    r = random.Random(8)
    for _ in range(3_000):
        least, most = r.choice([(1, 259), (1, 32_000)])
        ids = [r.randrange(least, most) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_the_table_holds_the_last_token_of_every_prefix(own, library):
    word = "▁internationalisation"
    last = own.last_tokens(word)
    for n in range(2, len(word) + 1):
        assert last[n] == library.encode(word[1:n])[-1]


def test_a_pair_is_compatible_if_the_rule_gives_it_back(own):
    r = random.Random(9)
    names = [n for n in own.ids if len(n) < 8]
    for _ in range(5_000):
        one, other = r.choice(names), r.choice(names)
        kept = own.merged(one) == [one] and own.merged(other) == [other]
        if kept:
            assert own.compatible(one, other) == (own.merged(one + other) == [one, other]), (one, other)


def test_a_long_word_and_full_caches(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 3)
    for text in ("ab" * 30_000, "one two three four five " * 20, "x" * 50_000):
        assert own.encode(text) == library.encode(text, add_eos=True)


def test_odd_and_no_rows(odd_documents, no_documents, library):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = in_order(map(tuple, pieces.round_trips(odd_documents).collect()))
    assert got == in_order(expected(library, *row) for row in rows)
    assert pieces.round_trips(no_documents).collect() == []


def test_encoded_texts_are_decoded_again(odd_documents):
    tokens = pieces.encoded(odd_documents)
    texts = in_order((r.doc_id, r.text or "") for r in odd_documents.collect())
    assert in_order(map(tuple, pieces.decoded(tokens).collect())) == texts


def test_ids_that_are_null(spark):
    tokens = spark.createDataFrame([(1, None), (2, [None, 263]), (3, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decoded(tokens).collect())) == [(1, ""), (2, pieces.pieces_of(PATH).decode([263])), (3, "")]
