import hashlib
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from ranlens.llm import bpe
from ranlens.llm.catalog import op2_bpe_round_trip
from ranlens.llm.common import tokenizer_path

ODD = [
    "", " ", "  a\n\n  b \t\r\n c", "<|endoftext|>x<|endoftext|><|endoftext|> y", "a" * 5_000, "ab" * 300 + " " * 300 + "\n" * 99,
    "don't we'LL I'd x　y\x1cz\x85w\x00", "日本語テキスト１２３四五", "😀😃é ½", "x" * 64 + " " + "y" * 65,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(tokenizer_path(bpe.VOCABULARY))


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_ids_and_texts_equal_the_librarys(own, library, texts):
    for text in [*ODD, *(t or "" for t in texts.values())]:
        expected = library.encode(text, add_special_tokens=False).ids
        found = own.encode([text])[0]
        assert ids_of(found) == expected
        assert own.decode(found) == library.decode(expected, skip_special_tokens=False)


def test_every_character_is_cut_like_the_librarys(own, library):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for begin in range(0, len(points), 20_000):
        text = "".join(f"a{chr(c)}1 {chr(c)}" for c in points[begin : begin + 20_000])
        assert ids_of(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_short_and_long_words_are_merged_alike(own):
    words = [w.encode() for w in ("international", "thndnttion", "aaaaaaaa", "überöä", "x")]
    assert [own.merge_long(w) for w in words] == [own.merge_short([w])[0] for w in words] == own.merge_short(words)


def test_a_full_cache_changes_nothing(library, monkeypatch, texts):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    own = bpe.Vocabulary(tokenizer_path(bpe.VOCABULARY))
    for text in list(texts.values())[:20]:
        assert ids_of(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_the_query_equals_the_library(spark, folder, library, texts):
    for row in op2_bpe_round_trip(spark, folder).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()


def test_odd_rows_round_trip(odd_documents, no_documents):
    rows = bpe.encoded(odd_documents)
    assert rows.columns == ["doc_id", "ids"]
    found = sorted((r.doc_id or 0, r.text) for r in bpe.decoded(rows).collect())
    assert found == sorted((r.doc_id or 0, r.text or "") for r in odd_documents.collect())
    assert bpe.round_trips(odd_documents).count() == odd_documents.count()
    assert bpe.round_trips(no_documents).collect() == bpe.encoded(no_documents).collect() == []
