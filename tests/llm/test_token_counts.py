import pytest
import sentencepiece

from ranlens.llm import token_counts
from ranlens.llm.catalog import op3_token_counts
from ranlens.llm.common import tokenizer_path

ODD = [
    "", " ", "  a\n\n  b \t\r\n c", "<s> </s><unk>▁▁x▁ y ▁", "a" * 5_000, "ab" * 300 + " " * 300 + "\n" * 70, "日本語テキスト１２３四五",
    "don't 12345 x　y\x1cz\x85w\x00q", "😀😃é <0x09>", " lead", "trail ", "\n", "\n The", " \n \n",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_counts.VOCABULARY))


@pytest.fixture
def own():
    counts = token_counts.Counts(tokenizer_path(token_counts.VOCABULARY))
    counts.use_table({})
    return counts


def test_counts_equal_the_librarys(own, library, texts):
    given = [*ODD, *(t or "" for t in texts.values())]
    assert own.count(given) == [len(ids) for ids in library.encode(given)]


def test_every_character_is_counted_like_the_library_does(own, library):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    given = ["".join(f"a{chr(c)}1 {chr(c)}\n{chr(c)}" for c in points[i : i + 5_000]) for i in range(0, len(points), 5_000)]
    assert own.count(given) == [len(ids) for ids in library.encode(given)]


def test_tables_and_full_caches_change_nothing(own, library, monkeypatch, texts):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 5)
    own.use_table({word: n for word, n in zip(own.pre_tokens("the text and more"), own.lengths(own.pre_tokens("the text and more")))})
    for text in list(texts.values())[:30]:
        assert own.count([text]) == [len(library.encode(text))]


def test_frequent_pre_tokens_of_a_small_table_are_all_of_them(spark):
    docs = spark.createDataFrame([(1, "to be or not to be"), (2, None), (3, "be")], "doc_id long, text string")
    found = token_counts.frequent_pre_tokens(docs, tokenizer_path(token_counts.VOCABULARY))
    assert found == ["▁be", "▁to", "▁not", "▁or"]


def test_the_table_comes_from_a_bounded_sample_and_counting_has_no_shuffle(spark, monkeypatch, documents):
    monkeypatch.setattr(token_counts, "SAMPLE_TASKS", 2)
    words = [f"w{i}" for i in range(64)]
    docs = spark.createDataFrame([(i, word) for i, word in enumerate(words)], "doc_id long, text string").repartition(16)
    sampled = token_counts.frequent_pre_tokens(docs, tokenizer_path(token_counts.VOCABULARY))
    assert 0 < len(sampled) < 64
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert found == dict(enumerate(token_counts.counts_of(tokenizer_path(token_counts.VOCABULARY)).count(words)))
    plan = token_counts.token_counts(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_query_equals_the_library(spark, folder, library, texts):
    rows = op3_token_counts(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        n = len(library.encode(text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > token_counts.TOKEN_LIMIT)


def test_odd_rows(odd_documents, no_documents):
    rows = token_counts.token_counts(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (2, 3)} == {(0, 0)}
    assert token_counts.token_counts(no_documents).collect() == []
