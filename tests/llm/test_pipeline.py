from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from ranlens.llm import bpe, catalog, language, mixing, personal
from ranlens.llm.common import tokenizer_path, written
from tests.llm.test_similar import brute


@pytest.fixture(scope="module")
def stages(spark, folder, documents):
    """The rows after each stage, the documents first."""
    docs, seen = documents, [documents.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        seen.append(docs.collect())
    return seen


def test_every_query_is_registered():
    names = entry_module.queries().keys()
    assert {*catalog.queries(), "pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries()) == list(range(1, 14))


def test_language_stage_drops_only_what_cannot_be_told(stages):
    before, after = stages[0], stages[1]
    gone = Counter(before) - Counter(after)
    assert not Counter(after) - Counter(before)
    assert all(len(row.text or "") < 500 for row in gone) and len(gone) < 0.02 * len(before)


def test_a_corpus_without_learned_languages_keeps_its_texts(spark, folder, documents):
    held = documents.where(language.held_out("doc_id"))
    odd = spark.createDataFrame([(-1, "12 + 3", None, "a", 6), (-2, None, None, "a", None)], documents.schema)
    for docs in (documents.limit(50).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "source", "n_chars"), held.limit(50)):
        kept = corpus_pipeline.identify_language(spark, docs.unionByName(odd), folder).collect()
        assert Counter(kept) == Counter(r for r in docs.collect() if any(map(str.isalpha, r.text or ""))) and len(kept) > 40


def test_one_document_of_each_class_stays(stages):
    classes = brute([(r.doc_id, r.text) for r in stages[1]])
    assert sorted(r.doc_id for r in stages[2]) == sorted({c for _, c, _ in classes})
    assert not Counter(stages[2]) - Counter(stages[1])


def test_personal_data_is_masked_and_counted_anew(stages):
    before, after = {r.doc_id: r for r in stages[2]}, {r.doc_id: r for r in stages[3]}
    assert before.keys() == after.keys()
    changed = [i for i in after if before[i].text != after[i].text]
    assert changed and all(any(f"<{k.upper()}>" in after[i].text for k in personal.KINDS) for i in changed)
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    assert all(before[i].asDict() == after[i].asDict() for i in after if i not in changed)


def test_the_mix_holds_whole_documents_up_to_three_times(spark, stages):
    docs = spark.createDataFrame(stages[3])
    taken = {r.doc_id: r.taken // r.size for r in mixing.takings(docs).collect() if r.size}
    times = Counter(r.doc_id for r in stages[4])
    assert all(times[i] == n <= 3 for i, n in taken.items()) and set(stages[4]) <= set(stages[3])


def test_ids_are_those_of_the_texts(stages):
    library = Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
    texts = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for row in stages[5][:100]:
        assert row.ids == library.encode(texts[row.doc_id], add_special_tokens=False).ids


def test_the_registered_query_runs_all_stages(spark, folder, stages):
    rows = entry_module.queries()["pipeline"](spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == Counter((r.doc_id, tuple(r.ids)) for r in stages[5])


def run_stages(spark, docs, folder):
    found = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
        found.append(docs.collect())
        assert docs.columns == (list(corpus_pipeline.COLUMNS) if name != "encode" else ["doc_id", "ids"])
    return found


def test_stages_give_odd_rows_what_the_docstring_says(spark, folder, documents, odd_documents):
    odd = odd_documents.select(*corpus_pipeline.COLUMNS)
    docs = documents.where("lang IS NOT NULL").limit(150).select((F.col("doc_id") + 1_000).alias("doc_id"), *corpus_pipeline.COLUMNS[1:])
    told, single, masked, mixed, ids = run_stages(spark, docs.unionByName(odd).withColumn("spans", F.lit("extra")), folder)
    of = lambda rows: [r for r in rows if r.doc_id is None or r.doc_id < 1_000]
    assert {r.doc_id for r in of(told)} <= {1, None, 5, 6} and {1, None} <= {r.doc_id for r in of(told)}
    assert Counter(r.doc_id for r in of(told))[1] == 2 and Counter(r.doc_id for r in of(single))[1] == 1
    assert Counter(told)[of(told)[0]] >= 1 and not Counter(single) - Counter(told)
    text = next(r.text for r in masked if r.doc_id is None)
    assert text == "a text without an id, but with a mail <EMAIL>"
    long = {r.doc_id: len(r.text) for r in masked if r.doc_id == 5}
    assert all(n == len("der lange text hat viele worte " * 4_000) for n in long.values())
    assert set(mixed) <= set(masked) and Counter(r.doc_id for r in ids) == Counter(r.doc_id for r in mixed)


def test_empty_tables_give_no_rows(spark, folder, no_documents):
    assert run_stages(spark, no_documents, folder) == [[]] * 5
    assert language.UNKNOWN == "und"
