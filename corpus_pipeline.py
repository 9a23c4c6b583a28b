"""A training corpus from raw documents: each stage's rows are written as Parquet and read by the next.

``run(spark, sf_dir)`` applies STAGES to the documents of a folder. All stages but the last return the columns of
documents: the language stage drops documents whose language cannot be told (if no language could be learned,
those without a letter only), the near-duplicate stage leaves one document
of each class, the personal-data stage masks what it finds (and counts the characters anew), and the mix
repeats whole documents or leaves them out. The last returns the ids of the tokens of every text.

Documents whose text is null, or has no letter, have no language and go in the first stage. A null language or source is a value
like others: such a row teaches the language stage nothing, and the mix has it in a source of its own, the last. A null
doc_id stays null through all stages. Rows alike in id and text are one near-duplicate class of which one stays. Texts of any
length are whole in every stage. Columns beside those of documents are not carried. An empty table gives no rows.

SQL cannot express the stages, so ORACLE_SQL is None; tests hold the rows against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ranlens.llm import bpe, language, mixing, personal, similar
from ranlens.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, and ambiguous ones, go.

    If nothing could be learned, no language can be told, and only those without a letter go.
    """
    model = language.learned(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.predictions(docs, model, carried=COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts, the one with the least id."""
    return similar.one_of_each(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its findings replaced by their kind."""
    counted = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))
    return personal.masked(docs.select(*COLUMNS)).withColumn("n_chars", counted)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of its text, for every document of the mix."""
    return bpe.encoded(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("encode", encode_texts),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
