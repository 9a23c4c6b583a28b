"""The queries that apply each operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranlens.llm import (
    bpe,
    html_text,
    language,
    mixing,
    personal,
    pieces,
    prefix_trie,
    quality,
    resampling,
    secrets,
    similar,
    token_counts,
    vectors,
)
from ranlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trips(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.takings(table(spark, folder, "documents"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.found_secrets(table(spark, folder, "documents"))


def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return vectors.top_k(rows, rows.where("vec_id % 100 = 0"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar.joined(table(spark, folder, "documents"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_data(table(spark, folder, "documents"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predictions(docs, language.learned(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trips(table(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def queries() -> dict[str, Query]:
    """Every query of this part but the pipeline, by name."""
    named = (
        op1_html_text,
        op2_bpe_round_trip,
        op3_token_counts,
        op4_quality_rules,
        op5_source_mix,
        op6_secret_scan,
        op7_top_k,
        op8_jaccard_join,
        op9_personal_data,
        op10_language_id,
        op11_importance_resampling,
        op12_piece_round_trip,
        op13_prefix_trie,
    )
    return {query.__name__: query for query in named}


def oracle_sql() -> dict[str, str]:
    """The statements of the queries that SQL can express."""
    return {"op7_top_k": vectors.ORACLE_SQL, "op11_importance_resampling": resampling.ORACLE_SQL}
