import os

from ranlens.llm import common
from ranlens.llm.components import components


def files_of(spark):
    folder = common.tables_folder(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_of_rounds_go_when_they_are_superseded(spark):
    before = files_of(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "x long, y long")
    assert components(edges).select("label").distinct().count() == 1
    assert len(files_of(spark) - before) == 1  # the labels that were returned


def test_a_written_table_is_read_from_its_folder_until_it_is_removed(spark):
    table = common.written(spark.range(5), "five")
    assert table.count() == 5 and os.path.basename(table._written_to) in files_of(spark)
    common.superseded(table)
    assert os.path.basename(table._written_to) not in files_of(spark)


def test_operators_leave_the_settings_of_the_session(spark, no_documents):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        common.mapped(spark.range(3), lambda batches: batches, "id long").count()
        assert spark.conf.get(name) == "10000"
    finally:
        spark.conf.set(name, kept)
