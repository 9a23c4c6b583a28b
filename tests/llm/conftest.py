import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").persist()


@pytest.fixture(scope="session")
def texts(documents):
    return {row.doc_id: row.text for row in documents.collect()}


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names an operator may use itself."""
    long = "der lange text hat viele worte " * 4_000
    rows = [
        (1, "the first text of the table, which says a few things", "en", "a", 52),
        (1, "the first text of the table, which says a few things", "en", "a", 52),
        (2, None, "en", "a", None),
        (3, "", "fr", None, 0),
        (4, " \t\n ", None, "b", 4),
        (None, "a text without an id, but with a mail a@b.de", "en", "b", 40),
        (5, long, "de", "c", len(long)),
        (6, "x" * 30_000, "de", "c", 30_000),
        (7, "1234567890 +++ ###", None, None, None),
    ]
    extra = [(*row, "extra", 1, 2.0, "p", 3) for row in rows]
    schema = DOCUMENTS + ", _size string, n_tokens int, score double, doc string, block int"
    return spark.createDataFrame(extra, schema)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
