import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.catalog import layers_from_log  # noqa: E402
from ranlens.session import build_session  # noqa: E402
from ranlens.sources.tables import WRITE  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def layers(spark, folder):
    return layers_from_log(spark, folder)


def rows(df):
    """All rows as a sorted list of texts, for comparing small results."""
    return sorted(str(tuple(row)) for row in df.collect())


def written(spark, path):
    """The rows of a table without the column that names the write."""
    return spark.read.parquet(str(path)).drop(WRITE)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
