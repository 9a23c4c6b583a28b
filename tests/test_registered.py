import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, differences
from checks.oracle_sql import statements
from checks.orders import ORDERS, out_of_order
from checks.catalog import catalog
from tests.conftest import plan_of

QUERIES, SQL = catalog(), statements()


@pytest.fixture(scope="module")
def database(folder):
    with connect(folder) as con:
        yield con


def test_every_query_has_sql_and_is_registered():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= entry_module.queries().keys() and SQL.keys() <= entry_module.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, database, folder, name):
    assert differences(spark, database, folder, QUERIES[name], SQL[name], name) == ""


def test_no_query_leaves_the_virtual_machine(spark, folder):
    for name, query in QUERIES.items():
        if not name.startswith("stream_"):
            plan = plan_of(query(spark, folder))
            assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan, name


@pytest.mark.parametrize("name", ORDERS)
def test_a_report_without_its_sort_is_found_out(spark, folder, name):
    report = QUERIES[name](spark, folder)
    rows = report.collect()
    assert out_of_order(name, report.columns, rows) == ""
    turned = rows[::-1]
    keys = [key.lstrip("-") for key in ORDERS[name]]
    if len({tuple(r[k] for k in keys) for r in rows}) > 1:
        assert out_of_order(name, report.columns, turned)


def test_entry_is_the_flagship(spark):
    assert entry_module.entry(spark).count() == 10
