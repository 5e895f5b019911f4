"""Every query of the catalogue against its SQL in DuckDB; the others by their rows."""

import oracle
import pytest

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def connection(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", [n for n, (_, sql) in driver.CATALOGUE.items() if sql])
def test_query_agrees_with_its_sql(spark, data, connection, name):
    assert oracle.compare(driver.queries()[name](spark, data), connection, driver.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", [n for n, (_, sql) in driver.CATALOGUE.items() if not sql])
def test_query_without_sql_has_rows(spark, data, name):
    assert driver.queries()[name](spark, data).count() > 0


def test_entry_has_rows(spark, data):
    assert driver.entry(spark).count() > 0
