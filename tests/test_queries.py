"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import database, difference

WITH_SQL = sorted(contract.oracle_sql())
WITHOUT_SQL = sorted(set(contract.queries()) - set(contract.oracle_sql()))


@pytest.fixture(scope="module")
def connection(small):
    return database(small)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, connection, small, name):
    problem, count = difference(spark, connection, small, name)
    assert not problem, problem


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, small, name):
    result = contract.queries()[name](spark, small)
    assert result.count() > 0


def test_entry(spark):
    table = contract.entry(spark)
    found = [r.risk_rank for r in table.select("risk_rank").collect()]
    assert sorted(found) == list(range(1, len(found) + 1))


def test_sql_names_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_a_loaded_model_scores_as_the_saved_one(spark, small):
    found = contract.queries()["model_artifact"](spark, small).collect()
    assert sum(r.rows for r in found) > 0 and all(r.differing == 0 for r in found)
