"""Every named query against its SQL on the smallest tables."""

import pytest
from compare import connect, mismatch
from conftest import SMALL

import __spark_entry__ as spark_entry
from caselight.plans.catalog import QUERIES
from caselight.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert len(QUERIES) == 89


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    assert mismatch(spark, duck, SMALL, name) is None


def test_entry(spark):
    rows = {r.area: r for r in spark_entry.entry(spark).collect()}
    assert set(rows) == {"TOTAL", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"}
    assert rows["TOTAL"].missed == sum(r.missed for a, r in rows.items() if a != "TOTAL")
