"""Text operators that SQL can express, against their SQL on a small scale, value for value."""

from __future__ import annotations

import duckdb
import pytest
from documents_fixture import make_docs  # noqa: F401

from caselight.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_same_rows_as_sql(spark, make_docs, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = base.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, SF).select(*wanted.columns)
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())
