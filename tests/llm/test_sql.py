"""Queries with SQL against it, on the driver's tables."""

import duckdb
import pytest

from specmark.llm import registry, sql
from tests.conftest import DATA

SF = DATA / "sf0.001"


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, str(SF)).toPandas()
    rows = lambda df: sorted(df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).itertuples(index=False, name=None), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
