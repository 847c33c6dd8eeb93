import duckdb
import pandas as pd
import pytest

from specmark.plans import catalog
from tests.conftest import DATA

SF = DATA / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(df: pd.DataFrame) -> list:
    clean = lambda v: "null" if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else v if isinstance(v, str) else int(v)
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(SF)).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
