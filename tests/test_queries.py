"""All queries that have DuckDB SQL against it, on the smallest data."""

import duckdb
import pytest

from focalgrid.plans.queries import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "part", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(7) + 0.0
    return sorted(map(tuple, df.astype(str).replace("None", "nan").to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
