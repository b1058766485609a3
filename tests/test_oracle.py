"""Every registered query with SQL, against DuckDB on the same tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from loomery.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    plain = [tuple(None if x is None or (not isinstance(x, (list, str)) and pd.isna(x)) else round(float(x), 6) if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x) for x in r) for r in frame.astype(object).itertuples(index=False)]
    return sorted(plain, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()
