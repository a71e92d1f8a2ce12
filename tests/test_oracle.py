"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from trajectra import plans

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "events lineitem part embeddings documents benchmark conversations labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "item") else v
    return sorted((tuple(clean(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = plans.QUERIES[name](spark, DIR).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
