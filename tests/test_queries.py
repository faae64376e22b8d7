"""Every query with SQL against DuckDB on the smallest tables, and that all others run."""

import os

import pytest

from cinelake.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(df):
    import pandas as pd

    def value(v):
        if isinstance(v, (list, tuple)):
            return str(v)
        if pd.isna(v):
            return None
        if hasattr(v, "year"):
            return str(v).removesuffix(" 00:00:00")
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted((tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.SQL:
        wanted = duck.execute(registry.SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert plain(found) == plain(wanted)
    else:
        assert len(found)
