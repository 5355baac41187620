"""Every query of the scene operators against its SQL twin in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from strataform.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        v = v.item() if hasattr(v, "item") and not hasattr(v, "__len__") else v
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, duck, name):
    got = registry.queries()[name](spark, small).toPandas()
    assert rows(got) == rows(duck.sql(SQL[name]).df())


def test_every_query_is_unique_and_flagship_exists():
    assert registry.FLAGSHIP in registry.queries()
    assert set(SQL) <= set(registry.queries())


