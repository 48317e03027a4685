"""Every query of the library against its SQL, and the entry point."""

import duckdb
import pandas as pd
import pytest
from ckptlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def values(df):
    def one(x):
        if isinstance(x, (bytes, str, bool)):
            return str(x)
        return "null" if pd.isna(x) else f"{float(x):.5g}"

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), oracle.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert values(got) == values(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
