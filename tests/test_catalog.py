"""Every query of the catalogue against its SQL, and the entry points."""

import duckdb
import pytest

import __spark_entry__
from lodestar import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
