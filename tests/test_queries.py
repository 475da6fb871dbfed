"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import SMALL

FEWER_ROUNDS = {"tsne": {"max_iter": 8}, "umap": {"max_iter": 8}}  # the queries themselves run the defaults

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SMALL, **FEWER_ROUNDS.get(name, {})).toPandas()
    assert len(got)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got.notna().all().all()
        return
    want = duck.execute(sql).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
