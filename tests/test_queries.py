"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from calcstrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df, columns):
    absent = lambda v: pd.api.types.is_scalar(v) and pd.isna(v)
    plain = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v  # noqa: E731  whole numbers beside nulls
    return sorted(tuple(str(None if absent(v) else plain(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_agrees_with_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_keyword_set_diff_takes_whole_texts(spark, tmp_path):
    long = "same " * 200
    turns = [(1, 0, "user", long + "gone"), (1, 1, "user", long + "come"), (2, 0, "user", long + "both"), (2, 1, "user", "both " + long)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["keyword_set_diff"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "COME", "added"), (1, 1, "GONE", "deleted")]


def test_ancestry_of_a_long_chain(spark, tmp_path):
    n = 20_000
    spark.range(n).selectExpr("1 AS conv_id", "CAST(id AS INT) AS turn", "'user' AS role", "'x' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["ancestry"](spark, str(tmp_path)).toPandas()
    assert len(got) == n and got["depth"].max() == n - 1 and ((got["turn"] + got["depth"]) == n - 1).all()


def test_ancestry_of_a_circle(spark):
    from calcstrata.operators import snapshots

    commits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "k string, p string")
    with pytest.raises(ValueError, match="own ancestor"):
        snapshots.ancestors(commits, ["k"], ["p"], commits.where("k = 'a'").select("k"))
