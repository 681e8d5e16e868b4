"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sievewright.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (str, bytes)) and getattr(v, "ndim", 0):
        return str([plain(x) for x in v])
    if v is None or v is pd.NaT or (not isinstance(v, str) and pd.isna(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    """Such queries give rows, and the same ones again from tables in other partitions; what the rows are is tested by operator."""
    first = registry.queries()[name](spark, DATA).toPandas()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        again = registry.queries()[name](spark, DATA).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(first) and rows(first) == rows(again)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
