"""Contract of the entry points and a few whole queries against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if v is None or isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0 if not (isinstance(v, float) and math.isnan(v)) else "nan"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "variant" and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


@pytest.mark.parametrize("name", ["c02_readmission_label", "c16_unit_trajectory", "g08_neighbour_rate_threshold", "e10_delong",
                                  "q03_variants", "j04_lookback", "m07_preprocess"])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)
    assert [names[i] for i in order] == cols and got == want
