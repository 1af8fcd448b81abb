"""The split-window operators against plain windows and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casetrail.operators import temporal as J
from casetrail.operators.ordering import ordered, time_chunk
from casetrail.operators.ranks import cumulative, grouped_quantiles, hashed_rank, top_k, value_band
from casetrail.operators.sampling import kfold, quantile_bins, rank_bins, rebalance, stratified_split


@pytest.fixture(scope="module")
def skewed(spark):
    """Events where one key owns a third of the rows, with null values and equal times."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(20)}"
        rows.append((key, 1_700_000_000 + rng.randrange(0, 40) * 30_000, i, rng.choice(["a", "b", None]), rng.randrange(100)))
    return spark.createDataFrame(rows, "k string, s long, id int, tok string, v int").withColumn("ts", F.timestamp_seconds("s"))


def test_ordered_equals_plain_window(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = skewed.select(
        "id", F.row_number().over(w).cast("long").alias("rn"), F.lag("tok").over(w).alias("lg"), F.lead("v").over(w).alias("ld"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.last("tok", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ffill"),
        F.first("tok", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("bfill"),
        F.count("*").over(Window.partitionBy("k")).alias("n"))
    split = ordered(skewed, ["k"], ["ts", "id"], time_chunk("ts"), row_number="rn", key_rows="n", lag={"lg": "tok"},
                    lead={"ld": "v"}, running={"run": "v"}, carry={"ffill": "tok"}, carry_back={"bfill": "tok"})
    cols = ["id", "rn", "lg", "ld", "run", "ffill", "bfill", "n"]
    assert sorted(map(tuple, plain.select(cols).collect()), key=str) == sorted(map(tuple, split.select(cols).collect()), key=str)


def test_ordered_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5), ("a", 4)], "k string, v int")
    got = {r["v"]: r["rn"] for r in ordered(df, ["k"], ["v"], F.lit(0), row_number="rn").collect()}
    assert got == {1: 1, 2: 2, 4: 1, 5: 2}
    got = {r["v"]: r["rn"] for r in ordered(df, [], ["v"], F.floor(F.col("v") / 2), row_number="rn").collect()}
    assert got == {1: 1, 2: 2, 4: 3, 5: 4}


def test_value_band_keeps_order(spark):
    values = sorted([0.0, 1.0, -1.0, 0.5, 1e-300, -1e-300, 2.0 ** 40, 1.9999999999, 2.0000000001, -7.25, 1e9, 3.0, 3.0000001])
    bands = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", value_band(F.col("v")).alias("b"))
             .orderBy("v").collect()]
    assert bands == sorted(bands)


def test_cumulative_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=400), 2)
    df = spark.createDataFrame([("g" if i % 3 else None, float(v)) for i, v in enumerate(values)], "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}, "n").collect()}
    for key, part in (("g", values[[i for i in range(400) if i % 3]]), (None, values[::3])):
        assert got[key]["n"] == len(part)
        assert [got[key][c] for c in "abc"] == pytest.approx(np.quantile(part, [0.25, 0.5, 0.95]).tolist())
    cells = {r["v"]: r for r in cumulative(df, [], "v", {"n": F.count(F.lit(1))}, descending=True).collect()}
    for v in (values.min(), values.max(), values[10]):
        assert cells[v]["n_before"] == (values > v).sum() and cells[v]["n_total"] == 400


def test_hashed_rank_is_a_permutation_and_repeatable(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 3)
    a = {(r["id"], r["rank"]) for r in hashed_rank(df, ["s"], ["id"]).collect()}
    assert a == {(r["id"], r["rank"]) for r in hashed_rank(df.repartition(5), ["s"], ["id"]).collect()}
    per = sorted(rank for i, rank in a if i % 3 == 0)
    assert per == list(range(1, 335))


def test_split_fold_and_balance(spark):
    df = spark.range(205).withColumn("y", (F.col("id") < 45).cast("int"))
    sizes = {(r["y"], r["split"]): r["count"] for r in stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()}
    assert sizes == {(1, "train"): 36, (1, "val"): 4, (1, "test"): 5, (0, "train"): 128, (0, "val"): 16, (0, "test"): 16}
    folds = [r["count"] for r in kfold(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()]
    assert sorted(folds) == [9] * 5 + [32] * 5
    over = {r["y"]: r["count"] for r in rebalance(df, "y", ["id"], "oversample", 0.5).groupBy("y").count().collect()}
    assert over == {0: 160, 1: 80}
    under = {r["y"]: r["count"] for r in rebalance(df, "y", ["id"], "undersample").groupBy("y").count().collect()}
    assert under == {0: 45, 1: 45}


def test_bins(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, v double")
    got = [r["bin"] for r in rank_bins(df, "v", ["id"], 4).orderBy("v").collect()]
    # Even steps over 10 rows, truncated: 0, 2, 5, 7, 10.
    assert got == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]
    tied = spark.createDataFrame([(i, 1.0) for i in range(9)], "id int, v double")
    assert sorted(r["bin"] for r in rank_bins(tied, "v", ["id"], 3).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [r["bin"] for r in quantile_bins(df, "v", 2).orderBy("v").collect()] == [0] * 5 + [1] * 5


def test_interval_join_finds_each_match_once(spark):
    rng = random.Random(5)
    iv = [(i, f"k{i % 3}", rng.randrange(1000), 0) for i in range(60)]
    iv = [(i, k, a, a + rng.randrange(400)) for i, k, a, _ in iv]
    pts = [(j, f"k{j % 3}", rng.randrange(1500)) for j in range(90)]
    a = spark.createDataFrame(iv, "i int, k string, a long, b long").withColumns({"a": F.timestamp_seconds("a"), "b": F.timestamp_seconds("b")})
    p = spark.createDataFrame(pts, "j int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    got = sorted((r["i"], r["j"]) for r in J.interval_join(a, p, ["k"], "a", "b", "t", 100).collect())
    want = sorted((i, j) for i, k, lo, hi in iv for j, q, t in pts if k == q and lo <= t <= hi)
    assert got == want
    left = J.interval_join(a, p, ["k"], "a", "b", "t", 100, row_id="i")
    assert {r["i"] for r in left.collect()} == {i for i, *_ in iv}


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, direction, strict):
    rng = random.Random(9)
    left = [(i, f"k{i % 2}", rng.randrange(200)) for i in range(80)]
    right = sorted({(f"k{i % 2}", rng.randrange(200)) for i in range(40)})
    l = spark.createDataFrame(left, "i int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    r = spark.createDataFrame([(k, t, t * 10) for k, t in right], "k string, u long, v long").withColumn("u", F.timestamp_seconds("u"))
    got = {x["i"]: x["v"] for x in J.asof(l, r, ["k"], "t", "u", ["v"], direction, strict, chunk_seconds=30).collect()}
    for i, k, t in left:
        if direction == "backward":
            fits = [u for q, u in right if q == k and (u < t if strict else u <= t)]
            want = max(fits) * 10 if fits else None
        else:
            fits = [u for q, u in right if q == k and (u > t if strict else u >= t)]
            want = min(fits) * 10 if fits else None
        assert got[i] == want


def test_window_counts_needs_no_pairs(spark):
    cases = spark.createDataFrame([(1, "p", 100), (2, "p", 200), (3, "q", 50)], "id int, k string, t long").withColumn("t", F.timestamp_seconds("t"))
    ev = spark.createDataFrame([("p", 100), ("p", 150), ("p", 199), ("p", 200), ("z", 10)], "k string, u long").withColumn("u", F.timestamp_seconds("u"))
    low = F.timestamp_micros(F.unix_micros("t") - 100_000_000)
    got = {r["id"]: r["n"] for r in J.window_counts(cases, "id", ev, ["k"], low, F.col("t"), "u", {"n": F.lit(1)}).collect()}
    assert got == {1: 0.0, 2: 3.0, 3: 0.0}
    plan = J.window_counts(cases, "id", ev, ["k"], low, F.col("t"), "u", {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scd2_small_and_large_dimension_agree(spark):
    dim = spark.createDataFrame([("u", "2000-01-01", "2020-01-01", "old"), ("u", "2020-01-01", "2050-01-01", "new")],
                                "k string, s string, e string, v string").withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    facts = spark.createDataFrame([(1, "u", "2019-12-31"), (2, "u", "2020-01-01"), (3, "u", "1999-01-01"), (4, "x", "2021-01-01")],
                                  "i int, k string, d string").withColumn("d", F.to_date("d"))
    want = {1: "old", 2: "new", 3: None, 4: None}
    for limit in (100, 1):
        assert {r["i"]: r["v"] for r in J.scd2_join(facts, dim, "k", "d", "s", "e", ["v"], limit).collect()} == want
    assert [r["v"] for r in J.scd2_current(dim, "e").collect()] == ["new"]


def test_scd2_overlapping_versions_at_both_limits(spark):
    """A fact meets every version that holds its time, whether or not the dimension is broadcast."""
    dim = spark.createDataFrame([("u", 0, 100, "wide"), ("u", 10, 20, "closed"), ("u", 40, 60, "inner")], "k string, s int, e int, v string")
    facts = spark.createDataFrame([(1, "u", 30), (2, "u", 50), (3, "u", 200), (4, None, 5)], "i int, k string, d int")
    for limit in (100_000, 0):
        got = sorted((r["i"], r["v"] or "") for r in J.scd2_join(facts, dim, "k", "d", "s", "e", ["v"], limit).collect())
        assert got == [(1, "wide"), (2, "inner"), (2, "wide"), (3, ""), (4, "")]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    best = top_k(df, ["k"], [F.desc("id")], 2)
    assert sorted(r["id"] for r in best.collect()) == [96, 97, 98, 99]
    assert "WindowGroupLimit" in best._jdf.queryExecution().optimizedPlan().toString()
