"""What a task or the driver holds, and what is shuffled, stays bounded where tables grow."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetrail.operators import graph as G
from casetrail.operators import models as M
from casetrail.plans import clinical as C
from casetrail.session import cut_lineage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [False, True])
def test_pooling_deals_cases_over_parts_that_fit(spark, monkeypatch, many):
    """Also where the table of vectors is large and the vectors that occur are few."""
    monkeypatch.setattr(G, "_VALUES", 60)
    monkeypatch.setattr(G, "_SUMS", 600, raising=False)
    rows = 500 if many else 50
    vectors = spark.range(rows).select(F.col("id").alias("v"), (F.col("id") * 1.5).alias("e"))
    links = spark.range(4000).select((F.col("id") % 1000).alias("c"), (F.col("id") % 40 + 5 * (F.col("id") % 1000 == 7).cast("int") * 100).alias("v"))
    pooled = G.pool_embeddings(links, vectors, "c", "v", ["e"])
    assert "BroadcastHashJoin" in plan(pooled)
    got = {r["c"]: r["e"] for r in pooled.collect()}
    assert len(got) == 1000
    for c in (0, 3, 7, 999):
        known = [v * 1.5 for v in ((i % 40 + (500 if c == 7 else 0)) for i in range(c, 4000, 1000)) if v < rows]
        assert got[c] == pytest.approx(sum(known) / len(known) if known else 0.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert G.pool_embeddings(links, vectors, "c", "v", ["e"]).rdd.getNumPartitions() >= 4000 * 9 // 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffle_files(spark, most: int) -> int:
    """Shuffle files on disk, after they have had time to go down to ``most``."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        n = sum(1 for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f)
        if n <= most:
            break
        time.sleep(0.1)
    return n


def test_checkpoint_keeps_no_shuffle_files(spark):
    before = shuffle_files(spark, 0)
    df = cut_lineage(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count())
    assert shuffle_files(spark, before) <= before
    assert df.agg(F.sum("count")).first()[0] == 5000


def test_permutations_keep_no_shuffle_files(spark):
    rows = cut_lineage(spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("x"), F.rand(2).alias("z")))
    model = M.train_model(rows, ["x", "z"], "logistic")
    before = shuffle_files(spark, 0)
    found = M.permutation_importance(model, rows, {"x": ["x"], "z": ["z"]}, ["id"])
    assert "Window" not in plan(found)  # measured by now, not all permutations in one plan
    assert shuffle_files(spark, before) <= before
    drop = {r["feature"]: r["importance"] for r in found.collect()}
    assert set(drop) == {"x", "z"} and drop["x"] > 0.1 > abs(drop["z"])


def test_wide_row_keeps_no_shuffle_files_of_its_blocks(spark):
    cases = spark.range(200).select(F.col("id").alias("LogID"), (F.col("id") % 50).alias("PAT_ID"), F.col("id").alias("EncounterCSN"), F.lit("2020-01-01").cast("date").alias("SurgeryDate"),
                                    F.lit("M").alias("PAT_MRN_ID"), F.lit("1950-01-01").cast("date").alias("BirthDate"), F.lit(1).alias("SEX_C"), F.lit(1).alias("PAT_TYPE_C"),
                                    F.lit(1).alias("ACCT_BASECLS_HA_C"), F.lit(1).alias("ASA_RATE_C"), F.col("id").alias("HSP_ACCOUNT_ID"), F.lit("C").alias("PrimaryCPT"))
    counts = spark.range(4000).groupBy((F.col("id") % 100).alias("LogID")).agg(F.count(F.lit(1)).alias("OtherProcedures"))
    before = shuffle_files(spark, 0)
    wide = C.bulk_features(cases, {"procedures": counts})
    plan_leaves = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan_leaves  # the block is read, not computed again
    assert shuffle_files(spark, before) <= before
    found = {r["LogID"]: r["# of Other Procedures"] for r in wide.collect()}
    assert len(found) == 200 and (found[5], found[150]) == (40, 0)


def test_meeting_cases_are_shuffled_once(spark):
    short = cut_lineage(spark.range(60).select((F.col("id") % 20).alias("c"), F.array(F.lit(1), F.lit(2)).alias("ns"), (F.col("id") % 2 + 1).cast("int").alias("n")).distinct())
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        met = G._met(short, True, ["n"], [], F.lit(True))
        assert plan(met).count("ReusedExchange") == 1
        assert met.count() == len({(a, b) for a in range(20) for b in range(a + 1, 20) if a % 2 == b % 2 == 0})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_neighbours_by_cooccurrence_with_hubs(spark):
    """Pairs that meet over hubs, over rare nodes and over both, against all pairs."""
    links = [(c, n) for c in range(40) for n in ({c % 3, 100 + c % 7, 200 + c % 11} | ({300} if c % 4 else set()))]
    df = spark.createDataFrame(links, "c long, n long")
    before = shuffle_files(spark, 0)
    got = G.cooccurrence_knn(df, "c", "n", 3, hub_degree=8)
    assert shuffle_files(spark, before) <= before
    own = {c: {n for x, n in links if x == c} for c in range(40)}
    want = set()
    for c in own:
        near = sorted((-len(own[c] & own[o]), o) for o in own if o != c and own[c] & own[o])[:3]
        want |= {e for s, o in near for e in ((c, o, -s), (o, c, -s))}
    assert sorted((r["src"], r["dst"], r["shared"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_by_slices_are_exact(spark, monkeypatch, kind):
    """Slices of the vectors, one after the other, each leaving no shuffle files."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).astype("float32" if kind == "float" else "float64")
    x[50:60] = x[0]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"id long, v array<{kind}>")
    calls = []
    keep = G.stored
    monkeypatch.setattr(G, "stored", lambda d: calls.append(1) or keep(d), raising=False)
    monkeypatch.setattr(G, "_VISITS", 300, raising=False)
    edges = G.knn_edges(df, "id", "v", 3, pivots=6, block_rows=32, symmetric=False)
    assert len(calls) > 5  # three intermediates and the slices
    d = np.sqrt(((x.astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(-1))
    want = {(str(i), str(j)) for i in range(300) for j in sorted((j for j in range(300) if j != i), key=lambda j: (d[i, j], str(j)))[:3]}
    got = edges.collect()
    assert {(r["src"], r["dst"]) for r in got} == want
    assert all(r["distance"] == pytest.approx(d[int(r["src"]), int(r["dst"])], abs=1e-12) for r in got)
