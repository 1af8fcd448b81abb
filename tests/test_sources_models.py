"""Files, streaming and models."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetrail.functions import fixed
from casetrail.operators import models as M
from casetrail.operators import prep
from casetrail.operators import stats as E
from casetrail.sources import readers, sinks
from casetrail.streaming.bundles import stream_bundles


def test_positional_reads(spark, tmp_path):
    names = ["LogID", "v"]
    (tmp_path / "a.csv").write_text("12.0,x\n13,y\n")
    (tmp_path / "b.csv").write_text("LogID,v\n12.0,x\n13,y\n")
    for name in ("a", "b"):
        assert [tuple(r) for r in readers.read_positional(spark, str(tmp_path / f"{name}.csv"), names).orderBy("LogID").collect()] == [
            ("12", "x"), ("13", "y")]
    with pytest.raises(ValueError, match="expected 3 columns"):
        readers.read_positional(spark, str(tmp_path / "a.csv"), [*names, "w"])
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_positional(spark, str(tmp_path / "a.xlsx"), names)
    assert readers.read_optional(spark, str(tmp_path / "none.csv"), names).columns == names


def test_cohort_file_with_mark_and_crlf(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿1,11,p,2024-01-02,2024,44204,65.25\r\n2,12,q,2024-01-03,2024,44204,70.00\r\n".encode())
    rows = readers.load_cohort(spark, str(tmp_path / "c.csv")).orderBy("LogID").collect()
    assert [r["LogID"] for r in rows] == ["1", "2"] and str(rows[0]["AgeYears"]) == "65.25"


def test_comorbidity_file_versions(spark, tmp_path):
    (tmp_path / "old.csv").write_text("﻿7.0," + ",".join(["1"] * 17) + ",3\n", encoding="utf-8")
    (tmp_path / "new.csv").write_text("LogID," + ",".join(fixed.COMORBIDITY_COLUMNS[1:]) + "\n8," + ",".join(["0"] * 17) + ",x,5\n")
    old = readers.read_comorbidities(spark, str(tmp_path / "old.csv")).first()
    new = readers.read_comorbidities(spark, str(tmp_path / "new.csv")).first()
    assert (old["LogID"], old["mi"], old["n_ed_visits_180d"], old["n_admits_365d"]) == ("7", 1, 3, 0)
    assert (new["LogID"], new["n_ed_visits_180d"], new["n_admits_365d"]) == ("8", 0, 5)


def test_discovery_and_conversion(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("1,2,3,2024-01-01,2024,44204,50\n")
    got = readers.discover(spark, str(tmp_path), fixed.COHORT_COLUMNS, ["LogID", "PrimaryCPT"]).collect()
    assert [tuple(r) for r in got] == [("1", "44204")]
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path), ["q"], ["q"])
    done = sinks.convert_all(spark, str(tmp_path), str(tmp_path / "out"), {"b": fixed.COHORT_COLUMNS, "missing": ["z"]})
    assert done == ["b"] and spark.read.parquet(str(tmp_path / "out/b.parquet")).count() == 1


def test_stream_bundles_equal_batch(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.lit(1_700_000_040) + F.col("id") % 3 * 100).alias("ts"), (F.col("id") % 4).alias("k"))
    late = spark.createDataFrame([(0,)], "k long").select(F.timestamp_seconds(F.lit(1_700_090_000)).alias("ts"), "k")
    rows.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in stream_bundles(rows, ["k"], "ts").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (stream_bundles(stream, ["k"], "ts").writeStream.format("memory").queryName("bundles_out").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("bundles_out").collect()} == batch and batch


@pytest.fixture(scope="module")
def frame(spark):
    """200 rows where x decides the outcome with some noise and z is noise."""
    rows = [(i, i / 200, ((i * 37) % 101) / 101, int((i / 200 + ((i * 13) % 17) / 40) > 0.7)) for i in range(200)]
    return spark.createDataFrame(rows, "id int, x double, z double, y int")


def test_out_of_fold_scores_cover_every_row_once(frame):
    got = M.oof_scores(frame, ["x", "z"], ["id"], k=3, maxIter=10)
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    assert E.auroc(got).first()["auroc"] > 0.8


def test_preprocessing_can_be_refitted_per_fold(frame):
    def refit(train, test):
        state = prep.fit_preprocess(train.select("x", "z"), types={"x": "continuous", "z": "continuous"})
        return prep.apply_preprocess(train, state, ["id", "y"]), prep.apply_preprocess(test, state, ["id", "y"]), state.names
    got = M.oof_scores(frame, refit, ["id"], k=2, calibrate=False, maxIter=10)
    assert got.count() == 200


def test_selection_importance_and_ratio(frame, tmp_path):
    assert M.select_vars(frame, ["x", "z"], "importance", k=1, numTrees=10) == ["x"]
    assert "x" in M.select_vars(frame, ["x", "z"], "l1", strength=0.05)
    model = M.train_model(frame, ["x", "z"], "logistic")
    drop = {r["feature"]: r["importance"] for r in M.permutation_importance(model, frame, {"x": ["x"], "z": ["z"]}, ["id"]).collect()}
    assert drop["x"] > drop["z"]
    assert M.likelihood_ratio(frame, ["z"], ["x"])["p"] < 0.001
    M.save_model(model, str(tmp_path / "m"))
    assert M.batch_score(str(tmp_path / "m"), frame).where("flag = 1").count() > 20


def test_bootstrap_is_repeatable_and_complete(frame):
    scored = frame.withColumn("p", F.col("x"))
    draws = E.bootstrap_replicates(scored, ["id"], 3)
    assert {r["replicate"]: r["n"] for r in draws.groupBy("replicate").agg(F.sum("copies").alias("n")).collect()} == {0: 200, 1: 200, 2: 200}
    a, b = ([tuple(r) for r in E.bootstrap_ci(s, ["id"], 20).orderBy("metric").collect()] for s in (scored, scored.repartition(3)))
    assert a == b and a[0][1] < a[0][2]


def brute_areas(rows, replicates, seed):
    """Areas of each replicate from its weighted rows, one after another."""
    limits, out = [int(x, 16) for x in E.poisson_limits()], {}
    for b in range(replicates):
        weighted = []
        for i, y, p in rows:
            digits = hashlib.md5(f"{seed}:{b // 4}:{i}".encode()).hexdigest()[8 * (b % 4):8 * (b % 4) + 8]
            if p is not None and y is not None:
                weighted.append((p, y, sum(int(digits, 16) >= x for x in limits)))
        pos, neg = (sum(w for _, y, w in weighted if y == side) for side in (1, 0))
        if pos and neg:
            wins, precision = 0, 0.0
            for score in {p for p, _, w in weighted}:
                here = sum(w for p, y, w in weighted if p == score and y == 1)
                wins += here * (sum(w for p, y, w in weighted if p < score and y == 0) + sum(w for p, y, w in weighted if p == score and y == 0) / 2)
                hits, flagged = (sum(w for p, y, w in weighted if p >= score and y in side) for side in ((1,), (0, 1)))
                precision += here / pos * hits / flagged if here else 0
            out[b] = wins / (pos * neg), precision
    return out


@pytest.mark.parametrize("tied", [E._TIED, 5])
def test_replicated_areas_equal_plain_sums(spark, monkeypatch, tied):
    """Half of the rows share one score; some have no score or label; ranges and steps cut everywhere."""
    monkeypatch.setattr(E, "_STEP", 7)
    monkeypatch.setattr(E, "_TIED", tied)
    rows = [(i, None if i % 17 == 3 else int(i % 5 == 0 or i % 7 == 1), None if i % 19 == 4 else 0.5 if i % 2 else round((i * 37 % 101) / 40 - 1, 3)) for i in range(160)]
    frame = spark.createDataFrame(rows, "id long, y int, p double").repartition(3)
    got = {r.replicate: (r.auroc, r.auprc) for r in E.replicated_areas(frame, ["id"], 10, seed=2).collect()}
    want = brute_areas(rows, 10, 2)
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], rel=1e-12) for b in want)
    single = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.2)], "id long, y int, p double")
    assert E.replicated_areas(single, ["id"], 5).collect() == E.replicated_areas(single.limit(0), ["id"], 5).collect() == []


def test_tied_rows_leave_in_order_and_are_weighted_once(monkeypatch):
    """A sorted batch with a frequent score: its rows become one, in place; summed rows pass through as they are."""
    import pyarrow as pa
    monkeypatch.setattr(E, "_TIED", 4)
    weights, names = E._Weights(10, 3), [str(i) for i in range(9)]
    batch = pa.RecordBatch.from_pydict({
        "p": pa.array([0.1, *[0.2] * 6, 0.3, 0.3]), "y": pa.array([1, 1, 0, 1, None, 1, 0, 0, 1], pa.int32()), "name": pa.array(names),
        "pos": pa.nulls(9, pa.binary()), "neg": pa.nulls(9, pa.binary())})
    once = pa.Table.from_batches(E._tied_together(weights)(iter([batch]))).to_pylist()
    assert [r["p"] for r in once] == [0.1, 0.2, 0.3, 0.3]
    copies = weights.of(names).astype(np.int64)
    assert (np.frombuffer(once[1]["pos"], np.int64) == copies[[1, 3, 5]].sum(axis=0)).all()
    assert (np.frombuffer(once[1]["neg"], np.int64) == copies[[2, 6]].sum(axis=0)).all()
    again = pa.Table.from_batches(E._tied_together(weights)(iter([pa.RecordBatch.from_pylist(once, schema=batch.schema)]))).to_pylist()
    assert again == once


def test_md5_grid_equals_hashlib():
    """Starts and names of several lengths, beyond one block and outside ASCII."""
    weights = E._Weights(4200, 7)
    names = ["", "1", "22", "é:3", *[str(10 ** 9 + i) for i in range(20)], "x" * 46, "x" * 50, "y" * 70]
    digests = b"".join(hashlib.md5(s + n.encode()).digest() for n in names for s in weights.starts)
    drawn = np.searchsorted(weights.limits, np.frombuffer(digests, ">u4").astype(np.uint32), side="right").reshape(len(names), -1)
    assert (weights.of(names) == drawn[:, :4200]).all()
    assert E.md5_grid([b"0:"], [b"a"]).astype(">u4").tobytes() == hashlib.md5(b"0:a").digest()


def test_all_scenarios_at_once_equal_one_by_one(frame):
    blocks = {"demographics": ["x"], "geocode": ["z"], "charlson": ["x", "z"]}
    train = frame.where("id % 3 > 0")
    got = {}
    for r in prep.scenarios(frame, blocks, train, ["id"]).collect():
        got.setdefault(r["scenario"], {})[r["id"]] = (r["x"], r["z"], r["y"])
    assert len(got) == len(prep.SCENARIOS) == 17 and all(len(rows) == 200 for rows in got.values())
    for name in ("baseline_clean", "missing_charlson", "missing_geocode_sdoh", "missing_cpt", "wrong_demographics", "wrong_charlson", "bare_bones_demog_only"):
        want = {r["id"]: (r["x"], r["z"], r["y"]) for r in prep.scenario(frame, name, blocks, train, ["id", "y"] if "bare" in name else ["id"]).collect()}
        assert got[name] == want, name
    with pytest.raises(ValueError):
        prep.scenarios(frame, blocks, train, ["id"], named=[("odd", "sideways", "geocode")])


def test_scenarios_damage_only_their_block(frame):
    blocks = {"demographics": ["x"], "geocode": ["z"]}
    rows = {r["id"]: r for r in frame.collect()}
    zero = prep.scenario(frame, "missing_geocode_sdoh", blocks, frame, ["id"]).collect()
    assert len({r["z"] for r in zero}) == 1 and all(r["x"] == rows[r["id"]]["x"] for r in zero)
    dealt = prep.scenario(frame, "wrong_demographics", blocks, frame, ["id"]).collect()
    assert sorted(r["x"] for r in dealt) == sorted(r["x"] for r in rows.values()) and any(r["x"] != rows[r["id"]]["x"] for r in dealt)


def test_clusters_of_many_groups_in_the_same_passes(spark):
    """500 groups, one with a third of all rows: two planted clusters each, or none where rows are too few."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(500):
        size = 4000 if g == 0 else 6 if g % 10 == 9 else 16
        side = rng.permutation(np.arange(size) % 2)
        points = rng.normal(0, 0.3, (size, 2)) + side[:, None] * 8
        rows += [(g if g else None, i, float(x), float(y), int(s)) for i, ((x, y), s) in enumerate(zip(points, side))]
    rows += [(1, 900, None, 1.0, 0), (1, 901, float("nan"), 1.0, 0)]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double, side int")
    got = {(r["g"], r["id"]): r["sub"] for r in M.within_group_kmeans(df, "g", ["x", "y"], ["id"], (1, 2, 3), 5, starts=2, rounds=4).collect()}
    assert len(got) == len(rows) and got[1, 900] == got[1, 901] == 0
    kinds = {}
    for g, i, _, _, side in rows[:-2]:
        kinds.setdefault(g, set()).add((side, got[g, i]))
    for g, pairs in kinds.items():
        if g is not None and g % 10 == 9:
            assert {sub for _, sub in pairs} == {0}, g
        else:
            assert len(pairs) == 2 and {sub for _, sub in pairs} == {0, 1}, g


def test_class_weights_leave_rows_where_they_are(spark):
    """A shuffle by class would put all rows in two tasks."""
    from casetrail.operators.sampling import class_weights
    rows = spark.range(0, 120_000, 1, 8).selectExpr("id", "cast(id % 4 = 0 as int) y")
    weighted = class_weights(rows, "y")
    assert {(r["y"], r["weight"]) for r in weighted.select("y", "weight").distinct().collect()} == {(1, 2.0), (0, 2 / 3)}
    assert weighted.rdd.getNumPartitions() == 8
