"""Whitening against a direct eigenvalue decomposition."""

import math

import numpy as np
import pytest

from casetrail.llm import queries, whitening

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<double>, n int, key string, component string, vector int"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], 1, "k", "c", 2) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors):
    """Exact integers for sums and deviations, numpy's own decomposition for the components."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    centred = np.array([[(n * r[i] - s[i]) / n for i in range(d)] for r in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return n, deviation, centred, v, e[::-1], u[:, ::-1]


def check(got, ids, vectors, most=32):
    n, deviation, centred, v, e, u = brute(vectors)
    k = min(most, int((e > e[0] * 1e-11).sum()))
    assert len(got) == k * len(ids)
    by = {(r.vec_id, r.component): r for r in got}
    w = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    scale = np.abs(w).max()
    for c in range(k):
        gap = min([abs(e[c] - e[j]) for j in range(len(e)) if j != c], default=e[0])
        assert all(abs(by[i, c + 1].explained - e[c] / np.trace(v)) < 1e-9 for i in ids)
        if gap > 1e-6 * e[0]:
            want = centred @ u[:, c] / np.sqrt(e[c])
            want = want if abs(want - w[:, c]).max() < abs(want + w[:, c]).max() else -want
            assert np.abs(want - w[:, c]).max() < 1e-6 * scale
    for i, far in zip(ids, deviation):
        assert {(by[i, c].n, by[i, c].deviation) for c in range(1, k + 1)} == {(n, far if far < 2**63 else None)}
    own = np.abs(w.T @ w / n - np.eye(k)).max()
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and own < 1e-4 and abs(errors.pop() - own) < 1e-7


@pytest.mark.parametrize("d, n", [(64, 300), (3, 40), (1, 5), (40, 20)])
def test_equals_direct_decomposition(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((n, d)) * np.geomspace(1, 0.05, d)).astype(np.float32).tolist()
    check(whitening.whiten(frame(spark, vectors)).collect(), range(n), vectors)


def test_clusters_of_equal_eigenvalues(spark):
    """Every axis alike (all eigenvalues equal), and two close groups of them around the 32nd component."""
    alike = [[3.0 * (i == j) * s for j in range(40)] for i in range(40) for s in (1, -1)]
    check(whitening.whiten(frame(spark, alike)).collect(), range(80), alike)
    groups = [[(3.0 if i < 30 else 2.0) * (i == j) * s for j in range(40)] for i in range(40) for s in (1, -1)]
    check(whitening.whiten(frame(spark, groups)).collect(), range(80), groups)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((50, 6)).tolist()
    bad = [None, [1, None, 0, 0, 0, 0], [NAN] * 6, [INF] * 6, [-INF, 0, 0, 0, 0, 0], [], [1.0, 2.0]]
    check(whitening.whiten(frame(spark, good + bad)).collect(), range(50), good)
    twice = frame(spark, good).unionByName(frame(spark, good[:1])).unionByName(spark.createDataFrame([(None, good[1], 1, "k", "c", 2)], SCHEMA))
    got = whitening.whiten(twice).collect()
    assert len(got) == 52 * 6 and sum(r.vec_id is None for r in got) == 6 and {r.n for r in got} == {52}


def test_no_component(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [None, []])).collect() == []
    assert whitening.whiten(frame(spark, [[0.5, 0.25]])).collect() == []
    assert whitening.whiten(frame(spark, [[0.5, 0.25]] * 9)).collect() == []


def test_constant_and_dependent_dimensions_are_left_out(spark):
    rng = np.random.default_rng(5)
    base = np.round(rng.standard_normal((60, 3)) * 64) / 64
    vectors = np.hstack([base, base[:, :1], np.full((60, 2), 7.0)]).tolist()
    check(whitening.whiten(frame(spark, vectors)).collect(), range(60), vectors)


def test_huge_entries_count(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((30, 4)).tolist()
    vectors[7][2] = 1e13
    got = whitening.whiten(frame(spark, vectors)).collect()
    far = {r.vec_id: r.deviation for r in got}
    want = brute(vectors)[1]
    assert [far[i] for i in range(30)] == [w if w < 2**63 else None for w in want] and far[7] is None
    beyond = vectors[:7] + [[1.7e308, 0, 0, 0]]
    assert {r.vec_id for r in whitening.whiten(frame(spark, beyond)).collect()} == set(range(8))


def test_inertia_and_slices():
    rng = np.random.default_rng(7)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in (*rng.standard_normal(5) * 3, 0.0):
            assert whitening.above(a, shift) == (e > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.above(np.zeros((3, 3)), 0.0) == 0
    a = rng.standard_normal((50, 50))
    a = a @ a.T
    e = np.linalg.eigvalsh(a)
    low, high = (e[19] + e[20]) / 2, (e[29] + e[30]) / 2
    values, vectors = whitening.feast(a, low, high, 10)
    assert np.allclose(values, e[20:30], rtol=1e-12) and np.abs(a @ vectors - vectors * values).max() < 1e-11 * e[-1]


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check(queries.QUERIES["op13_embedding_whitening"](spark, folder).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])
