"""Graph operators against brute force on small fixtures."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casetrail.operators import graph as G


@pytest.fixture(scope="module")
def links(spark):
    """60 cases; node h0 touches nearly all, h1 half of them, some cases are copies, some links repeat."""
    rng = random.Random(11)
    rows = []
    for c in range(60):
        nodes = {f"n{rng.randrange(25)}" for _ in range(3)}
        if c % 12 != 5:
            nodes.add("h0")
        if c % 2:
            nodes.add("h1")
        if c % 3 == 0:
            nodes = {"h0", "h1", "n1"}
        rows += [(c, n) for n in sorted(nodes)]
        if c % 4 == 0:
            rows.append((c, "h0"))
    return rows


@pytest.fixture(scope="module")
def tables(spark, links):
    inc = spark.createDataFrame(links, "c int, n string")
    lab = spark.createDataFrame([(c, int(c % 5 == 0), int(c % 7 != 0)) for c in range(62)], "c int, y int, t int")
    return inc, lab


def shared(links, dedupe):
    m = defaultdict(Counter)
    for c, n in links:
        m[c][n] = 1 if dedupe else m[c][n] + 1
    return {(a, b): sum(m[a][n] * m[b][n] for n in m[a] if n in m[b]) for a in m for b in m}


@pytest.mark.parametrize("hub_degree", [3, 20, 1000])
@pytest.mark.parametrize("k,dedupe,include_self", [(1, True, True), (2, True, True), (3, False, False)])
def test_threshold_rate_matches_brute_force(tables, links, hub_degree, k, dedupe, include_self):
    inc, lab = tables
    pairs = shared(links, dedupe)
    y = {c: (int(c % 5 == 0), int(c % 7 != 0)) for c in range(62)}
    got = {r["c"]: r["rate"] for r in G.neighbour_rate_thr(inc, lab, "c", "n", "y", "t", k, include_self, dedupe, hub_degree).collect()}
    for c in range(62):
        near = [b for (a, b), s in pairs.items() if a == c and s >= k and (include_self or a != b)]
        num, den = sum(y[b][0] * y[b][1] for b in near), sum(y[b][1] for b in near)
        assert got[c] == pytest.approx(num / max(den, 1)), c


def test_linear_rate_matches_pairs(tables, links):
    inc, lab = tables
    for dedupe, include_self in ((False, True), (True, False)):
        pairs = shared(links, dedupe)
        got = {r["c"]: r["rate"] for r in G.neighbour_rate(inc, lab, "c", "n", "y", "t", include_self, dedupe).collect()}
        for c in range(62):
            near = [(b, s) for (a, b), s in pairs.items() if a == c and (include_self or a != b)]
            num = sum(s for b, s in near if b % 5 == 0 and b % 7 != 0)
            den = sum(s for b, s in near if b % 7 != 0)
            assert got[c] == pytest.approx(num / max(den, 1))


@pytest.mark.parametrize("dedupe,k", [(True, 1), (True, 2), (True, 3), (False, 3)])
def test_shared_counts_prefix_filter_is_exact(tables, links, dedupe, k):
    inc, _ = tables
    want = {(a, b): s for (a, b), s in shared(links, dedupe).items() if a < b and s >= k}
    got = {(r["c_a"], r["c_b"]): r["shared"] for r in G.shared_counts(inc, "c", "n", k, dedupe).collect()}
    assert got == want


@pytest.mark.parametrize("hub_degree", [3, 20, 1000])
def test_knn_by_shared_nodes(tables, links, hub_degree):
    inc, _ = tables
    pairs = shared(links, True)
    want = set()
    for c in range(60):
        near = sorted(((-s, b) for (a, b), s in pairs.items() if a == c and b != c and s > 0))[:4]
        want |= {(c, b, -s) for s, b in near} | {(b, c, -s) for s, b in near}
    got = {(r["src"], r["dst"], r["shared"]) for r in G.cooccurrence_knn(inc, "c", "n", 4, hub_degree=hub_degree).collect()}
    assert got == want


@pytest.mark.parametrize("dedupe,k", [(True, 2), (False, 3)])
def test_pairs_of_cases_with_long_lists(tables, links, monkeypatch, dedupe, k):
    """Cases whose lists are too long to travel meet all others by joins."""
    monkeypatch.setattr(G, "_LISTED", 2)
    inc, lab = tables
    every = shared(links, dedupe)
    got = {(r["c_a"], r["c_b"]): r["shared"] for r in G.shared_counts(inc, "c", "n", k, dedupe).collect()}
    assert got == {(a, b): s for (a, b), s in every.items() if a < b and s >= k}
    got = {(r["src"], r["dst"], r["shared"]) for r in G.cooccurrence_knn(inc, "c", "n", 4, dedupe, 20, False).collect()}
    assert got == {(c, b, -s) for c in range(60) for s, b in sorted((-s, b) for (a, b), s in every.items() if a == c != b and s > 0)[:4]}


def test_vectors_meet_links_that_lie_by_case(spark):
    links = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "c int, id int")
    vectors = spark.createDataFrame([(7, 1.0), (8, 3.0)], "id int, e double")
    pooled = G.pool_embeddings(links, vectors, "c", "id", ["e"])
    assert {r["c"]: r["e"] for r in pooled.collect()} == {1: 2.0, 2: 0.0}
    assert "REPARTITION_BY_COL" in pooled._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_feature_knn_with_copies(spark, block_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    x[:30] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = defaultdict(list)
    for r in G.knn_edges(df, "id", "v", 4, pivots=5, block_rows=block_rows, symmetric=False).collect():
        got[int(r["src"])].append((r["distance"], r["dst"]))
    for i in range(90):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = sorted((d[j], str(j)) for j in range(90) if j != i)[:4]
        assert [b for _, b in sorted(got[i])] == [b for _, b in want]


def test_knn_edges_far_from_the_origin(spark):
    """Squares of the lengths exceed the distances by 16 digits, so only differences can tell the neighbours apart."""
    rng = np.random.default_rng(8)
    x = 1e8 + rng.integers(0, 6, (80, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(80)], "id int, v array<double>")
    got = defaultdict(list)
    for r in G.knn_edges(df, "id", "v", 5, pivots=4, block_rows=16, symmetric=False).collect():
        got[int(r["src"])].append((r["distance"], r["dst"]))
    for i in range(80):
        want = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), str(j)) for j in range(80) if j != i)[:5]
        assert sorted(got[i]) == want


def test_svd_spans_the_same_space(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((40, 20)) < 0.3) * rng.integers(1, 5, (40, 20))
    rows = [(i, j, float(a[i, j])) for i in range(40) for j in range(20) if a[i, j]]
    df = spark.createDataFrame(rows, "c int, n int, v double")
    got = {r["c"]: [r[f"svd_{i}"] for i in range(3)] for r in G.svd_embed(df, "c", "n", F.sum("v"), 3, iterations=16, oversample=5).collect()}
    u, s, _ = np.linalg.svd(a.astype(float))
    for i in range(40):
        assert np.abs(got.get(i, [0, 0, 0])) == pytest.approx(np.abs(u[i, :3] * s[:3]), abs=1e-3)


def test_walks_follow_edges(spark, links):
    edges = [(f"c{c}", n) for c, n in links] + [(n, f"c{c}") for c, n in links]
    df = spark.createDataFrame(edges, "a string, b string")
    known = set(edges)
    for walks in (G.random_walks(df, "a", "b", 6, 2), G.biased_walks(df, "a", "b", 4.0, 0.5, 4, 1)):
        paths = defaultdict(dict)
        for r in walks.collect():
            paths[r["walk"]][r["step"]] = r["node"]
        for p in paths.values():
            steps = [p[i] for i in range(len(p))]
            assert all((x, y) in known for x, y in zip(steps, steps[1:])) and len(steps) in (4, 6)
    again = {(r["walk"], r["step"], r["node"]) for r in G.random_walks(df, "a", "b", 6, 2).collect()}
    assert again == {(r["walk"], r["step"], r["node"]) for r in G.random_walks(df.repartition(3), "a", "b", 6, 2).collect()}


def walked(edges, length, per_node, seed=42, weights=None, proposals=8):
    """Walks by hand from the documented draws; ``weights``: (1/p, 1/q) of second-order walks."""
    def draw(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    near, copies = defaultdict(list), Counter()
    for a, b in edges:
        copies[a, b] += 1
        near[a].append((hashlib.md5(f"42:{a}:{b}:{copies[a, b]}".encode()).hexdigest(), b))
    near, rows = {a: [b for _, b in sorted(v)] for a, v in near.items()}, set()
    for start in near:
        for walk in (f"{start}#{k}" for k in range(per_node)):
            path = [start]
            for step in range(1, length):
                at = near.get(path[-1])
                if not at:
                    break
                if weights is None:
                    path.append(at[draw(seed, walk, step) % len(at)])
                    continue
                most = max(1.0, *weights)
                for label, k in ((step * 1000 + r, k) for r in range(99) for k in range(proposals)):
                    to = at[draw(seed, walk, label, k) % len(at)]
                    prev = path[-2] if step > 1 else None
                    weight = most if prev is None else weights[0] if to == prev else 1.0 if to in near[prev] else weights[1]
                    if draw(seed + 1, walk, label, k) / float(16 ** 15) < weight / most:
                        path.append(to)
                        break
            rows |= {(walk, start, k, n) for k, n in enumerate(path)}
    return rows


@pytest.mark.parametrize("block,p,q,proposals", [(3, 4.0, 0.5, 2), (512, 0.5, 1.0, 8)])
def test_walks_by_blocks_equal_walks_by_hand(spark, monkeypatch, block, p, q, proposals):
    """A hub of 60 neighbours in several blocks, repeated edges, nodes without a way out, near and far moves."""
    monkeypatch.setattr(G, "_BLOCK", block)
    rng = random.Random(5)
    edges = [("h", f"n{i}") for i in range(60)] + [(f"n{i}", "h") for i in range(0, 60, 2)] + [("h", "n7")] * 9
    edges += [(f"n{i}", f"n{rng.randrange(60)}") for i in range(50) for _ in range(3)]
    df = spark.createDataFrame([*edges, ("n1", None), (None, "n1")], "a string, b string")
    blocks, _, degree = G._walk_tables(df, "a", "b")
    sizes = Counter(a for a, _ in edges)
    assert {r["node"]: r["deg"] for r in degree.collect()} == sizes
    rows = blocks.collect()
    assert Counter(r["src"] for r in rows) == {a: -(-n // block) for a, n in sizes.items()}
    assert all(len(r["dsts"]) == len(r["degs"]) <= block and r["degs"] == [sizes[b] for b in r["dsts"]] for r in rows)
    got = G.random_walks(df, "a", "b", 5, 2)
    assert sorted(got.collect()) == sorted(walked(edges, 5, 2))
    got = G.biased_walks(df, "a", "b", p, q, 4, 1, proposals=proposals)
    assert sorted(got.collect()) == sorted(walked(edges, 4, 1, weights=(1 / p, 1 / q), proposals=proposals))


def test_skip_gram_takes_more_cores_for_many_walks(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec
    used, cores = [], spark.sparkContext.defaultParallelism
    fit = Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, df: used.append(self.getNumPartitions()) or fit(self, df))
    walks = spark.range(120).selectExpr("concat('w', id div 3) AS walk", "CAST(id % 3 AS INT) AS step", "concat('n', id % 7) AS node")
    for least in (G._WALKS, 10, 1):
        monkeypatch.setattr(G, "_WALKS", least)
        assert G.walk_embeddings(walks, 2, iterations=1).count() == 7
    assert used == [max(1, cores // 4), max(1, cores // 4, min(cores, 4)), min(cores, 40)]


def test_biased_walks_weigh_returns(spark):
    """Star with three leaves: from a leaf the walk must return to the hub, then 1/p against 1/q decides."""
    edges = [("h", f"l{i}") for i in range(3)] + [(f"l{i}", "h") for i in range(3)]
    df = spark.createDataFrame(edges, "a string, b string")
    walks = G.biased_walks(df, "a", "b", p=0.25, q=1.0, length=3, per_node=300).where("start <> 'h' AND step = 2")
    back = walks.where("node = start").count() / walks.count()
    # Back weighs 4, each of the two other leaves 1.
    assert back == pytest.approx(4 / 6, abs=0.05)


def test_pooling_policies(spark):
    emb = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "id string, e double")
    lk = spark.createDataFrame([(1, "a", 1.0, "t"), (1, "zz", 3.0, "t"), (2, "b", 0.0, "u"), (3, "zz", 2.0, "v")], "c int, id string, h double, typ string")

    def pooled(**kw):
        return {r["c"]: r["e"] for r in G.pool_embeddings(lk, emb, "c", "id", ["e"], **kw).collect()}
    assert pooled() == {1: 1.0, 2: 3.0, 3: 0.0}
    assert pooled(unknown="zero") == {1: 0.5, 2: 3.0, 3: 0.0}
    assert pooled(weight="h") == {1: 1.0, 2: 0.0, 3: 0.0}
    assert pooled(weight="h", unknown="zero_weighted") == {1: 0.25, 2: 3.0, 3: 0.0}
    avg = spark.createDataFrame([("t", 5.0)], "typ string, e double")
    assert pooled(weight="h", kind="typ", averages=avg) == {1: 4.0, 2: 0.0, 3: 0.0}


def test_hyper_propagation_matches_matrices(spark):
    h = np.array([[1, 0, 1, 0, 0], [1, 1, 0, 1, 0], [0, 1, 0, 0, 1]], float)
    inc = spark.createDataFrame([(f"e{j}", i) for i in range(3) for j in range(5) if h[i, j]], "edge string, c int")
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(3)], "c int, x double")
    dv, de = h.sum(1), h.sum(0)
    step = np.diag(dv ** -0.5) @ h @ np.diag(1 / de) @ h.T @ np.diag(dv ** -0.5)
    got = [r["x"] for r in G.hyper_propagate(inc, x, "c", ["x"], 2).orderBy("c").collect()]
    assert got == pytest.approx((step @ step @ np.array([1.0, 2, 3])).tolist())
    lazy = 0.5 * np.eye(3) + 0.5 * np.diag(1 / dv) @ h @ np.diag(1 / de) @ h.T
    got = [r["x"] for r in G.hyper_propagate(inc, x, "c", ["x"], 2, lazy=True).orderBy("c").collect()]
    assert got == pytest.approx((lazy @ lazy @ np.array([1.0, 2, 3])).tolist())


def test_graph_figures_from_one_degree_table(spark):
    edges = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", None), ("z", "x"), ("b", "w"), ("b", "w")]
    cases = [("a",), ("b",), ("b",), ("c",), (None,)]
    df, known = spark.createDataFrame(edges, "c string, n string"), spark.createDataFrame(cases, "c string")
    got = G.graph_stats(df, known, "c", "n").first().asDict()
    assert got == {"n_cases": 3, "n_nodes": 3, "n_rows": 6, "n_pairs": 4, "median_degree": 1.0, "max_degree": 2, "linked_share": 2 / 3}
    none = G.graph_stats(df.limit(0), known, "c", "n").first()
    assert (none.n_cases, none.n_nodes, none.n_pairs, none.median_degree, none.linked_share) == (3, 0, None, None, 0.0)
    plan = G.graph_stats(df, known, "c", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
