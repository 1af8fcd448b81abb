"""Walk vectors of more nodes than fit on the driver: trained by buckets."""

import numpy as np
from pyspark.sql import functions as F

from casetrail.operators import graph as G
from casetrail.operators import skipgram


def test_vectors_by_buckets_know_the_communities(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "_BUCKET", 40)
    monkeypatch.setattr(G, "_MATRIX", 100, raising=False)

    def refuse(*a, **k):
        raise AssertionError("all vectors on the driver")

    from pyspark.ml import feature
    monkeypatch.setattr(feature.Word2Vec, "_fit", refuse)
    # 120 nodes in 10 communities; 20 walks of 10 steps from each node inside its own.
    rng = np.random.default_rng(4)
    rows = [(f"{n}#{r}", s, f"n{x}") for n in range(120) for r in range(20) for s, x in enumerate([n, *(n // 12 * 12 + rng.integers(0, 12, 9))])]
    walks = spark.createDataFrame(rows, "walk string, step int, node string")
    first = {r["node"]: np.array([r[f"emb_{i}"] for i in range(16)]) for r in G.walk_embeddings(walks, 16).collect()}
    assert len(first) == 120
    names = [f"n{i}" for i in range(120)]
    v = np.stack([first[n] for n in names])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T
    np.fill_diagonal(near, -2)
    top = np.argsort(-near, axis=1)[:, :5]
    assert (top // 12 == np.arange(120)[:, None] // 12).mean() > 0.95
    again = {r["node"]: [r[f"emb_{i}"] for i in range(16)] for r in G.walk_embeddings(walks.repartition(5, F.rand(1)), 16).collect()}
    assert all(np.allclose(first[n], again[n], atol=1e-5) for n in names)
