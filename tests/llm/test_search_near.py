"""Exact top-k and near-duplicate groups against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from casetrail.llm import minhash, topk
from casetrail.llm.components import components


def brute_top(rows, k, scale=1024):
    def ints(v):
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(scale * x) for x in v] if ok else None
    live = [(n, i, ints(v)) for n, (i, v, *_) in enumerate(rows) if i is not None and ints(v) is not None]
    out = []
    for n, i, q in live:
        if i % 3 == 0:
            found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in live if m != n))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["mixed", "hot", "few", "negative"])
def test_top(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "BLOCK", 37)
    monkeypatch.setattr(topk, "QUERIES", 11)
    rnd = random.Random(shape)
    def vector():
        if shape == "hot" and rnd.random() < 0.4:
            return [0.5] * 8
        scale = rnd.choice([0.01, 0.3, 1, 4])
        return [(abs(rnd.gauss(0, 1)) if shape != "negative" else rnd.gauss(0, 1)) * scale for _ in range(8)]
    n = 6 if shape == "few" else 400
    rows = [(i, vector(), "x", 1) for i in range(n)]
    if shape == "negative":
        rows += [(3 * n + 3, [-50.0] * 8, "x", 1)]
    rows += [(9001, None, "x", 1), (9003, [1.0, None] + [0.0] * 6, "x", 1), (9006, [float("nan")] * 8, "x", 1), (9009, [float("inf")] * 8, "x", 1), (None, [1.0] * 8, "x", 1),
             (9012, [0.0] * 8, "x", 1), (9015, [1.0, 2.0], "x", 1), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, level string, block int").repartition(3)
    got = sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % 3 == 0, k=10).collect())
    assert got == brute_top(rows, 10)


def test_top_large_numbers(spark):
    """Products over 2**53 are still exact."""
    rows = [(i, [float(2**20 + i), float(-(2**20) + 3 * i), 1.0]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % 3 == 0).collect()) == brute_top(rows, 10)
    huge = spark.createDataFrame([(0, [1e14]), (1, [1e14])], "vec_id long, embedding array<double>")
    assert [r.score for r in topk.top_products(huge, F.col("vec_id") == 0).collect()] == [2**63 - 1]


def test_top_huge_components(spark, monkeypatch):
    """Components that a long cannot hold take part; ranks follow the exact products, also beyond a long."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) * rnd.choice([1, 2.0**30, 2.0**51, 2.0**100, 3e38]) for _ in range(5)]) for i in range(120)]
    rows += [(300, [2.0**51, 1.0]), (303, [2.0**51, 2.0]), (306, [1.7e38] * 5), (309, [-1.7e38] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_products(df, F.col("vec_id") % 3 == 0).collect())
    assert got == [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in brute_top(rows, 10)]


def test_top_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(none, F.col("vec_id") % 100 == 0).collect() == []


def brute_components(nodes, links):
    up = {n: n for n in nodes}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 300)] + [(rnd.randint(300, 500), rnd.randint(300, 500)) for _ in range(90)] + [(-5, 7), (1, 1)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, size):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()


def brute_near(rows, size):
    sets = [shingles(r[1], size) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = brute_components(range(len(rows)), links)
    least = {}
    for i, g in group.items():
        key = rows[i][0]
        if key is not None and (g not in least or least[g] is None or key < least[g]):
            least[g] = key
        least.setdefault(g, None)
    return sorted(((rows[i][0], len(sets[i]), least[group[i]], rows[i][0] == least[group[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("size", [4, 5])
def test_near(spark, size):
    rnd = random.Random(size)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 60, 120]))]
        for _ in range(rnd.choice([1, 3, 25])):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                copy = [w.upper() for w in copy]
            rows.append(" ".join(copy) + rnd.choice(["", " ", "\n"]))
            if rnd.random() < 0.3:
                words = copy  # drift: chains of links
    rows = [(i, t, "b", 1) for i, t in enumerate(rows)]
    rnd.shuffle(rows)
    rows += [rows[0], (None, rows[1][1], "b", 1), (900, None, "b", 1), (901, "", None, 1), (902, " \n", "b", None), (903, "one two", "b", 1), (904, "one  two", "b", 1)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, band string, class int").repartition(4), shingle=size)
    assert sorted(map(tuple, got.collect()), key=str) == brute_near(rows, size)


@pytest.mark.parametrize("rows_a_side", [minhash.BLOCK_ROWS, 40])
def test_rows_of_a_group_grow_in_proportion(spark, monkeypatch, rows_a_side):
    """Classes that share most of their shingles and hang together little: no rows for pairs, and every link is found."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_a_side)
    deal, formed = minhash.in_blocks, {}

    def counted(related):
        out = deal(related)
        formed[n] = formed.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "in_blocks", counted)
    rnd = random.Random(3)
    common = [f"w{i}" for i in range(90)]
    for n in (200, 800) if rows_a_side > 40 else (200,):
        rows = []
        for i in range(n):
            words = list(common)
            for _ in range(rnd.choice([1, 2, 2, 3])):
                words[rnd.randrange(0, len(words), 6)] = f"own{rnd.randrange(60)}"
            rows.append((i, " ".join(words)))
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        found = sorted(map(tuple, got.collect()), key=str)
        if n == 200:
            assert found == brute_near(rows, 5) and 10 < sum(r[3] for r in found) < 190
    if rows_a_side > 40:
        assert 0 < formed[800] <= 6 * formed[200]


def test_near_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_low_percentages_are_refused(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=60)
