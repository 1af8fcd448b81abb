"""Line dedup, sharding and packing against brute force."""

import random

from pyspark.sql import functions as F

from casetrail.llm import lines, packing, shards

SCHEMA = "doc_id long, text string, source string, lang string, print long, cluster string, at int"


def rows_of(seed=4, n=80):
    rnd = random.Random(seed)
    pool = ["", "a", "bé", "the same line", " "] + [f"line {i} " + "x" * rnd.randint(0, 30) for i in range(14)]
    shared = [[rnd.choice(pool) for _ in range(rnd.randint(3, 7))] for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(pool) for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.5:
            k = rnd.randint(0, len(parts))
            parts[k:k] = rnd.choice(shared)
        rows.append((i, "\n".join(parts), "hot" if rnd.random() < 0.4 else f"s{i % 5}", "en", 1, "x", 2))
    rnd.shuffle(rows)
    long = "\n".join(["one"] * 500 + ["two", "three"] * 300)
    return rows + [rows[0], rows[0], (None, rows[1][1], None, None, None, None, None), (900, None, "hot", None, 1, None, 1), (901, "", None, None, 1, None, 1), (902, long, "hot", "de", 1, "c", 1)]


def brute_lines(rows, run, long=lines.LONG):
    seen, out = {}, {}
    for key, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = text.split("\n")
        gone = set()
        for size in range(1, run + 1):
            for p in range(len(ls) - size + 1):
                w = tuple(ls[p:p + size])
                if size < run and sum(map(len, w)) < long:
                    continue
                if w in seen:
                    gone |= set(range(p, p + size))
                seen.setdefault(w, (key, p))
        out[key] = (len(ls), len(gone), sum(g - 1 not in gone for g in gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_lines(spark):
    for run in (2, 3):
        rows = rows_of(run)
        want = brute_lines(rows, run)
        got = lines.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), run).collect()
        assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 200
        for r in got:
            assert (r.n_lines, r.n_removed, r.n_runs, r.kept) == want[r.doc_id], r.doc_id


def test_long_lines_are_runs(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    half = passage[: lines.LONG // 2]
    rows = rows_of(9) + [(2000 + i, t, "s", "en", 1, "x", 1) for i, t in enumerate(
        [passage, passage, f"a\n{passage}\nb", f"c\n{half}\n{half}\nd", f"e\n{half}\n{half}\nf", f"{half}\ng", half, half])]
    for long in (25, 40, lines.LONG):
        want = brute_lines(rows, 3, long)
        got = {r.doc_id: r for r in lines.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), long=long).collect()}
        assert {k: (r.n_lines, r.n_removed, r.n_runs, r.kept) for k, r in got.items()} == want
    assert [got[2000 + i].kept for i in range(8)] == [passage, "", "a\nb", f"c\n{half}\n{half}\nd", "e\nf", f"{half}\ng", half, half]


def test_lines_plan_has_no_python(spark):
    df = lines.remove_repeats(spark.createDataFrame(rows_of(), SCHEMA))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_shards(spark):
    rows = rows_of() + [(5000, "z" * 3000, "s", "en", 1, "x", 1)] + [(77, "same" * 25, "s", "en", 1, "x", 1)] * 40
    limit = 600
    got = shards.assign(spark.createDataFrame(rows, SCHEMA), limit).collect()
    assert len(got) == len(rows) and sorted(r.n_bytes for r in got) == sorted(len((r[1] or "").encode()) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for shard, members in by.items():
        total = sum(r.n_bytes for r in members)
        assert (total <= limit or len(members) == 1) and {r.shard_bytes for r in members} == {total} and {r.shard_rows for r in members} == {len(members)}
        assert {r.depth for r in members} == {len(shard)}
        # Only oversized buckets split: the parent of a leaf must not fit.
        if shard:
            above = [r for r in got if r.shard.startswith(shard[:-1])]
            assert sum(r.n_bytes for r in above) > limit and len(above) > 1
    assert not any(a != b and b.startswith(a) for a in by for b in by)
    assert {r.shard for r in shards.assign(spark.createDataFrame(rows[:3], SCHEMA), 10**9).collect()} == {""}


def slow_pack(items, capacity):
    """Best fit by looking at every bin."""
    bins, where = [], []
    for size, source, cluster in items:
        fits = [(room, k) for k, (room, s, c) in enumerate(bins) if room >= size and room > 0 and source not in s and cluster not in c]
        if fits:
            _, k = min(fits)
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= size
        bins[k][1] |= {source} - {-1}
        bins[k][2] |= {cluster} - {-1}
        where.append(k)
    return where


def test_best_fit_equals_scan():
    rnd = random.Random(2)
    for _ in range(30):
        items = [(rnd.randint(0, 50), rnd.randint(-1, 4), rnd.randint(-1, 6)) for _ in range(120)]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(*map(list, zip(*items)), 50) == slow_pack(items, 50)


def test_packing(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows_of()] + [(700, "w " * 205, "hot", "en", 1, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(docs, capacity=50, block_rows=40).collect()
    words = {}
    for r in rows:
        words.setdefault(r[0], []).append(len((r[1] or "").encode().split()))
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r.n_words)
    assert {k: sum(v) for k, v in per.items()} == {k: sum(v) for k, v in words.items()}
    source = {r[0]: r[2] for r in rows}
    bins = {}
    for r in got:
        bins.setdefault((r.block, r.bin), []).append(r)
    for members in bins.values():
        total = sum(r.n_words for r in members)
        assert total <= 50 and {r.fill for r in members} == {total}
        named = [source[r.doc_id] for r in members if source[r.doc_id] is not None]
        assert len(named) == len(set(named))
    assert len({b for b, _ in bins}) > 1


def test_word_count(spark):
    texts = ["", None, " ", "a", " a b\n", "\t\ta", "a b c", "x  y\x0b\x0cz"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", packing.word_count("text").alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len((t or "").encode().split()) for t in texts]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lines.remove_repeats(none).collect() == [] and shards.assign(none).collect() == [] and packing.pack(none).collect() == []


def test_shard_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 100, "s") for i in range(50)], "doc_id long, text string, source string")
    shards.write(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).where("n > 1000").count() == 0
