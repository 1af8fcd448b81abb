"""Skip-gram vectors of many nodes: no table of all nodes on the driver or in a task.

Nodes fall into buckets. Pairs of a node and its context are stored by how far their buckets lie apart; in a round, each task
trains one bucket of vectors against one bucket of context vectors, and no two tasks share either. After as many rounds as there are
buckets all pairs have been met once.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.session import stored

#: Nodes of a bucket, pairs of a step and contexts drawn per step as what the pairs are told from (counted as ``_NOISE`` a pair).
_BUCKET, _STEP, _DRAWN, _NOISE = 32_768, 512, 64, 5
_RATE = 0.1
_STATE = "slot int, kind int, bucket int, a binary, b binary, c binary"


def _discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote once nothing reads it any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        place = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _pairs(coded: DataFrame, buckets: int, window: int) -> DataFrame:
    """Packed pairs (nodes, contexts, distances) per bucket of the node and shift to the bucket of the context."""
    def pack(batches):
        for batch in batches:
            sizes = batch["codes"].map(len).to_numpy()
            if not len(sizes):
                continue
            codes = np.concatenate(batch["codes"].to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            found = []
            for d in range(1, window + 1):
                at = np.flatnonzero(owner[:-d] == owner[d:]) if len(owner) > d else np.zeros(0, np.int64)
                found += [(codes[at], codes[at + d], d), (codes[at + d], codes[at], d)]
            node, context = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            away = np.concatenate([np.full(len(f[0]), f[2], np.uint8) for f in found])
            own = node >> 32
            key = (((context >> 32) - own) % buckets) * buckets + own
            order = np.argsort(key, kind="stable")
            key, node, context, away = key[order], node[order].astype(np.int32), context[order].astype(np.int32), away[order]
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts = np.concatenate([[0], cuts]) if len(key) else []
            ends = np.concatenate([cuts, [len(key)]]) if len(key) else []
            rows = [(int(key[s] // buckets), int(key[s] % buckets), node[s:e].tobytes(), context[s:e].tobytes(), away[s:e].tobytes()) for s, e in zip(starts, ends)]
            yield pd.DataFrame(rows, columns=["shift", "slot", "a", "b", "c"])

    packed = coded.mapInPandas(pack, "shift int, slot int, a binary, b binary, c binary")
    # Sorted, so that a round reads its own pairs only.
    return stored(packed.repartition("shift").sortWithinPartitions("shift", "slot"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _move(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, slope: np.ndarray) -> None:
    """One step of the rows against the sum of their slopes, shorter the more a row has been moved (Adagrad by rows)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    total, rows = np.add.reduceat(slope[order], first, axis=0), rows[first]
    seen[rows] += (total * total).mean(1)
    table[rows] -= _RATE * total / np.sqrt(seen[rows] + 1e-10)[:, None]


def _trained(vectors, seen, contexts, context_seen, noise, node, context, away, window, rng):
    """One pass over pairs; a pair at distance d counts in window - d + 1 of window passes."""
    kept = np.flatnonzero(rng.random(len(node)) * window < window - away.astype(float) + 1)
    kept = rng.permutation(kept)
    for i in range(0, len(kept), _STEP):
        n, o = node[kept[i:i + _STEP]], context[kept[i:i + _STEP]]
        drawn = np.searchsorted(noise, rng.random(_DRAWN) * noise[-1], side="right").clip(0, len(noise) - 1)
        x, y, z = vectors[n], contexts[o], contexts[drawn]
        near = (_sigmoid((x * y).sum(1)) - 1.0)[:, None]
        far = _sigmoid(x @ z.T) * (_NOISE / _DRAWN)
        _move(vectors, seen, n, near * y + far @ z)
        _move(contexts, context_seen, np.concatenate([o, drawn]), np.concatenate([near * x, far.T @ x]))


def fit(sentences: DataFrame, nodes: int, dim: int, window: int, seed: int, iterations: int) -> DataFrame:
    """``node`` and its vector ``v`` from rows (walk, sentence) over so many different nodes."""
    # Two buckets a core if these are not too small, as a round has a task per bucket.
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    buckets = max(2, -(-nodes // _BUCKET), min(2 * cores, nodes // 1024))
    words = sentences.select("walk", F.posexplode("sentence").alias("step", "node"))
    counts = words.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int"))
    vocabulary = stored(counts.withColumn("at", (F.row_number().over(Window.partitionBy("bucket").orderBy("node")) - 1).cast("long")))
    code = (F.col("bucket").cast("long") * (1 << 32) + F.col("at")).alias("code")
    coded = words.join(vocabulary.select("node", code), "node").groupBy("walk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "code"))), lambda s: s["code"]).alias("codes")).select("codes")
    pairs = _pairs(coded, buckets, window)

    def begun(rows):
        rows = rows.sort_values("at")
        slot, n = int(rows["bucket"].iloc[0]), len(rows)
        rng = np.random.default_rng([seed, slot])
        zero = np.zeros(n, np.float32).tobytes()
        start = ((rng.random((n, dim)) - 0.5) / dim).astype(np.float32).tobytes()
        noise = np.cumsum(rows["n"].to_numpy(float) ** 0.75).tobytes()
        return pd.DataFrame({"slot": slot, "kind": [0, 1], "bucket": slot, "a": [start, np.zeros((n, dim), np.float32).tobytes()], "b": [zero, zero], "c": [b"", noise]})

    state = stored(vocabulary.select("bucket", "at", "n").groupBy("bucket").applyInPandas(begun, _STATE))
    def round_of(turn, shift):
        def work(rows):
            tables = {int(k): rows[rows["kind"] == k] for k in (0, 1, 2)}
            if any(len(tables[k]) == 0 for k in (0, 1, 2)):
                return rows[rows["kind"] < 2]
            (mine, other), slot = (tables[k].iloc[0] for k in (0, 1)), int(rows["slot"].iloc[0])
            vectors, contexts = (np.frombuffer(t["a"], np.float32).reshape(-1, dim).copy() for t in (mine, other))
            seen, context_seen = (np.frombuffer(t["b"], np.float32).copy() for t in (mine, other))
            node, context, away = (np.frombuffer(b"".join(tables[2][c]), kind) for c, kind in (("a", np.int32), ("b", np.int32), ("c", np.uint8)))
            order = np.lexsort((away, context, node))  # however the rows came in
            _trained(vectors, seen, contexts, context_seen, np.frombuffer(other["c"]), node[order], context[order], away[order], window,
                     np.random.default_rng([seed, turn, shift, slot]))
            return pd.DataFrame({"slot": slot, "kind": [0, 1], "bucket": [mine["bucket"], other["bucket"]], "a": [vectors.tobytes(), contexts.tobytes()],
                                 "b": [seen.tobytes(), context_seen.tobytes()], "c": [b"", other["c"]]})

        return work

    shift_order = np.random.default_rng([seed, buckets])
    for turn in range(iterations):
        for shift in map(int, shift_order.permutation(buckets)):
            placed = F.when(F.col("kind") == 0, F.col("bucket")).otherwise(F.pmod(F.col("bucket") - shift, F.lit(buckets))).cast("int")
            met = state.withColumn("slot", placed).unionByName(pairs.where(F.col("shift") == shift).select(
                "slot", F.lit(2).alias("kind"), F.lit(-1).alias("bucket"), "a", "b", "c"))
            before, state = state, stored(met.repartition(buckets, "slot").groupBy("slot").applyInPandas(round_of(turn, shift), _STATE))
            _discard(before)
    _discard(pairs)

    def opened(batches):
        for batch in batches:
            for bucket, packed in zip(batch["bucket"], batch["a"]):
                v = np.frombuffer(packed, np.float32).reshape(-1, dim)
                for i in range(0, len(v), 4096):
                    yield pd.DataFrame({"bucket": np.int32(bucket), "at": np.arange(i, i + len(v[i:i + 4096])), "v": list(v[i:i + 4096])})

    vectors = state.where("kind = 0").select("bucket", "a").mapInPandas(opened, "bucket int, at long, v array<float>")
    return vocabulary.select("bucket", "at", "node").join(vectors, ["bucket", "at"]).select("node", "v")
