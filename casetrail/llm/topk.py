"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into blocks. The longest block gives each query a first threshold. For every block the
threshold becomes a local one, the cosine a vector of the block's greatest length would need: over 1 the block is
left out, high ones prune by coordinates (a vector near in angle is near in each coordinate), low ones by length alone.
What is left is verified by exact integer products. Query blocks meet vector blocks by a join on the block number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.llm import base

BLOCK = 1024
QUERIES = 256
#: Local cosine thresholds from here on prune by coordinates, below by length.
COSINE = 0.3
#: Coordinates looked at, those in which the query is largest.
COORDINATES = 4
#: Lengths are told apart in steps of 2**(1/8); doubles have under 2**15 such steps, so the list of steps is small.
STEPS = 8
_BLOCK = "level int, block long, top double, n int, dim int, ids binary, own binary, vectors binary"


#: Components from here on would give lengths that a double cannot hold; no float reaches it.
LARGEST = 2.0**480


def whole_vector(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, a whole number held by a double: from 2**53 on every double is whole."""
    def whole(y: Column) -> Column:
        return F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, lambda x: whole(F.lit(float(scale)) * x.cast("double")))


def _valid(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def _level(length: Column) -> Column:
    """Step of a length, largest lengths first: 0 upwards."""
    return F.lit(16 * 1024) - F.floor(F.log2(F.greatest(length, F.lit(0.5))) * STEPS).cast("int")


def _packed(rows: int):
    """Rows of a partition, sorted by length, in blocks of one level with at most ``rows`` vectors."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            levels = np.asarray(batch.column("level"))
            for cut in np.split(np.arange(len(levels)), np.flatnonzero(np.diff(levels)) + 1):
                part = batch.slice(int(cut[0]), len(cut)) if len(cut) else None
                while part is not None and part.num_rows:
                    if held and (held[0].column("level")[0].as_py() != part.column("level")[0].as_py() or count == rows):
                        yield _block(held)
                        held, count = [], 0
                    take = min(rows - count, part.num_rows)
                    held.append(part.slice(0, take))
                    count += take
                    part = part.slice(take)
        if held:
            yield _block(held)
    return task


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    vectors = [np.asarray(v, np.float64) for v in whole["v"].combine_chunks().to_numpy(zero_copy_only=False)]
    dim = max(map(len, vectors))
    matrix = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        matrix[k, : len(v)] = v
    own = whole["own"].to_numpy()
    return pa.RecordBatch.from_pydict({"level": pa.array([whole["level"][0].as_py()], pa.int32()), "block": pa.array([int(own[0])], pa.int64()),
                                       "top": [float(np.max(whole["length"].to_numpy()))], "n": pa.array([len(vectors)], pa.int32()),
                                       "dim": pa.array([dim], pa.int32()), "ids": [whole["id"].to_numpy().tobytes()],
                                       "own": [own.tobytes()], "vectors": [matrix.tobytes()]})


class _Block:
    def __init__(self, row: dict, prefix: str = ""):
        self.ids, self.own = (np.frombuffer(row[prefix + n], np.int64) for n in ("ids", "own"))
        self.real = np.frombuffer(row[prefix + "vectors"], np.float64).reshape(len(self.ids), row[prefix + "dim"])
        self.length = np.sqrt(np.einsum("ij,ij->i", self.real, self.real))
        self.largest = float(np.abs(self.real).max(initial=0))


def products(block: _Block, rows: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point where every partial sum is a whole number under 2**53."""
    dim = min(len(real), block.real.shape[1])
    if dim * block.largest * float(np.abs(real).max(initial=0)) < 2**53:
        return (block.real[rows, :dim] @ real[:dim]).astype(np.int64)
    query = [int(x) for x in real[:dim]]
    return np.array([sum(int(a) * b for a, b in zip(block.real[r, :dim], query)) for r in rows], object)


def _least(score: int | np.integer) -> float:
    """A double at or just under a score."""
    return float(score) if abs(int(score)) < 2**53 else float(np.nextafter(float(score), -np.inf))


def _beyond(score: int) -> bytes:
    """Bytes that sort like the scores a long cannot hold; empty for all others."""
    return b"" if -(2**63) <= score < 2**63 else (score + 2**1023).to_bytes(129, "big")


def candidates(block: _Block, real: np.ndarray, length: float, threshold: float) -> np.ndarray:
    """Rows that may reach the threshold: by length, and by coordinates where the local cosine threshold is high."""
    if threshold <= 0 or length == 0:
        return np.arange(len(block.ids))
    slack = threshold * (1 - 1e-9) - 1e-6  # bounds are rounded doubles; a little room keeps them safe
    top = float(block.length.max(initial=0)) * length
    if slack > top:
        return np.zeros(0, np.int64)
    rows = np.flatnonzero(block.length * length >= slack)
    local = min(1.0, slack / top)
    if local >= COSINE:
        dim = min(len(real), block.real.shape[1])
        spread = np.sqrt(max(0.0, 1 - local * local))
        for c in np.argsort(-np.abs(real[:dim]))[:COORDINATES]:
            q = real[c] / length
            room = spread * np.sqrt(max(0.0, 1 - q * q)) + 1e-9
            # Within the angle of the local threshold, each coordinate of the unit vector lies in this interval; beyond
            # the query's own coordinate the interval reaches 1 if the query itself lies within the angle of the axis.
            low = q * local - room if q > -local else -1.0
            high = q * local + room if q < local else 1.0
            unit = block.real[rows, c] / np.maximum(block.length[rows], 1e-300)
            rows = rows[(unit >= low - 1e-9) & (unit <= high + 1e-9)]
    return rows


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def _first_thresholds(longest, k: int):
    """Adds to each query block the k-th best score of each query within the longest vectors (-inf if fewer)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(longest.value) if longest.value else None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                queries = _Block(row)
                least = np.full(len(queries.ids), -np.inf)
                for i in range(len(queries.ids) if block else 0):
                    rows = np.flatnonzero(block.own != queries.own[i])
                    if len(rows) >= k:
                        scores = products(block, rows, queries.real[i])
                        least[i] = _least(np.sort(scores)[-k])
                # The cosine-free bound: a block whose top length is under this for every query can be left out.
                need = np.where((least > 0) & (queries.length > 0), least * (1 - 1e-9) / np.maximum(queries.length, 1e-300), 0.0).min()
                out.append({"q_block": row["block"], "q_dim": row["dim"], "q_ids": row["ids"], "q_own": row["own"],
                            "q_vectors": row["vectors"], "least": least.tobytes(), "need": float(need)})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("q_block", pa.int64()), ("q_dim", pa.int32()), ("q_ids", pa.binary()),
                                                                 ("q_own", pa.binary()), ("q_vectors", pa.binary()), ("least", pa.binary()), ("need", pa.float64())]))
    return task


def _verify(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"query_id": [], "query_own": [], "vec_id": [], "vec_own": [], "score": []}
            beyond: list[bytes] = []
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                block, queries = _Block(row), _Block(row, "q_")
                least = np.frombuffer(row["least"])
                for i in range(len(queries.ids)):
                    rows = candidates(block, queries.real[i], float(queries.length[i]), float(least[i]))
                    rows = rows[block.own[rows] != queries.own[i]]
                    if not len(rows):
                        continue
                    scores = products(block, rows, queries.real[i])
                    best = _best(block.ids[rows], scores, k)
                    best = best[scores[best] >= least[i]]
                    out["query_id"] += [int(queries.ids[i])] * len(best)
                    out["query_own"] += [int(queries.own[i])] * len(best)
                    out["vec_id"] += block.ids[rows[best]].tolist()
                    out["vec_own"] += block.own[rows[best]].tolist()
                    out["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores[best]]
                    beyond += [_beyond(int(s)) for s in scores[best]]
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()} | {"beyond": pa.array(beyond, pa.binary())})
    return task


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row that ``is_query`` selects: its k highest integer products with all other rows.

    Columns ``query_id, rank`` (from 1), ``vec_id, score``; ties go to the smaller id. Vectors that are null, have a
    null, NaN or infinite component (or one of 2**480 or more, which only doubles reach), or no id take no part. Ranks follow the exact
    scores; those beyond a long are then shown as its ends.
    Missing trailing components count as 0. Rows are told apart even if ids repeat: a query is compared with every
    row but itself, and a repeated query id gets the ranks of each of its rows. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    base.small_batches(spark, 4096)
    rows = vectors.where(F.col(key).isNotNull() & _valid(vector)).select(
        F.col(key).cast("long").alias("id"), whole_vector(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = base.store(rows.withColumn("own", F.monotonically_increasing_id()).withColumn("length", length).withColumn("level", _level(F.col("length"))), "vectors")
    parts = base.partitions(rows)
    dealt = rows.repartitionByRange(parts, "level", "own").sortWithinPartitions("level", F.desc("length"), "own")
    blocks = base.store(dealt.select("level", "id", "own", "length", "v").mapInArrow(_packed(BLOCK), _BLOCK), "blocks")
    asked = rows.where("asks").repartitionByRange(parts, "level", "own").sortWithinPartitions("level", F.desc("length"), "own")
    queries = asked.select("level", "id", "own", "length", "v").mapInArrow(_packed(QUERIES), _BLOCK)
    longest = blocks.where("n >= %d" % (2 * k)).orderBy(F.desc("top"), "block").limit(1).collect()  # one block, at most BLOCK vectors
    shared = spark.sparkContext.broadcast(longest[0].asDict() if longest else None)
    asking = base.store(queries.mapInArrow(_first_thresholds(shared, k), "q_block long, q_dim int, q_ids binary, q_own binary, q_vectors binary, least binary, need double"), "queries")
    # Every query block with the blocks of the levels it needs. The list of levels is short whatever the input (see STEPS).
    levels = F.array(*[F.lit(r.level) for r in blocks.select("level").distinct().orderBy("level").collect()]).cast("array<int>")
    chosen = asking.select("q_block", F.explode(F.filter(levels, lambda level: level <= _level(F.col("need")))).alias("level"))
    pairs = chosen.join(blocks.select("level", "block"), "level").select("q_block", "block")
    joined = pairs.join(blocks, "block").join(asking, "q_block")
    base.small_batches(spark, 16)  # a row holds two blocks
    found = joined.select("dim", "ids", "own", "vectors", "q_dim", "q_ids", "q_own", "q_vectors", "least").mapInArrow(
        _verify(k), "query_id long, query_own long, vec_id long, vec_own long, score long, beyond binary")
    order = Window.partitionBy("query_id", "query_own").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", "vec_own")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
