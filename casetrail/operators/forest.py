"""Random forests on many rows: rows as blocks of bins, trees grown level by level from sums of whole blocks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.session import checkpoint_folder, run_once, stored

_KNOWN = {"numTrees", "minInstancesPerNode", "featureSubsetStrategy", "seed", "maxDepth", "maxBins", "minInfoGain"}
#: Rows of a block, and sums that a task holds.
_ROWS, _SUMS = 65_536, 8_000_000
#: Limits of a 32-bit draw from which on a row is taken once, twice .. by a tree (Poisson, mean 1).
_TIMES = (np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)]) * 2.0**32).astype(np.uint64)


def knows(parameters: Mapping) -> bool:
    """Whether forests with these parameters can be grown here: bins are bytes, trees have a split, features a named share."""
    return (_KNOWN.issuperset(parameters) and parameters.get("maxDepth", 1) > 0 and parameters.get("maxBins", 2) <= 256
            and parameters.get("featureSubsetStrategy", "all") in ("auto", "sqrt", "log2", "onethird", "all"))


def _limits(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per column the values up to which rows may go left: between all values if these are few, else quantiles of all rows."""
    wanted = [a for i, c in enumerate(columns) for v in [F.col(f"`{c}`").cast("double")] for a in (
        F.percentile_approx(v, [j / bins for j in range(1, bins)], 10_000).alias(f"q{i}"), F.approx_count_distinct(v).alias(f"n{i}"), F.max(v).alias(f"m{i}"))]
    row, found = df.agg(*wanted).first(), []
    for i, c in enumerate(columns):
        if row[f"n{i}"] <= 2 * bins:
            values = np.sort([r[0] for r in df.select(F.col(f"`{c}`").cast("double")).distinct().collect()])
            if len(values) <= bins:
                found.append((values[:-1] + values[1:]) / 2)
                continue
        edges = np.unique(row[f"q{i}"])
        found.append(edges[edges < row[f"m{i}"]])
    return found


def _packed(df: DataFrame, columns: Sequence[str], label: str, limits: list[np.ndarray]) -> DataFrame:
    """Blocks of rows: number, rows, the bins of all columns one after the other, classes."""
    def pack(batches):
        held, n = [], 0

        def block():
            x, y = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
            return pd.DataFrame({"n": [len(y)], "bins": [x.tobytes()], "y": [y.tobytes()]})

        for batch in batches:
            values = batch.to_numpy(dtype=float, na_value=np.nan)
            y = values[:, -1]
            if np.isnan(values).any() or (y != np.floor(y)).any() or (y < 0).any() or (y >= 100).any():
                raise ValueError("features must be numbers, labels whole numbers from 0")
            held.append((np.stack([np.searchsorted(t, values[:, i]).astype(np.uint8) for i, t in enumerate(limits)]), y.astype(np.uint8)))
            n += len(y)
            if n >= _ROWS:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(f"`{label}`").cast("double").alias("y"))
    blocks = rows.mapInPandas(pack, "n int, bins binary, y binary")
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()))


def _subset(strategy: str, features: int) -> int:
    if strategy in ("auto", "sqrt"):
        return max(1, math.ceil(math.sqrt(features)))
    if strategy == "log2":
        return max(1, math.ceil(math.log2(features)))
    if strategy == "onethird":
        return max(1, math.ceil(features / 3))
    return features


class _Tree:
    """Nodes in breadth-first order: feature (-1: leaf), place of its limit, left child, gain, rows of each class."""

    def __init__(self) -> None:
        self.feature, self.limit, self.left, self.gain = (np.array([v], t) for v, t in ((-1, np.int32), (0, np.uint8), (-1, np.int32), (-1.0, float)))
        self.rows: np.ndarray | None = None
        self.open = np.array([0], np.int32)  # nodes that may be split next

    def split(self, feature: np.ndarray, limit: np.ndarray, gain: np.ndarray, left: np.ndarray, whole: np.ndarray, least: int) -> None:
        if self.rows is None:
            self.rows = whole[:1].copy()
        good = feature >= 0
        nodes, n = self.open[good], len(self.feature)
        self.feature[nodes], self.limit[nodes], self.gain[nodes] = feature[good], limit[good], gain[good]
        self.left[nodes] = n + 2 * np.arange(len(nodes), dtype=np.int32)
        both = np.stack([left[good], whole[good] - left[good]], axis=1).reshape(-1, whole.shape[1])
        self.rows = np.concatenate([self.rows, both])
        new = len(both)
        self.feature, self.left = (np.concatenate([a, np.full(new, -1, np.int32)]) for a in (self.feature, self.left))
        self.limit, self.gain = np.concatenate([self.limit, np.zeros(new, np.uint8)]), np.concatenate([self.gain, np.full(new, -1.0)])
        may = (both.sum(1) >= 2 * least) & ((both > 0).sum(1) > 1)
        self.open = (n + np.flatnonzero(may)).astype(np.int32)


def fit(df: DataFrame, columns: Sequence[str], label: str, estimator: RandomForestClassifier, weighted: bool) -> RandomForestClassificationModel:
    """The forest that the estimator describes, on all rows; classes weigh n / (2 * n_class) if ``weighted``.

    Every level of all trees is one pass over the blocks (several if the sums of a task would not fit). A tree takes each row as
    often as a draw says that follows from the seed, the tree and the block, so that no row's state is kept. Sums of a tree
    meet in one task that picks the splits; only these reach the driver.
    """
    spark, features = df.sparkSession, len(columns)
    get = estimator.getOrDefault
    seed, trees, depth, least = get("seed"), get("numTrees"), get("maxDepth"), get("minInstancesPerNode")
    gain_least, subset = get("minInfoGain"), _subset(get("featureSubsetStrategy"), features)
    limits = _limits(df, columns, get("maxBins"))
    width = max(2, max(len(t) for t in limits) + 1)
    blocks = _packed(df, columns, label, limits)

    def classes_of(batches):
        for batch in batches:
            total = sum((np.bincount(np.frombuffer(y, np.uint8), minlength=100) for y in batch["y"]), np.zeros(100, np.int64))
            yield pd.DataFrame({"y": np.arange(100), "n": total})

    sizes = {r["y"]: r["n"] for r in blocks.select("y").mapInPandas(classes_of, "y int, n long").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    classes = max(2, max(c for c, n in sizes.items() if n) + 1)
    total = sum(sizes.values())
    heavy = np.array([total / (2.0 * max(1, sizes[c])) if weighted else 1.0 for c in range(classes)])
    enough = np.array([len(t) for t in limits])

    def best_of(sums: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Best split of each node from the rows (node, chosen feature, bin, class)."""
        left = sums.cumsum(2)
        whole = left[:, 0, -1]
        right = whole[:, None, None] - left

        def parts(rows):
            w = rows * heavy
            size = w.sum(-1)
            return size, 1.0 - ((w / np.maximum(size, 1e-300)[..., None]) ** 2).sum(-1)

        (wl, il), (wr, ir), (w, i) = parts(left), parts(right), parts(whole)
        gain = i[:, None, None] - (wl * il + wr * ir) / np.maximum(w, 1e-300)[:, None, None]
        fits = (left.sum(-1) >= least) & (right.sum(-1) >= least) & (np.arange(width) < enough[chosen][..., None])
        flat = np.where(fits, gain, -np.inf).reshape(len(sums), -1)
        at, n = flat.argmax(1), np.arange(len(sums))
        found = flat[n, at]
        slot, limit = at // width, at % width
        good = (found > 0) & (found >= gain_least)
        return np.where(good, chosen[n, slot], -1), limit, np.where(good, found, -1.0), left[n, slot, limit], whole

    forest = [_Tree() for _ in range(trees)]
    for level in range(depth):
        rng = np.random.default_rng([seed, level])
        chosen = [np.argsort(rng.random((len(t.open), features)), axis=1)[:, :subset].astype(np.int64) for t in forest]
        waiting, group, held = [k for k in range(trees) if len(forest[k].open)], [], 0
        groups = []
        for k in waiting:
            size = len(forest[k].open) * subset * width * classes
            if group and held + size > _SUMS:
                groups, group, held = [*groups, group], [], 0
            group, held = [*group, k], held + size
        for group in [*groups, group] if group else []:
            state = {}
            for k in group:
                t = forest[k]
                slot = np.full(len(t.feature), -1, np.int64)
                slot[t.open] = np.arange(len(t.open))
                state[k] = (t.feature.astype(np.int64), t.limit, t.left.astype(np.int64), slot, chosen[k])
            shared = spark.sparkContext.broadcast(state)

            def counted(batches):
                sums = {k: np.zeros(len(s[4]) * subset * width * classes) for k, s in shared.value.items()}
                for batch in batches:
                    for block, n, packed, ys in zip(batch["block"], batch["n"], batch["bins"], batch["y"]):
                        bins, y = np.frombuffer(packed, np.uint8), np.frombuffer(ys, np.uint8)
                        for k, (feature, limit, left, slot, sub) in shared.value.items():
                            draw = np.random.default_rng([seed, k, int(block)]).integers(0, 2**32, n, dtype=np.uint32)
                            times = np.zeros(n, np.uint8)
                            for c in _TIMES:
                                if c < 2**32:
                                    times += draw >= np.uint32(c)
                            rows = np.flatnonzero(times)
                            node = np.zeros(len(rows), np.int64)
                            for _ in range(level):
                                f = feature[node]
                                inner = f >= 0
                                if not inner.all():
                                    rows, node, f = rows[inner], node[inner], f[inner]
                                node = left[node] + (bins[f * n + rows] > limit[node])
                            at = slot[node]
                            live = at >= 0
                            if not live.all():
                                rows, at = rows[live], at[live]
                            taken, cls = times[rows], y[rows]
                            for j in range(subset):
                                place = ((at * subset + j) * width + bins[sub[at, j] * n + rows]) * classes + cls
                                sums[k] += np.bincount(place, weights=taken, minlength=len(sums[k]))
                yield pd.DataFrame({"tree": pd.Series(list(sums), dtype="int32"), "sums": [s.astype(np.int64 if s.max(initial=0) > 2**31 - 1 else np.int32).tobytes() for s in sums.values()],
                                    "wide": [bool(s.max(initial=0) > 2**31 - 1) for s in sums.values()]})

            def picked(parts):
                k = int(parts["tree"].iloc[0])
                sums = sum(np.frombuffer(b, np.int64 if w else np.int32).astype(np.int64) for b, w in zip(parts["sums"], parts["wide"]))
                sub = shared.value[k][4]
                feature, limit, gain, left, whole = best_of(sums.reshape(len(sub), subset, width, classes), sub)
                return pd.DataFrame({"tree": pd.Series([k], dtype="int32"), "feature": [feature.astype(np.int32).tobytes()], "at": [limit.astype(np.uint8).tobytes()],
                                     "gain": [gain.tobytes()], "left": [left.tobytes()], "whole": [whole.tobytes()]})

            passed = blocks.mapInPandas(counted, "tree int, sums binary, wide boolean").groupBy("tree").applyInPandas(
                picked, "tree int, feature binary, at binary, gain binary, left binary, whole binary")
            for r in run_once(passed).collect():
                forest[r["tree"]].split(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["at"], np.uint8), np.frombuffer(r["gain"]),
                                        np.frombuffer(r["left"], np.int64).reshape(-1, classes), np.frombuffer(r["whole"], np.int64).reshape(-1, classes), least)
            shared.destroy()
    return _model(df, forest, limits, heavy, label, estimator)


def _nodes(tree: _Tree, limits: list[np.ndarray], heavy: np.ndarray) -> dict[str, list]:
    """A tree's nodes as MLlib stores them; two leaves of one parent that predict the same become one, as there."""
    stats = tree.rows * heavy
    size = stats.sum(1)
    impurity = 1.0 - ((stats / np.maximum(size, 1e-300)[:, None]) ** 2).sum(1)
    answer, left = stats.argmax(1), tree.left.copy()
    for i in range(len(left) - 1, -1, -1):
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and answer[a] == answer[a + 1]:
            left[i], answer[i] = -1, answer[a]
    kept, number = [0], {0: 0}
    for i in kept:
        if left[i] >= 0:
            for child in (int(left[i]), int(left[i]) + 1):
                number[child] = len(kept)
                kept.append(child)
    inner = left[kept] >= 0
    feature = np.where(inner, tree.feature[kept], -1)
    return {"id": list(range(len(kept))), "prediction": answer[kept].astype(float).tolist(), "impurity": impurity[kept].tolist(), "impurityStats": stats[kept].tolist(),
            "rawCount": tree.rows[kept].sum(1).tolist(), "gain": np.where(inner, tree.gain[kept], -1.0).tolist(),
            "leftChild": [number[int(left[i])] if left[i] >= 0 else -1 for i in kept], "rightChild": [number[int(left[i]) + 1] if left[i] >= 0 else -1 for i in kept],
            "featureIndex": feature.tolist(), "threshold": [[float(limits[f][tree.limit[i]])] if f >= 0 else [] for i, f in zip(kept, feature)]}


def _model(df: DataFrame, forest: Sequence[_Tree], limits: list[np.ndarray], heavy: np.ndarray, label: str,
           estimator: RandomForestClassifier) -> RandomForestClassificationModel:
    """MLlib's model of these trees: one of the estimator's on a few rows, stored, with its nodes replaced, and read again."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4().hex}"
    few = [(c, 1.0, Vectors.dense([float(c)] * len(limits))) for c in range(len(heavy))]
    estimator.fit(spark.createDataFrame(few, [label, "weight", "features"])).write().save(path)
    kinds: Mapping[str, pa.DataType] = {
        "treeID": pa.int32(), "id": pa.int32(), "prediction": pa.float64(), "impurity": pa.float64(), "impurityStats": pa.list_(pa.float64()), "rawCount": pa.int64(),
        "gain": pa.float64(), "leftChild": pa.int32(), "rightChild": pa.int32(), "featureIndex": pa.int32(), "threshold": pa.list_(pa.float64())}
    tables = []
    for k, tree in enumerate(forest):
        columns = _nodes(tree, limits, heavy)
        tables.append(pa.table({n: pa.array(columns[n] if n != "treeID" else [k] * len(columns["id"]), t) for n, t in kinds.items()}))
    nodes = spark.createDataFrame(pa.concat_tables(tables).combine_chunks())
    split = F.struct("featureIndex", F.col("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split")
    data = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split).alias("nodeData")
    nodes.select("treeID", data).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
