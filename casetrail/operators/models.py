"""Model training, scoring and cluster work on MLlib."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.operators import forest, stats
from casetrail.operators.ordering import null_safe_join, ordered
from casetrail.operators.prep import perturb
from casetrail.operators.ranks import top_k
from casetrail.operators.sampling import class_weights, kfold, rank_bins, stratified_split
from casetrail.operators.temporal import bounded
from casetrail.session import cut_lineage, run_once


def learner(kind: str, label: str = "y", weight: str | None = "weight", **parameters) -> Estimator:
    """``forest``, ``boosted`` or ``logistic`` over a ``features`` vector."""
    shared = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    if kind == "forest":
        defaults = {"numTrees": 500, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt", "seed": 42, "maxDepth": 10}
        return RandomForestClassifier(**(shared | defaults | parameters))
    if kind == "boosted":
        defaults = {"maxIter": 400, "stepSize": 0.05, "maxDepth": 5, "seed": 42}
        return GBTClassifier(**(shared | defaults | parameters))
    if kind == "logistic":
        return LogisticRegression(**(shared | {"maxIter": 200} | parameters))
    raise ValueError(f"unknown learner {kind!r}")


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")


def positive(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def dealt(df: DataFrame) -> DataFrame:
    """Many rows in fewer partitions than cores are dealt over all cores, as every pass of a fit and every tree of a score reads them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if bounded(df) or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def train_model(train: DataFrame, columns: Sequence[str], kind: str = "forest", label: str = "y", weighted: bool = True,
                **parameters) -> PipelineModel:
    """Class-weighted classifier on the given feature columns. Forests on many rows are grown by ``forest.fit``."""
    train = dealt(train)
    if kind == "forest" and forest.knows(parameters) and not bounded(train):
        model = forest.fit(train, columns, label, learner(kind, label, "weight" if weighted else None, **parameters), weighted)
        return PipelineModel([assembler(columns), model])
    data = class_weights(train, label) if weighted else train
    stages = [assembler(columns), learner(kind, label, "weight" if weighted else None, **parameters)]
    return Pipeline(stages=stages).fit(data)


def score(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Rows with the probability of class 1."""
    scored = model.transform(df).withColumn(out, positive())
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def calibrated_scores(train: DataFrame, test: DataFrame, columns: Sequence[str], ids: Sequence[str], kind: str = "logistic",
                      label: str = "y", cv: int = 3, seed: int = 42, **parameters) -> DataFrame:
    """Test ids, label and mean probability of ``cv`` classifiers, each isotonically calibrated on its held-out part."""
    inner = cut_lineage(kfold(train, label, ids, cv, f"{seed}:inner", "__inner"))
    total = None
    for i in range(cv):
        model = train_model(inner.where(F.col("__inner") != i), columns, kind, label, **parameters)
        held = score(model, inner.where(F.col("__inner") == i), "__raw")
        iso = IsotonicRegression(featuresCol="__raw", labelCol=label, predictionCol="__p").fit(held)
        part = iso.transform(score(model, test, "__raw")).select(*ids, label, (F.col("__p") / cv).alias("__p"))
        total = part if total is None else total.unionByName(part)
    return total.groupBy(*ids, label).agg(F.sum("__p").alias("p"))


def oof_scores(df: DataFrame, columns: Sequence[str] | Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, list[str]]],
               ids: Sequence[str], label: str = "y", k: int = 5, kind: str = "logistic", calibrate: bool = True,
               seed: int = 42, **parameters) -> DataFrame:
    """Pooled out-of-fold scores (ids, label, fold, p): every fit, calibration included, sees train folds only.

    ``columns`` is a list, or a function (train, test) -> (train, test, columns) that refits preprocessing per fold.
    """
    folds = cut_lineage(kfold(df, label, ids, k, seed))
    total = None
    for i in range(k):
        train, test = folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)
        used = list(columns) if not callable(columns) else None
        if used is None:
            train, test, used = columns(train, test)
        if calibrate:
            part = calibrated_scores(train, test, used, ids, kind, label, seed=seed, **parameters)
        else:
            part = score(train_model(train, used, kind, label, **parameters), test).select(*ids, label, "p")
        part = part.withColumn("fold", F.lit(i))
        total = part if total is None else total.unionByName(part)
    return total


def ensemble(scores: DataFrame, ids: Sequence[str], p: str = "p") -> DataFrame:
    """Mean score over models per row."""
    return scores.groupBy(*ids).agg(F.avg(p).alias(p))


def search(train: DataFrame, columns: Sequence[str], kind: str, grid: Mapping[str, Sequence], label: str = "y", folds: int = 3,
           parallelism: int = 2, seed: int = 42, ids: Sequence[str] = ("id",), draws: int | None = None, **parameters) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated grid search by AUROC: the best model and the table of mean scores.

    ``train`` may bring its folds as a column ``fold`` (0 up to folds - 1); without one they are dealt in hash order of ``ids``, stratified
    by the label. ``draws`` tries so many combinations of the grid, in hash order, instead of all.
    """
    estimator = learner(kind, label, "weight", **parameters)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), list(values))
    maps = builder.build()
    if draws is not None:
        named = {", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)): m for m in maps}
        maps = [named[n] for n in sorted(named, key=lambda n: hashlib.md5(f"{seed}:{n}".encode()).hexdigest())[:draws]]
    if "fold" not in train.columns:
        train = cut_lineage(kfold(train, label, ids, folds, seed))
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    cv = CrossValidator(estimator=Pipeline(stages=[assembler(columns), estimator]), estimatorParamMaps=maps,
                        evaluator=evaluator, numFolds=folds, parallelism=parallelism, foldCol="fold")
    model = cv.fit(class_weights(train, label))
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(a))
            for m, a in zip(maps, model.avgMetrics, strict=True)]
    return model.bestModel, train.sparkSession.createDataFrame(rows, "parameters string, auroc double")


def select_vars(train: DataFrame, columns: Sequence[str], method: str, label: str = "y", k: int = 20, ids: Sequence[str] = (),
                strength: float = 0.01, **parameters) -> list[str]:
    """Chosen columns: ``l1`` non-zero coefficients (all if none), ``importance`` top ``k`` of a forest, ``forward``
    greedy additions by validation AUROC until the gain falls below 1e-4.
    """
    columns = list(columns)
    if method == "l1":
        data = class_weights(train, label)
        stages = [VectorAssembler(inputCols=columns, outputCol="__x"),
                  StandardScaler(inputCol="__x", outputCol="features", withMean=True),
                  LogisticRegression(labelCol=label, weightCol="weight", elasticNetParam=1.0, regParam=strength)]
        coefficients = Pipeline(stages=stages).fit(data).stages[-1].coefficients.toArray()
        kept = [c for c, b in zip(columns, coefficients, strict=True) if b != 0]
        return kept or columns
    if method == "importance":
        model = train_model(train, columns, "forest", label, **({"numTrees": 100} | parameters))
        ranked = sorted(zip(model.stages[-1].featureImportances.toArray(), columns, strict=True), key=lambda x: (-x[0], x[1]))
        return [c for _, c in ranked[:k]]
    if method == "forward":
        parts = cut_lineage(stratified_split(train, label, ids, (0.75, 0.25), 42, "__part"))
        fit, check = parts.where(F.col("__part") == "train"), parts.where(F.col("__part") != "train")
        chosen, best = [], -1.0
        while len(chosen) < k and len(chosen) < len(columns):
            trials = []
            for c in columns:
                if c not in chosen:
                    scored = score(train_model(fit, [*chosen, c], "logistic", label, maxIter=50), check)
                    trials.append((stats.auroc(scored, y=label).first()["auroc"] or 0.0, c))
            gain, name = max(trials, key=lambda x: (x[0], x[1]))
            if gain <= best + 1e-4:
                break
            best, chosen = gain, [*chosen, name]
        return chosen
    raise ValueError(f"unknown method {method!r}")


def permutation_importance(model: PipelineModel, df: DataFrame, groups: Mapping[str, Sequence[str]], ids: Sequence[str],
                           label: str = "y", repeats: int = 3, seed: int = 42) -> DataFrame:
    """Mean drop of average precision when a source column's block (its one-hot columns) is dealt to other rows."""
    def area(rows: DataFrame) -> list[float | None]:
        scored = score(model, rows).select(F.lit(0).alias("__model"), label, "p")
        return [r["auprc"] for r in run_once(stats.average_precision(scored, ["__model"], label)).collect()]

    # One permutation after the other, so that only one's shuffles lie on disk.
    base, drops = area(df), []
    for name, columns in groups.items():
        for r in range(repeats):
            moved = area(perturb(df, columns, "shuffle", ids=ids, seed=f"{seed}:{name}:{r}"))
            drops += [(name, a - b if a is not None and b is not None else None) for a, b in zip(base, moved, strict=True)]
    return df.sparkSession.createDataFrame(drops, "feature string, drop double").groupBy("feature").agg(F.avg("drop").alias("importance"))


#: Rows of a group per block of vectors, and rows of a group from which its starts are drawn.
_BLOCK_ROWS, _START_ROWS = 1024, 256


def within_group_kmeans(df: DataFrame, group: str, columns: Sequence[str], ids: Sequence[str],
                        ks: Sequence[int] = (1, 2, 3, 4), minimum: int = 50, seed: int = 42, starts: int = 10,
                        rounds: int = 20) -> DataFrame:
    """Sub-clusters inside each group: features standardised per group, the ``k`` with the best silhouette (of squared
    distances) whose clusters all reach ``minimum`` rows; one cluster when none does. Each ``k`` starts from ``starts``
    sets of centres, spread by squared distance over rows drawn by hash, and keeps the fit of least cost.

    All groups, ``k`` and starts are fitted in the same passes, ``rounds`` at most: blocks of a group's vectors meet its
    centres, tasks add up the blocks of a group first, and only sums per centre are shuffled. A silhouette follows from the sums
    of a cluster, so no pairs of rows are formed. Rows with a null or non-finite feature are in cluster 0 of their
    group and take no part in the fit. Rows without a group are a group. ``ids`` tell the rows of a group apart.
    """
    columns, ids, dim = list(columns), list(ids), len(columns)
    tried = sorted({k for k in ks if k > 1})
    fits = [(k, s) for k in tried for s in range(starts)]
    begins = np.concatenate([[0], np.cumsum([k for k, _ in fits])]).astype(int)  # first centre of each fit
    data = df.select(group, *ids, F.array(*[F.col(c).cast("double") for c in columns]).alias("__x"))
    if not tried:
        return data.select(*ids, group, F.lit(0).alias("sub"))
    # Written once: all that follows works on one array column instead of a plan over every feature.
    data = cut_lineage(data)
    fine = F.forall("__x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    per_feature = data.where(fine).select(F.col(group).alias("__g"), F.posexplode("__x").alias("__at", "__v")).groupBy("__g", "__at").agg(
        F.count(F.lit(1)).alias("n"), F.avg("__v").alias("m"), F.stddev_samp("__v").alias("s"))
    moments = per_feature.groupBy("__g").agg(F.max("n").alias("__n"), F.array_sort(F.collect_list(F.struct("__at", "m", "s"))).alias("__all")).select(
        "__g", "__n", F.col("__all.m").alias("__mean"), F.col("__all.s").alias("__sd"))
    known = data.where(fine).join(moments.where(F.col("__n") >= tried[0] * minimum), F.col(group).eqNullSafe(F.col("__g")))
    scaled = F.zip_with(F.zip_with("__x", "__mean", lambda x, m: x - m), "__sd", lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
    place = F.xxhash64(F.lit(seed), *ids)
    # Blocks of about _BLOCK_ROWS vectors of one group; the hash also serves to draw the rows that starts come from.
    rows = known.select(F.to_json(F.struct(F.col(group))).alias("__key"), F.struct(*ids).alias("__ids"), scaled.alias("__x"), place.alias("__h"), "__n")
    blocks = cut_lineage(rows.groupBy("__key", F.pmod("__h", F.ceil(F.col("__n") / _BLOCK_ROWS)).alias("__b")).agg(
        F.max("__n").alias("__n"), F.collect_list(F.struct("__h", "__ids", "__x")).alias("__rows")))
    drawn = blocks.select("__key", F.slice(F.array_sort(F.transform("__rows", lambda r: F.struct(r["__h"].alias("h"), r["__x"].alias("x")))), 1, _START_ROWS).alias("r")).select(
        "__key", F.inline("r"))
    drawn = top_k(drawn, ["__key"], [F.asc("h"), F.asc("x")], _START_ROWS)

    def first_centres(rows):
        rows = rows.sort_values("h")
        x = np.array(rows["x"].tolist(), float).reshape(-1, dim)
        out = []
        for k, s in fits:
            rng = np.random.default_rng([seed, k, s])
            chosen = [int(rng.integers(len(x)))]
            away = ((x - x[chosen[0]]) ** 2).sum(1)
            while len(chosen) < k:
                total = away.sum()
                chosen.append(int(rng.choice(len(x), p=away / total)) if total > 0 else chosen[0])
                away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
            out.append(x[chosen])
        return pd.DataFrame({"__key": [rows["__key"].iloc[0]], "centres": [np.concatenate(out).ravel()], "moved": [1.0]})

    centre_schema = "__key string, centres array<double>, moved double"
    centres = cut_lineage(drawn.groupBy("__key").applyInPandas(first_centres, centre_schema))

    def nearest(x, c):
        """Squared distance and number of each row's nearest centre, per fit."""
        away = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)
        for a, b in zip(begins, begins[1:]):
            at = away[:, a:b].argmin(1)
            yield a, b, at, away[np.arange(len(x)), a + at]

    def sums_of(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, vectors, packed in zip(batch["__key"], batch["__x"], batch["centres"]):
                x, c = np.array(list(vectors), float).reshape(-1, dim), np.asarray(packed).reshape(-1, dim)
                total = held.setdefault(key, np.zeros((len(c), dim + 2)))
                square = (x * x).sum(1)
                for a, b, at, _ in nearest(x, c):
                    member = np.zeros((b - a, len(x)))
                    member[at, np.arange(len(x))] = 1
                    total[a:b] += member @ np.column_stack([x, square, np.ones(len(x))])
                if len(held) * total.nbytes > 64 << 20:
                    yield pd.DataFrame({"__key": list(held), "sums": [v.ravel() for v in held.values()]})
                    held = {}
        if held:
            yield pd.DataFrame({"__key": list(held), "sums": [v.ravel() for v in held.values()]})

    def partial_sums(centres):
        met = blocks.select("__key", F.transform("__rows", lambda r: r["__x"]).alias("__x")).join(centres.select("__key", "centres"), "__key")
        return met.mapInPandas(sums_of, "__key string, sums array<double>").join(centres.select("__key", "centres"), "__key")

    def moved_centres(parts):
        old = np.asarray(parts["centres"].iloc[0]).reshape(-1, dim)
        total = sum(np.asarray(v) for v in parts["sums"]).reshape(-1, dim + 2)
        n = total[:, -1:]
        new = np.where(n > 0, total[:, :dim] / np.maximum(n, 1), old)
        return pd.DataFrame({"__key": [parts["__key"].iloc[0]], "centres": [new.ravel()], "moved": [float(np.abs(new - old).max())]})

    def chosen_fit(parts):
        """The best fit of a group: its centres, or none."""
        total = sum(np.asarray(v) for v in parts["sums"]).reshape(-1, dim + 2)
        c = np.asarray(parts["centres"].iloc[0]).reshape(-1, dim)
        n = total[:, -1]
        mean = total[:, :dim] / np.maximum(n, 1)[:, None]
        inside = total[:, dim] - n * (mean * mean).sum(1)
        best = []
        for k in tried:
            mine = [j for j, (other, _) in enumerate(fits) if other == k]
            j = min(mine, key=lambda j: (inside[begins[j]: begins[j + 1]].sum(), j))
            if n[begins[j]: begins[j + 1]].min() >= max(1, minimum):
                best.append((k, c[begins[j]: begins[j + 1]].ravel(), mean[begins[j]: begins[j + 1]].ravel(), (total[begins[j]: begins[j + 1], dim]).copy(), n[begins[j]: begins[j + 1]].copy()))
        return pd.DataFrame({"__key": [parts["__key"].iloc[0]] * len(best), **{name: [b[i] for b in best] for i, name in enumerate(("k", "c", "mean", "square", "n"))}})

    for _ in range(rounds):
        centres = cut_lineage(partial_sums(centres).groupBy("__key").applyInPandas(moved_centres, centre_schema))
        if not centres.where("moved > 1e-4").limit(1).count():
            break
    candidates = cut_lineage(partial_sums(centres).groupBy("__key").applyInPandas(
        chosen_fit, "__key string, k int, c array<double>, mean array<double>, square array<double>, n array<double>"))

    def labels_of(batches):
        for batch in batches:
            subs, widths = [], []
            for vectors, k, packed, mean, square, n in zip(*(batch[c] for c in ("__x", "k", "c", "mean", "square", "n"))):
                x, c, mean = np.array(list(vectors), float).reshape(-1, dim), np.asarray(packed).reshape(k, dim), np.asarray(mean).reshape(k, dim)
                at = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(1)
                # Mean squared distance of each row to the rows of each cluster; in its own, it does not count itself.
                away = (x * x).sum(1)[:, None] + (np.asarray(square) / n)[None, :] - 2 * x @ mean.T
                own = away[np.arange(len(x)), at]
                size = np.asarray(n)[at]
                own = own * size / np.maximum(size - 1, 1)
                away[np.arange(len(x)), at] = np.inf
                other = away.min(1)
                top = np.maximum(own, other)
                widths.append(float(np.where((size > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0).sum()))
                subs.append(at.astype("int32"))
            yield pd.DataFrame({"__key": batch["__key"], "__b": batch["__b"], "k": batch["k"], "subs": subs, "width": widths})

    met = blocks.select("__key", "__b", F.transform("__rows", lambda r: r["__x"]).alias("__x")).join(candidates, "__key")
    labelled = cut_lineage(met.mapInPandas(labels_of, "__key string, __b long, k int, subs array<int>, width double"))
    widths = labelled.groupBy("__key", "k").agg(F.sum("width").alias("w")).where("w > 0")
    best = widths.groupBy("__key").agg(F.max_by("k", F.struct("w", -F.col("k"))).alias("k"))
    found = labelled.join(best, ["__key", "k"]).join(blocks, ["__key", "__b"]).select(
        "__key", F.inline(F.transform("__rows", lambda r, k: F.struct(r["__ids"].alias("i"), F.get("subs", k).alias("s")))))
    found = found.select("__key", "i.*", F.col("s").alias("sub"))
    base = data.select(*ids, group, F.to_json(F.struct(F.col(group))).alias("__key"))
    return null_safe_join(base, found, ["__key", *ids], "left").select(*ids, group, F.coalesce("sub", F.lit(0)).cast("int").alias("sub"))


def smd_tiers(df: DataFrame, ids: Sequence[str], p: str = "p", y: str = "y", bins: int = 6, target: float = 0.30,
              relaxed: float = 0.20, minimum: int = 50, closest: bool = False) -> tuple[DataFrame, dict]:
    """Risk tiers whose event rates differ by a standardised difference of at least ``target``.

    Equal-frequency score bins are aggregated in Spark; merging works on those few rows: first a tier below
    ``minimum`` joins its closer neighbour, then the closest adjacent pair. ``relaxed`` is tried when ``target`` fails.
    Returns rows with ``tier`` (0 lowest rate) and what was reached. If neither target is met, the tier is null, or
    with ``closest`` the last merge is returned all the same.
    """
    binned = rank_bins(df, p, ids, bins, out="__bin")
    found = [(r["__bin"], r["n"], r["x"]) for r in binned.groupBy("__bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("x")).collect()]

    def difference(a, b):
        p1, p2 = a[2] / a[1], b[2] / b[1]
        return abs(p1 - p2) / ((((p1 * (1 - p1)) + (p2 * (1 - p2))) / 2) ** 0.5 + 1e-9)

    def merge(limit):
        # Sorting by rate is stable on the bin number, as equal rates keep their order.
        tiers = sorted((({b}, n, x) for b, n, x in sorted(found)), key=lambda t: t[2] / t[1])
        while True:
            gaps = [difference(a, b) for a, b in zip(tiers, tiers[1:], strict=False)]
            every = [difference(tiers[i], tiers[j]) for i in range(len(tiers)) for j in range(i + 1, len(tiers))]
            reached = min(every, default=float("inf")) >= limit and min(t[1] for t in tiers) >= minimum and len(tiers) > 1
            if reached or len(tiers) <= 2:
                return tiers, bool(reached), min(every, default=float("nan"))
            at = gaps.index(min(gaps))
            small = next((i for i, t in enumerate(tiers) if t[1] < minimum), None)
            if small is not None:
                left = gaps[small - 1] if small > 0 else float("inf")
                right = gaps[small] if small < len(gaps) else float("inf")
                at = small - 1 if left <= right and small > 0 else small
                at = min(at, len(tiers) - 2)
            a, b = tiers[at], tiers[at + 1]
            tiers[at:at + 2] = [(a[0] | b[0], a[1] + b[1], a[2] + b[2])]
            tiers.sort(key=lambda t: t[2] / t[1])

    used = target
    tiers, feasible, smallest = merge(target)
    if not feasible:
        used = relaxed
        tiers, feasible, smallest = merge(relaxed)
    tier_of = F.create_map(*[F.lit(v) for i, t in enumerate(tiers) for b in sorted(t[0]) for v in (b, i)])
    if not feasible and not closest:
        tier_of = F.create_map(F.lit(-1), F.lit(None).cast("int"))
    info = {"target": used, "feasible": feasible, "min_smd": smallest, "sizes": [t[1] for t in tiers],
            "rates": [t[2] / t[1] for t in tiers]}
    return binned.withColumn("tier", tier_of[F.col("__bin")]).drop("__bin"), info


def rank_clusters(df: DataFrame, cluster: str, y: str, train: str, out: str = "tier") -> DataFrame:
    """Clusters numbered by rising train event rate (no train rows: last); train and held-out rows get the number."""
    rates = df.groupBy(cluster).agg(F.avg(F.when(F.col(train) == 1, F.col(y))).alias("__r"))
    # Rates lie in [0, 1]; bands of them keep the order, so no task orders all clusters.
    band = F.coalesce(F.floor(F.col("__r") * 4096).cast("long"), F.lit(2**40))
    ranked = ordered(rates.withColumn("__none", F.col("__r").isNull()), [], ["__none", "__r", cluster], band, row_number="__n")
    return df.join(ranked.select(cluster, (F.col("__n") - 1).cast("int").alias(out)), cluster, "left")


def consensus(labels: DataFrame, ids: Sequence[str], label: str) -> DataFrame:
    """Majority label over seeds, the smaller label on ties."""
    votes = labels.groupBy(*ids, label).agg(F.count(F.lit(1)).alias("votes"))
    return top_k(votes, ids, [F.desc("votes"), F.asc(label)], 1)


def group_deviation(df: DataFrame, group: str, columns: Sequence[str], k: int = 6) -> DataFrame:
    """Features whose group mean deviates most from the cohort, in cohort standard deviations."""
    row = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns)
                   for p, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    means = df.groupBy(group).agg(*[
        F.avg((F.col(c) - row[f"a{i}"]) / (row[f"s{i}"] + 1e-8)).alias(c) for i, c in enumerate(columns)])
    long = means.unpivot([group], list(columns), "feature", "deviation")
    return top_k(long, [group], [F.desc(F.abs("deviation")), F.asc("feature")], k)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def batch_score(path: str, records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores and flags of records under a saved model."""
    scored = score(PipelineModel.load(path), records)
    return scored.withColumn("flag", (F.col("p") >= threshold).cast("int"))


def likelihood_ratio(df: DataFrame, base: Sequence[str], extra: Sequence[str], y: str = "y") -> dict[str, float]:
    """G = 2 (LL_full - LL_base) of nested unpenalised logistic models with its chi-square tail."""
    def log_likelihood(columns: Sequence[str]) -> float:
        model = train_model(df, columns, "logistic", y, weighted=False, regParam=0.0, maxIter=500, tol=1e-9)
        p = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
        ll = F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p)
        return float(score(model, df).agg(F.sum(ll)).first()[0])

    small, large = log_likelihood(base), log_likelihood([*base, *extra])
    g = 2 * (large - small)
    return {"ll_base": small, "ll_full": large, "g": g, "df": len(extra), "p": stats.chi_square_tail(g, len(extra))}


def ablate(df: DataFrame, blocks: Mapping[str, Sequence[str]], combos: Sequence[Sequence[str]], ids: Sequence[str],
           label: str = "y", k: int = 5, kind: str = "logistic", calibrate: bool = False, **parameters) -> DataFrame:
    """Both areas of each combination of feature blocks on the same folds, with the gain over the first combination."""
    total = None
    for combo in combos:
        columns = [c for b in combo for c in blocks[b]]
        part = oof_scores(df, columns, ids, label, k, kind, calibrate, **parameters).withColumn("combo", F.lit("+".join(combo)))
        total = part if total is None else total.unionByName(part)
    metrics = stats.panel(cut_lineage(total), ["combo"], label)
    first = metrics.where(F.col("combo") == "+".join(combos[0]))
    return metrics.select("combo", "auroc", "auprc", (F.col("auroc") - first.select("auroc").scalar()).alias("d_auroc"),
                          (F.col("auprc") - first.select("auprc").scalar()).alias("d_auprc"))


def pca(df: DataFrame, columns: Sequence[str], k: int = 32, keep: Sequence[str] = ()) -> DataFrame:
    """Projection on the first principal components (centred)."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="__raw"),
              StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=False),
              PCA(k=k, inputCol="features", outputCol="__pc")]
    projected = Pipeline(stages=stages).fit(df).transform(df).withColumn("__pc", vector_to_array("__pc"))
    return projected.select(*keep, *[F.col("__pc")[i].alias(f"pc_{i}") for i in range(k)])


def outcome_panel(df: DataFrame, outcomes: Sequence[str], fold: str = "fold", low: int = 10) -> DataFrame:
    """Events per outcome and fold with a warning flag for folds with few events."""
    long = df.unpivot([fold], list(outcomes), "outcome", "y")
    return long.groupBy("outcome", fold).agg(F.count("y").alias("n"), F.sum("y").alias("events")).withColumn(
        "low_count", (F.col("events") < low).cast("int"))
