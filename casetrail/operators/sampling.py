"""Repeatable sampling, splits, folds and vocabularies. All randomness is an md5 order, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.operators.ordering import null_safe_join
from casetrail.operators.ranks import cumulative, grouped_quantiles, hashed_rank, top_k
from casetrail.operators.temporal import bounded


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent values; ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def stratified_sample(df: DataFrame, stratum: str, ids: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per stratum in hash order."""
    ranked = hashed_rank(df, [stratum], ids, seed, "__rank")
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def stratified_split(df: DataFrame, label: str, ids: Sequence[str], fractions: tuple[float, float] = (0.8, 0.1),
                     seed: int = 42, out: str = "split") -> DataFrame:
    """train / val / test, cut inside each class at the rounded fractions."""
    ranked = hashed_rank(df, [label], ids, seed, "__rank", "__n")
    train = F.bround(F.lit(fractions[0]) * F.col("__n"))
    val = F.bround(F.lit(fractions[1]) * F.col("__n"))
    part = (F.when(F.col("__rank") <= train, "train").when(F.col("__rank") <= train + val, "val").otherwise("test"))
    return ranked.withColumn(out, part).drop("__rank", "__n")


def kfold(df: DataFrame, label: str, ids: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Stratified folds 0..k-1 dealt round robin in hash order."""
    ranked = hashed_rank(df, [label], ids, seed, "__rank")
    return ranked.withColumn(out, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def rebalance(df: DataFrame, label: str, ids: Sequence[str], mode: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Class balancing of a 0/1 label.

    ``undersample`` cuts the larger class to the smaller; ``oversample`` repeats the smaller class up to ``ratio``
    times the larger (whole repeats, then the first rows in hash order). Adds ``copy``, 0 for an original row.
    """
    if mode == "none":
        return df.withColumn("copy", F.lit(0))
    ranked = hashed_rank(df, [label], ids, seed, "__rank", "__n")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    smallest, largest = (sizes.agg(f("__c")).scalar() for f in (F.min, F.max))
    if mode == "undersample":
        return ranked.where(F.col("__rank") <= smallest).withColumn("copy", F.lit(0)).drop("__rank", "__n")
    if mode == "oversample":
        wanted = F.greatest(F.floor(F.lit(ratio) * largest), F.col("__n"))
        whole, rest = F.floor(wanted / F.col("__n")), F.pmod(wanted, F.col("__n"))
        copies = whole + (F.col("__rank") <= rest).cast("long")
        return (ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
                .drop("__rank", "__n"))
    raise ValueError(f"unknown mode {mode!r}")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * n_class) per row, for ``weightCol``.

    The few classes meet many rows where they are: a shuffle by class would put all rows in as many tasks as there are classes.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    sizes = df.groupBy(label).agg((total / (F.lit(2.0) * F.greatest(F.count(F.lit(1)), F.lit(1)))).alias(out))
    return null_safe_join(df, sizes if bounded(df) or not bounded(sizes) else F.broadcast(sizes), [label])


def topk_vocab(train: DataFrame, df: DataFrame, column: str, k: int, out: str = "index") -> DataFrame:
    """Index 0..k-1 of the train set's most frequent values, ``k`` for all others."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    vocabulary = top_k(counts, [], [F.desc("__n"), F.asc(column)], k, "__i").select(
        column, (F.col("__i") - 1).cast("int").alias("__i"))
    joined = df.join(F.broadcast(vocabulary) if k <= 100_000 else vocabulary, column, "left")
    return joined.withColumn(out, F.coalesce("__i", F.lit(k))).drop("__i")


def quantile_bins(df: DataFrame, value: str, n: int, out: str = "bin") -> DataFrame:
    """Bins 0..n-1 by quantile edges (right-closed, lowest included, repeated edges merged)."""
    names = {f"q{i}": i / n for i in range(n + 1)}
    found = grouped_quantiles(df, [], value, names).select(F.struct(*names).alias("e")).scalar()
    edges = [found[f"q{i}"] for i in range(n + 1)]
    passed = sum(((edges[i] > edges[i - 1]) & (edges[i] > edges[0]) & (edges[i] < edges[n]) & (edges[i] < F.col(value))
                  ).cast("int") for i in range(1, n))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.lit(0) + passed))


def rank_bins(df: DataFrame, value: str, ids: Sequence[str], n: int, seed: int = 42, out: str = "bin") -> DataFrame:
    """Equal-frequency bins of ranks, ties in hash order, cut where ``n`` even steps over the row count are truncated.

    The rank is the count of smaller values plus the rank among equal ones, so one value may hold most rows.
    """
    known = df.where(F.col(value).isNotNull())
    below = cumulative(known, [], value, {"__c": F.count(F.lit(1))}).select(value, "__c_before", "__c_total")
    ranked = null_safe_join(hashed_rank(known, [value], ids, seed, "__tie"), below, [value], "inner")
    bin_number = F.floor(((F.col("__c_before") + F.col("__tie")) * n - 1) / F.col("__c_total")).cast("int")
    return ranked.withColumn(out, F.least(bin_number, F.lit(n - 1))).drop("__tie", "__c_before", "__c_total")


def take_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, last: bool = False) -> DataFrame:
    """First or last ``n`` rows per key."""
    sort = [F.desc(c) if last else F.asc(c) for c in order]
    return top_k(df, keys, sort, n)


