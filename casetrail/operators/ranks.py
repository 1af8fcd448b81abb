"""Exact ranks, cumulative sums and quantiles over values, without a single-task sort.

Rows are first aggregated to distinct values. Each value then falls in a band, a coarse order-preserving number, so
that windows run per band and only the small table of band totals is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.operators.ordering import null_safe_join

BANDS_PER_BINADE = 4096


def value_band(value: Column) -> Column:
    """Order-preserving band of a double: 4096 bands for every power of two, mirrored for negatives."""
    value = value.cast("double")
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * BANDS_PER_BINADE)
    # 1074 lifts the smallest exponent of a double above zero, so that the sign alone mirrors the order.
    magnitude = (exponent + 1075) * BANDS_PER_BINADE + inside
    return (F.when(size == 0, F.lit(0)).when(value > 0, magnitude).otherwise(-magnitude)).cast("long")


def cumulative(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column],
               descending: bool = False) -> DataFrame:
    """One row per key and distinct value with each measure, its sum strictly before the value and its key total.

    For a measure ``m`` the columns are ``m``, ``m_before`` and ``m_total``. Rows with a null value are left out.
    """
    keys = list(keys)
    cells = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
             .agg(*[expression.alias(name) for name, expression in measures.items()])
             .withColumn("__rk_band", value_band(F.col(value))))
    sort = F.desc if descending else F.asc
    by_band = Window.partitionBy(*keys, "__rk_band").orderBy(sort(value)).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    inside = cells.select("*", *[F.coalesce(F.sum(m).over(by_band), zero).alias(f"__in_{m}") for m in measures])
    totals = cells.groupBy(*keys, "__rk_band").agg(*[F.sum(m).alias(m) for m in measures])
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(sort("__rk_band"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(*keys, "__rk_band",
                            *[F.coalesce(F.sum(m).over(before), zero).alias(f"__off_{m}") for m in measures],
                            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures])
    joined = null_safe_join(inside, offsets, [*keys, "__rk_band"], "inner")
    return joined.select(*keys, value, *measures,
                         *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(f"{m}_before") for m in measures],
                         *[f"{m}_total" for m in measures])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                      count_as: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key (the continuous percentile), spread over value bands."""
    keys = list(keys)
    cells = cumulative(df, keys, value, {"__c": F.count(F.lit(1))})
    number = F.col(value).cast("double")
    start, stop = F.col("__c_before"), F.col("__c_before") + F.col("__c")
    picks, final = [], []
    for name, p in probs.items():
        position = (F.col("__c_total") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        picks += [F.max(F.when((start <= low) & (low < stop), number)).alias(f"__lo_{name}"),
                  F.max(F.when((start <= high) & (high < stop), number)).alias(f"__hi_{name}")]
        after = (F.col("__t") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        final.append((lo + (hi - lo) * (after - F.floor(after))).alias(name))
    if count_as:
        final.append(F.col("__t").alias(count_as))
    return cells.groupBy(*keys).agg(F.max("__c_total").alias("__t"), *picks).select(*keys, *final)


def hashed_order(seed: int | str, *ids: str) -> Column:
    """Repeatable pseudo-random sort key: the md5 of seed and ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hashed_rank(df: DataFrame, strata: Sequence[str], ids: Sequence[str], seed: int | str = 42,
                rank_as: str = "rank", total_as: str | None = None) -> DataFrame:
    """Rank 1..n inside each stratum in md5 order.

    The first hex digits of the hash split every stratum into evenly sized bands, so one stratum may hold most rows.
    """
    strata = list(strata)
    # The digest's bytes have the order of its hex digits and half their length.
    hashed = df.withColumn("__hr_h", F.unhex(hashed_order(seed, *ids))).withColumn("__rk_band", F.substring(F.hex("__hr_h"), 1, 3))
    inside = hashed.withColumn(
        "__hr_pos", F.row_number().over(Window.partitionBy(*strata, "__rk_band").orderBy("__hr_h", *ids)).cast("long"))
    across = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(1))).orderBy("__rk_band")
    sizes = hashed.groupBy(*strata, "__rk_band").agg(F.count(F.lit(1)).alias("__hr_n"))
    offsets = sizes.select(
        *strata, "__rk_band",
        F.coalesce(F.sum("__hr_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__hr_off"),
        F.sum("__hr_n").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__hr_tot"))
    joined = null_safe_join(inside, offsets, [*strata, "__rk_band"], "inner")
    columns = [F.col(f"`{c}`") for c in df.columns] + [(F.col("__hr_pos") + F.col("__hr_off")).alias(rank_as)]
    if total_as:
        columns.append(F.col("__hr_tot").alias(total_as))
    return joined.select(*columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_as: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark keeps only ``k`` rows per key and map task before the shuffle."""
    name = rank_as or "__rank"
    if keys:
        window = Window.partitionBy(*keys).orderBy(*order)
    else:
        df, window = df.orderBy(*order).limit(k), Window.orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return kept if rank_as else kept.drop(name)
