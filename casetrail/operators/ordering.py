"""Ordered operators that survive a hot key.

A plain ``Window.partitionBy(key)`` puts all rows of one key in one task. Here the rows of a key are first cut into
chunks that respect the order (usually a stretch of time). The window runs inside ``(key, chunk)``; one summary row per
chunk carries what a chunk owes its neighbours (row counts, running sums, first and last rows), and the window over the
keys only sees those summaries. The result equals the plain window row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.clock import floor_units

DAY = 86400


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on same-named keys where null equals null; the keys of the left side are kept."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys],
                           *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        test = left[f"`{k}`"].eqNullSafe(renamed[f"`__r_{k}`"])
        condition = test if condition is None else condition & test
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def time_chunk(ts: str | Column, every: int = DAY) -> Column:
    """Chunk number of a timestamp; rows without one share the chunk that sorts first."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(floor_units(column, every), F.lit(-(2 ** 62)))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    row_number: str | None = None,
    key_rows: str | None = None,
    key_last: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    running: Mapping[str, str] | None = None,
    carry: Mapping[str, str] | None = None,
    carry_back: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    ``row_number`` names a 1-based position, ``key_rows`` the row count of the key and ``key_last`` maps an output name
    to the column read from the key's last row; ``lag`` / ``lead`` map output name to
    the column read from the previous / next row; ``running`` sums a column up to and including the row; ``carry`` is
    the last non-null value so far and ``carry_back`` the next non-null value from the row on.

    ``order`` must be a total order within the key and ``chunk`` must be non-null and never decrease along it.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    running, carry, carry_back = dict(running or {}), dict(carry or {}), dict(carry_back or {})
    key_last = dict(key_last or {})
    keys, order = list(keys), list(order)
    base = df.withColumn("__o_chunk", chunk)
    inner = Window.partitionBy(*keys, "__o_chunk").orderBy(*order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    from_here = inner.rowsBetween(0, Window.unboundedFollowing)
    rank = F.struct(*[F.col(c) for c in order])

    local, summary = [F.row_number().over(inner).cast("long").alias("__o_pos")], [F.count(F.lit(1)).alias("__o_n")]
    for out, c in lag.items():
        local.append(F.lag(F.struct(c)).over(inner).alias(f"__lag_{out}"))
        summary.append(F.max_by(F.struct(F.col(c).alias("v")), rank).alias(f"__last_{out}"))
    for out, c in lead.items():
        local.append(F.lead(F.struct(c)).over(inner).alias(f"__lead_{out}"))
        summary.append(F.min_by(F.struct(F.col(c).alias("v")), rank).alias(f"__first_{out}"))
    for out, c in key_last.items():
        summary.append(F.max_by(F.struct(F.col(c).alias("v")), rank).alias(f"__end_{out}"))
    for out, c in running.items():
        local.append(F.sum(c).over(so_far).alias(f"__run_{out}"))
        summary.append(F.sum(c).alias(f"__sum_{out}"))
    for out, c in carry.items():
        local.append(F.last(c, ignorenulls=True).over(so_far).alias(f"__car_{out}"))
        summary.append(F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"__carl_{out}"))
    for out, c in carry_back.items():
        local.append(F.first(c, ignorenulls=True).over(from_here).alias(f"__bck_{out}"))
        summary.append(F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"__bckf_{out}"))

    inside = base.select("*", *local)
    per_chunk = base.groupBy(*keys, "__o_chunk").agg(*summary)
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("__o_chunk")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = across.rowsBetween(1, Window.unboundedFollowing)
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = [F.coalesce(F.sum("__o_n").over(before), F.lit(0)).alias("__o_off"),
               F.sum("__o_n").over(whole).alias("__o_total"), F.col("__o_n").alias("__o_rows")]
    for out in lag:
        offsets.append(F.lag(f"__last_{out}").over(across).alias(f"__plag_{out}"))
    for out in lead:
        offsets.append(F.lead(f"__first_{out}").over(across).alias(f"__nlead_{out}"))
    for out in key_last:
        offsets.append(F.last(f"__end_{out}").over(whole).alias(f"__klast_{out}"))
    for out in running:
        offsets.append(F.sum(f"__sum_{out}").over(before).alias(f"__poff_{out}"))
    for out in carry:
        offsets.append(F.last(f"__carl_{out}", ignorenulls=True).over(before).alias(f"__pcar_{out}"))
    for out in carry_back:
        offsets.append(F.first(f"__bckf_{out}", ignorenulls=True).over(after).alias(f"__nbck_{out}"))
    joined = null_safe_join(inside, per_chunk.select(*keys, "__o_chunk", *offsets), [*keys, "__o_chunk"], "inner")

    first_row, last_row = F.col("__o_pos") == 1, F.col("__o_pos") == F.col("__o_rows")
    result = [F.col(f"`{c}`") for c in df.columns]
    if row_number:
        result.append((F.col("__o_pos") + F.col("__o_off")).alias(row_number))
    if key_rows:
        result.append(F.col("__o_total").alias(key_rows))
    for out, c in lag.items():
        result.append(F.when(first_row, F.col(f"__plag_{out}")["v"])
                      .otherwise(F.col(f"__lag_{out}")[c]).alias(out))
    for out, c in lead.items():
        result.append(F.when(last_row, F.col(f"__nlead_{out}")["v"])
                      .otherwise(F.col(f"__lead_{out}")[c]).alias(out))
    for out in key_last:
        result.append(F.col(f"__klast_{out}")["v"].alias(out))
    for out in running:
        total = F.coalesce(F.col(f"__run_{out}"), F.lit(0)) + F.coalesce(F.col(f"__poff_{out}"), F.lit(0))
        known = F.col(f"__run_{out}").isNotNull() | F.col(f"__poff_{out}").isNotNull()
        result.append(F.when(known, total).alias(out))
    for out in carry:
        result.append(F.coalesce(f"__car_{out}", f"__pcar_{out}").alias(out))
    for out in carry_back:
        result.append(F.coalesce(f"__bck_{out}", f"__nbck_{out}").alias(out))
    return joined.select(*result)


def with_key_totals(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Partition totals without collapsing: partial aggregates first, then a join (a hot key never sits in one window)."""
    return null_safe_join(df, df.groupBy(*keys).agg(*aggregates), keys, "left")
