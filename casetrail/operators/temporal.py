"""Joins along time: containment, look-back, look-ahead, as-of and versioned dimensions.

Range predicates alone would make Spark join on the entity key and test the range on every pair of that key. All joins
here add a time bucket to the key, so the pairs formed stay close to the pairs kept, also for an entity that owns a
large part of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.clock import boundaries, floor_units, micros, seconds_between, shift
from casetrail.operators.ordering import DAY, ordered, time_chunk


def bounded(df: DataFrame, max_rows: int = 100_000) -> bool:
    """Whether a side is small enough to broadcast; looks at no more than ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint behind a size check; a larger side is left to a shuffled join."""
    return F.broadcast(df) if bounded(df, max_rows) else df


def interval_join(intervals: DataFrame, points: DataFrame, keys: Sequence[str], low: str, high: str, at: str,
                  bucket_seconds: int = DAY, row_id: str | None = None) -> DataFrame:
    """Each interval row with the point rows of the same key where ``low <= at <= high``.

    Intervals are repeated once per bucket they touch and points fall in one bucket, so every match is found once.
    Choose a bucket near the usual interval length. ``row_id`` names a unique column of the intervals and keeps the
    unmatched ones (left join). Key columns of the intervals are kept; other column names must differ.
    """
    keys = list(keys)
    spread = (intervals.where(F.col(low) <= F.col(high))
              .withColumn("__bucket", F.explode(F.sequence(floor_units(F.col(low), bucket_seconds),
                                                           floor_units(F.col(high), bucket_seconds)))))
    located = points.where(F.col(at).isNotNull()).withColumn("__bucket", floor_units(F.col(at), bucket_seconds))
    found = (spread.join(located, [*keys, "__bucket"], "inner")
             .where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__bucket"))
    if row_id is None:
        return found
    missing = intervals.join(found.select(row_id).distinct(), row_id, "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def lookback(cases: DataFrame, events: DataFrame, keys: Sequence[str], anchor: str, at: str, amount: int, unit: str,
             include_start: bool = True, include_anchor: bool = False) -> DataFrame:
    """Events of the same key in the ``amount unit`` before each case's anchor (pairs)."""
    width = {"hour": 3600, "day": DAY, "month": 31 * DAY, "year": 366 * DAY}[unit] * amount
    framed = cases.withColumn("__from", shift(F.col(anchor), unit, -amount))
    pairs = interval_join(framed, events, keys, "__from", anchor, at, bucket_seconds=width)
    if not include_start:
        pairs = pairs.where(F.col(at) > F.col("__from"))
    if not include_anchor:
        pairs = pairs.where(F.col(at) < F.col(anchor))
    return pairs.drop("__from")


def window_counts(cases: DataFrame, case_id: str, events: DataFrame, keys: Sequence[str], low: Column, high: Column,
                  at: str, measures: Mapping[str, Column], low_open: bool = False, high_open: bool = True,
                  chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Per case, sums of event measures over the window ``[low, high)`` (bounds as flagged), without forming pairs.

    Events and the two ends of every window are merged into one time line per key. The running total at the high end
    minus the one at the low end is the answer, so cost grows with cases plus events even if one key owns most of both.
    Measures must be additive (counts of matching events, sums).
    """
    keys, names = list(keys), list(measures)
    line = events.where(F.col(at).isNotNull()).select(
        *keys, micros(F.col(at)).alias("__t"), F.lit(1).alias("__kind"),
        F.lit(None).cast(cases.schema[case_id].dataType).alias("__id"), F.lit(None).cast("string").alias("__end"),
        *[F.coalesce(m.cast("double"), F.lit(0.0)).alias(n) for n, m in measures.items()])
    # kind 0 sorts before the events of the same instant, kind 2 after them.
    low_kind, high_kind = (2 if low_open else 0), (0 if high_open else 2)
    ends = None
    for name, bound, kind in (("low", low, low_kind), ("high", high, high_kind)):
        part = cases.select(*keys, micros(bound).alias("__t"), F.lit(kind).alias("__kind"),
                            F.col(case_id).alias("__id"), F.lit(name).alias("__end"), *[F.lit(0.0).alias(n) for n in names])
        ends = part if ends is None else ends.unionByName(part)
    merged = line.unionByName(ends)
    chunk = F.coalesce(floor_units(F.timestamp_micros(F.col("__t")), chunk_seconds), F.lit(-(2 ** 62)))
    # Rows that tie on time and kind may come in any order: only the totals at the ends are read.
    running = ordered(merged, keys, ["__t", "__kind"], chunk, running={f"__r_{n}": n for n in names})
    by_case = running.where(F.col("__end").isNotNull()).groupBy("__id").agg(*[
        (F.max(F.when(F.col("__end") == "high", F.col(f"__r_{n}")))
         - F.max(F.when(F.col("__end") == "low", F.col(f"__r_{n}")))).alias(n) for n in names])
    totals = by_case.withColumnRenamed("__id", case_id)
    return cases.join(totals, case_id, "left").na.fill(0.0, names)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
         columns: Sequence[str], direction: str = "backward", strict: bool = False,
         chunk_seconds: int = 30 * DAY) -> DataFrame:
    """Left rows with ``columns`` of the last right row at or before (``forward``: the first at or after) their time.

    The right side needs one row per key and time, or its ties resolve by the largest column values.
    """
    keys, columns, backward = list(keys), list(columns), direction == "backward"
    payload = F.struct(F.col(right_at).alias("__at"), *[F.col(c) for c in columns])
    types = right.select(payload.alias("p")).schema["p"].dataType.simpleString()
    # At equal times the right row must come first for a backward match and last for a forward one, unless strict.
    right_kind = (2 if strict else 0) if backward else (0 if strict else 2)
    points = left.withColumn("__t", F.col(left_at)).withColumn("__kind", F.lit(1)) \
        .withColumn("__p", F.lit(None).cast(types))
    states = right.where(F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).alias("__t"), F.lit(right_kind).alias("__kind"), payload.alias("__p"))
    merged = points.unionByName(states, allowMissingColumns=True)
    order = ["__t", "__kind", "__p"]
    named = {"__match": "__p"}
    line = ordered(merged, keys, order, time_chunk("__t", chunk_seconds),
                   carry=named if backward else None, carry_back=None if backward else named)
    matched = line.where(F.col("__kind") == 1).select(
        *[F.col(f"`{c}`") for c in left.columns], F.col("__match")["__at"].alias(f"{right_at}_matched"),
        *[F.col("__match")[c].alias(c) for c in columns])
    return matched


def covering_anchor(spans: DataFrame, anchors: DataFrame, keys: Sequence[str], start: str, end: str,
                    anchor: str) -> DataFrame:
    """Spans ``[start, end]`` that contain at least one anchor of their key (semi join).

    Only the first anchor from the start on can be the nearest one, so every span is matched once, as of.
    """
    points = anchors.select(*keys, F.col(anchor).alias("__an")).distinct().withColumn("__hit", F.col("__an"))
    found = asof(spans, points, keys, start, "__an", ["__hit"], "forward")
    return found.where(F.col("__hit") <= F.col(end)).select(*spans.columns)


def scd2_join(facts: DataFrame, dim: DataFrame, key: str, at: str, start: str, end: str,
              columns: Sequence[str], max_broadcast_rows: int = 100_000) -> DataFrame:
    """Left join of facts with every dimension version valid at ``at``: ``start <= at < end``.

    Versions may overlap, then a fact appears once per version that holds its time. Both sides meet on the key; the
    size of the dimension only decides whether it is broadcast, never the result.
    """
    versions = dim.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"), *columns)
    valid = ((F.col(key) == F.col("__k")) & (F.col("__s") <= F.col(at)) & (F.col(at) < F.col("__e")))
    if bounded(dim, max_broadcast_rows):
        versions = F.broadcast(versions)
    return facts.join(versions, valid, "left").drop("__k", "__s", "__e")


def scd2_current(dim: DataFrame, end: str, open_end: str = "2050-01-01") -> DataFrame:
    """Versions still open."""
    return dim.where(F.to_date(F.col(end)) == F.to_date(F.lit(open_end)))


def same_day_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
                  how: str = "inner") -> DataFrame:
    """Join on key and calendar day."""
    a = left.withColumn("__day", F.to_date(left_at))
    b = right.withColumn("__day", F.to_date(right_at))
    return a.join(b, [*keys, "__day"], how).drop("__day")


def asof_containing(events: DataFrame, stays: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
                    columns: Sequence[str]) -> DataFrame:
    """Events with the latest stay begun at or before them, kept only when that stay has not ended yet."""
    found = asof(events, stays.where(F.col(start).isNotNull() & F.col(end).isNotNull()), keys, at, start,
                 [*columns, end])
    return found.where(F.col(at) <= F.col(end))


def to_intervals(events: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], is_anchor: Column | None = None,
                 chunk_seconds: int = DAY) -> DataFrame:
    """Stays from change events: each lasts until the next event of the key.

    Adds InTime, OutTime, Hours (minute boundaries / 60) and SeqInEncounter. Anchor rows (a discharge) close the stay
    before them and are then left out.
    """
    line = ordered(events.withColumn("InTime", F.col(at)), keys, order, time_chunk(at, chunk_seconds),
                   row_number="SeqInEncounter", lead={"OutTime": "InTime"})
    stays = line.withColumn("Hours", boundaries("minute", F.col("InTime"), F.col("OutTime")) / F.lit(60.0))
    return stays if is_anchor is None else stays.where(~is_anchor)


def before_anchor(events: DataFrame, anchors: DataFrame, key: str, at: str, anchor: str) -> DataFrame:
    """Events strictly before their case's anchor; cases without an anchor drop out."""
    return events.join(anchors.select(key, anchor), key, "inner").where(F.col(at) < F.col(anchor))


def preop_trajectory(stays: DataFrame, anchors: DataFrame, key: str, anchor: str,
                     ward_types: Sequence[str] = ("Acute", "Intensive", "Intermediate"),
                     unit_type: str = "UnitType", start: str = "InTime", end: str = "OutTime",
                     department: str = "DepartmentID") -> DataFrame:
    """Hours per ward type before the anchor (a straddling stay is clipped), visits and distinct departments."""
    spine = anchors.select(key, anchor).dropDuplicates([key])
    wards = (stays.join(spine, key, "inner").where(F.col(start) < F.col(anchor))
             .where(F.col(unit_type).isin(*ward_types)))
    clipped = F.greatest(seconds_between(F.col(start), F.least(F.col(end), F.col(anchor))) / 3600.0, F.lit(0.0))
    wards = wards.withColumn("__hours", clipped)
    names = {w: f"preop_los_{w.lower()}_hr" for w in ward_types}
    block = wards.groupBy(key).agg(
        *[F.sum(F.when(F.col(unit_type) == w, F.col("__hours"))).alias(n) for w, n in names.items()],
        F.count(F.lit(1)).alias("preop_transfer_count"), F.count_distinct(department).alias("preop_n_units"))
    zeros = {n: 0.0 for n in names.values()} | {"preop_transfer_count": 0, "preop_n_units": 0}
    return spine.select(key).join(block, key, "left").na.fill(zeros)


