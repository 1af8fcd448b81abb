"""Event sequences: positions, runs, variants, transitions, bundles, token features.

Events stay rows for as long as possible. Arrays and path strings are only built where they are the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import fixed
from casetrail.functions.clock import (boundaries, day_cycle, elapsed_bucket, floor_units, hour_of_day,
                                       seconds_between)
from casetrail.operators.ordering import DAY, null_safe_join, ordered, time_chunk, with_key_totals
from casetrail.operators.ranks import grouped_quantiles, top_k, value_band
from casetrail.operators.temporal import bounded
from casetrail.session import cut_lineage

# Shares the rows of a frequent feature are dealt into where features do not fit a broadcast.
SALTS = 64


# ---- positions and gaps ----
def sequence(events: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str], seq: str = "SeqInEncounter",
             gap: str | None = "MinutesFromPrev", chunk_seconds: int = DAY) -> DataFrame:
    """Position within the key by (time, ties) and minute boundaries since the previous event."""
    line = ordered(events, keys, [at, *tie], time_chunk(at, chunk_seconds), row_number=seq, lag={"__prev": at})
    if gap is None:
        return line.drop("__prev")
    return line.withColumn(gap, boundaries("minute", F.col("__prev"), F.col(at))).drop("__prev")


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """First and last values of each column per key by a total order (partial aggregates, no window)."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*[f(F.struct(F.col(c).alias("v")), rank)["v"].alias(f"{p}_{c}") for c in columns
                                   for p, f in (("first", F.min_by), ("last", F.max_by))])


def norm_pos_seq(events: DataFrame, keys: Sequence[str], seq: str, out: str = "norm_pos") -> DataFrame:
    """Sequence number over the largest of the key; null where that is 0."""
    joined = with_key_totals(events, keys, F.max(seq).alias("__m"))
    return joined.withColumn(out, F.col(seq) / F.nullif(F.col("__m"), F.lit(0))).drop("__m")


def norm_pos_clock(events: DataFrame, keys: Sequence[str], at: str, out: str = "norm_pos") -> DataFrame:
    """Share of the key's time span passed at the event, in 0..1; spans count at least one second."""
    joined = with_key_totals(events, keys, F.min(at).alias("__a"), F.max(at).alias("__b"))
    span = F.greatest(seconds_between(F.col("__a"), F.col("__b")), F.lit(1.0))
    share = seconds_between(F.col("__a"), F.col(at)) / span
    return joined.withColumn(out, F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("__a", "__b")


def mins_from_start(events: DataFrame, keys: Sequence[str], at: str, out: str = "mins_from_admit") -> DataFrame:
    joined = with_key_totals(events, keys, F.min(at).alias("__a"))
    return joined.withColumn(out, seconds_between(F.col("__a"), F.col(at)) / 60.0).drop("__a")


def interval_gaps(stays: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str],
                  out: str = "gap_minutes") -> DataFrame:
    """Minutes between the end of the previous stay and the start of this one; overlaps and the first count 0."""
    line = ordered(stays, keys, [start, *tie], time_chunk(start), lag={"__end": end})
    gap = F.greatest(seconds_between(F.col("__end"), F.col(start)) / 60.0, F.lit(0.0))
    return line.withColumn(out, F.coalesce(gap, F.lit(0.0))).drop("__end")


# ---- runs ----
def runs(events: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, chunk: Column,
         out: str = "run") -> DataFrame:
    """Run number per key: it grows whenever the token differs from the one before. A null always starts a new run."""
    line = ordered(events, keys, order, chunk, lag={"__prev": token})
    change = (~F.coalesce(F.col("__prev") == F.col(token), F.lit(False))).cast("int")
    marked = line.withColumn("__change", change).drop("__prev")
    return ordered(marked, keys, order, chunk, running={out: "__change"}).drop("__change")


def collapse_runs(events: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, token: str,
                  source: str | None = None, chunk_seconds: int = DAY) -> DataFrame:
    """One row per run: token, RepeatCount, RunStart, RunEnd, position and minutes since the previous run's start.

    ``order`` must start with the time column.
    """
    chunk = time_chunk(order[0], chunk_seconds)
    line = ordered(events.withColumn("__at", F.col(at)), keys, order, chunk, row_number="__pos", key_rows="__rows",
                   key_last={"__end": "__at"}, lag={"__prev": token, "__prev_at": "__at"})
    # Only the first row of each run is kept; the row before the next run's first row ends this one.
    same = F.coalesce(F.col("__prev") == F.col(token), F.lit(False))
    starts = line.where((F.col("__pos") == 1) | ~same)
    linked = ordered(starts, keys, order, chunk, row_number="__run", lag={"__prev_start": "__at"},
                     lead={"__next": "__pos", "__last_at": "__prev_at"})
    final = F.col("__next").isNull()
    return linked.select(
        *keys, token, *([source] if source else []),
        (F.when(final, F.col("__rows") + 1).otherwise(F.col("__next")) - F.col("__pos")).alias("RepeatCount"),
        F.col("__at").alias("RunStart"), F.when(final, F.col("__end")).otherwise(F.col("__last_at")).alias("RunEnd"),
        F.col("__run").alias("SeqInEncounter"),
        (seconds_between(F.col("__prev_start"), F.col("__at")) / 60.0).alias("MinutesFromPrev"))


# ---- paths ----
def sequences(events: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, out: str = "seq") -> DataFrame:
    """Ordered token array per key. The array is the result, so its length bounds what one task holds."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, F.col(token).alias("__tok"))))
    return events.groupBy(*keys).agg(F.transform(pairs, lambda x: x["__tok"]).alias(out))


def collapse(seq: Column) -> Column:
    """Array without consecutive repeats."""
    return F.filter(seq, lambda x, i: (i == 0) | ~x.eqNullSafe(seq.getItem(F.greatest(i - 1, F.lit(0)))))


def traces(collapsed: DataFrame, keys: Sequence[str], position: str, token: str, out: str = "variant") -> DataFrame:
    """Path text 'A -> B -> C' and its number of stops per key from run-collapsed rows."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(token).alias("t"))))
    return collapsed.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda x: x["t"]), " -> ").alias(out), F.count(F.lit(1)).alias("n_stops"))


def variants(paths: DataFrame, keys: Sequence[str], labels: DataFrame | None = None, label: str = "y",
             variant: str = "variant") -> DataFrame:
    """Cases, share and event rate per path; the rate counts labelled cases only."""
    rows = paths if labels is None else null_safe_join(paths, labels.select(*keys, label), keys)
    aggregates = [F.count(F.lit(1)).alias("n")]
    if labels is not None:
        aggregates += [F.count(label).alias("n_labelled"), F.avg(label).alias("rate")]
    counted = cut_lineage(rows.groupBy(variant).agg(*aggregates))
    return counted.withColumn("share", F.col("n") / counted.agg(F.sum("n")).scalar())


def directly_follows(collapsed: DataFrame, keys: Sequence[str], position: str, token: str) -> DataFrame:
    """Transition counts over run-collapsed rows (position must be 1, 2, 3, ... per key).

    A self equi-join on (key, position) finds successors without ordering a key's rows in one task.
    """
    here = collapsed.select(*keys, F.col(position).alias("__p"), F.col(token).alias("from_token"))
    there = collapsed.select(*keys, (F.col(position) - 1).alias("__p"), F.col(token).alias("to_token"))
    return here.join(there, [*keys, "__p"]).groupBy("from_token", "to_token").agg(F.count(F.lit(1)).alias("n"))


def endpoints(collapsed: DataFrame, keys: Sequence[str], position: str, token: str) -> DataFrame:
    """Start and end activity counts."""
    ends = first_last(collapsed, keys, [position], [token])
    return (ends.unpivot(list(keys), [f"first_{token}", f"last_{token}"], "__which", "token")
            .withColumn("kind", F.when(F.col("__which") == f"first_{token}", "start").otherwise("end"))
            .groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n")))


def trace_lengths(collapsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median, minimum and maximum number of stops, from the table of how often each length occurs."""
    sizes = collapsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("len"))
    cells = cut_lineage(sizes.groupBy("len").agg(F.count(F.lit(1)).alias("n")))
    middle = cells.agg(F.percentile("len", 0.5, F.col("n"))).scalar()
    total = F.sum(F.col("n"))
    return cells.agg(total.alias("n_cases"), (F.sum(F.col("len") * F.col("n")) / total).alias("mean_len"),
                     F.min("len").alias("min_len"), F.max("len").alias("max_len")).withColumn("median_len", middle)


def first_path(events: DataFrame, case: str, sub: str, position: str, token: str, start: str, end: str, a: str, b: str,
               columns: Sequence[str] = ()) -> DataFrame:
    """Earliest sub-encounter in which the first ``a`` precedes the first ``b``, with both times.

    Adds hours from arrival at ``a`` and from leaving ``a`` to arrival at ``b``.
    """
    def at_first(tok: str, column: str, name: str) -> Column:
        hit = F.col(token) == tok
        return F.min_by(F.struct(F.when(hit, F.col(column)).alias("v")), F.when(hit, F.col(position)))["v"].alias(name)

    subs = events.groupBy(case, sub).agg(
        F.min(F.when(F.col(token) == a, F.col(position))).alias("__pa"),
        F.min(F.when(F.col(token) == b, F.col(position))).alias("__pb"),
        at_first(a, start, "a_in"), at_first(a, end, "a_out"), at_first(b, start, "b_in"),
        *[at_first(a, c, f"a_{c}") for c in columns])
    valid = subs.where(F.col("__pa") < F.col("__pb"))
    best = top_k(valid, [case], [F.asc("a_in"), F.asc(sub)], 1)
    return best.select(case, sub, "a_in", "a_out", "b_in", *[f"a_{c}" for c in columns],
                       (seconds_between(F.col("a_in"), F.col("b_in")) / 3600.0).alias("hrs_arrival"),
                       (seconds_between(F.col("a_out"), F.col("b_in")) / 3600.0).alias("hrs_departure"))


def elapsed_summary(paths: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median and quartiles of an elapsed time per group."""
    means = paths.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    q = grouped_quantiles(paths, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return null_safe_join(means, q, keys)


# ---- features ----
def sequence_features(stays: DataFrame, collapsed: DataFrame, key: str, position: str, token: str,
                      units: Sequence[str] = fixed.SEQUENCE_UNITS, icu: str = "Intensive", surgery: str = "OR",
                      emergency: str = "ED", large: bool = False) -> DataFrame:
    """Long rows (key, feature, value) of one path: unit counts, stops, order tests, end unit and transition counts.

    ``large`` adds start unit, event and transition counts and the emergency-before-surgery test. The collapsed runs
    are read several times, so they are stored first.
    """
    collapsed = cut_lineage(collapsed.select(key, position, token))

    def rows(df: DataFrame, name: Column, value: Column) -> DataFrame:
        return df.select(key, name.alias("feature"), value.cast("double").alias("value"))

    counts = stays.where(F.col(token).isin(*units)).groupBy(key, token).agg(F.count(F.lit(1)).alias("__n"))
    parts = [rows(counts, F.concat(F.lit("cnt_"), F.col(token)), F.col("__n"))]

    def first_at(tok: str) -> Column:
        return F.min(F.when(F.col(token) == tok, F.col(position)))

    rank = F.col(position)
    per_case = collapsed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stops"), F.count_if(F.col(token) == surgery).alias("n_or"),
        first_at(icu).alias("__icu"), first_at(surgery).alias("__or"), first_at(emergency).alias("__ed"),
        F.max_by(token, rank).alias("__end"), F.min_by(token, rank).alias("__start"))
    flags = {"n_stops": F.col("n_stops"), "n_or_visits" if large else "n_or": F.col("n_or"),
             "has_ICU": F.col("__icu").isNotNull().cast("int"),
             "ICU_after_OR": F.coalesce(F.col("__icu") > F.col("__or"), F.lit(False)).cast("int")}
    if large:
        flags |= {"n_transitions": F.greatest(F.col("n_stops") - 1, F.lit(0)),
                  "has_ED": F.col("__ed").isNotNull().cast("int"),
                  "ED_before_OR": F.coalesce(F.col("__ed") < F.col("__or"), F.lit(False)).cast("int")}
    wide = per_case.select(key, *[v.cast("double").alias(n) for n, v in flags.items()])
    parts.append(wide.unpivot([key], list(flags), "feature", "value").where(F.col("value") != 0))
    parts.append(rows(per_case.where(F.col("__end").isNotNull()), F.concat(F.lit("end_"), F.col("__end")), F.lit(1)))
    if large:
        parts.append(rows(per_case.where(F.col("__start").isNotNull()), F.concat(F.lit("start_"), F.col("__start")),
                          F.lit(1)))
        events = stays.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        parts.append(rows(events, F.lit("n_events"), F.col("__n")))
    here = collapsed.select(key, F.col(position).alias("__p"), F.col(token).alias("__a"))
    there = collapsed.select(key, (F.col(position) - 1).alias("__p"), F.col(token).alias("__b"))
    pairs = here.join(there, [key, "__p"]).groupBy(key, "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    parts.append(rows(pairs, F.concat(F.lit("bg_"), F.col("__a"), F.lit(">"), F.col("__b")), F.col("__n")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def to_wide(features: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Feature rows as columns, absent ones 0."""
    return features.groupBy(key).pivot("feature", list(names)).agg(F.first("value")).na.fill(0.0)


def truncate_at(events: DataFrame, keys: Sequence[str], position: str, token: str, stop: str) -> DataFrame:
    """Events up to and including the first ``stop`` token; keys without it stay whole."""
    joined = with_key_totals(events, keys, F.min(F.when(F.col(token) == stop, F.col(position))).alias("__stop"))
    return joined.where(F.col("__stop").isNull() | (F.col(position) <= F.col("__stop"))).drop("__stop")


def support_filter(features: DataFrame, train: DataFrame, key: str, minimum: int = 50) -> DataFrame:
    """Keep features that at least ``minimum`` train cases show."""
    # Features are a union of parts: a semi join would be pushed into each of them, with buffers of its own in the same task.
    seen = features.where(F.col("value") > 0).join(train.select(key).distinct(), key)
    kept = seen.groupBy("feature").agg(F.count_distinct(key).alias("__n")).where(F.col("__n") >= minimum)
    # Most cases show the same few features, so rows must not meet them by feature alone: few names travel to the rows, many are repeated
    # over salts.
    names = cut_lineage(kept.select("feature"))
    if bounded(names):
        return features.join(F.broadcast(names), "feature", "left_semi")
    dealt = features.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    salted = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(salted, ["feature", "__salt"], "left_semi").drop("__salt")


# ---- bundles ----
def bundles(events: DataFrame, keys: Sequence[str], at: str, minutes: int = 2, minimum: int = 3) -> DataFrame:
    """Each event with the size of its time bucket, penalty 1/size and whether the bucket holds ``minimum`` events."""
    bucketed = events.where(F.col(at).isNotNull()).withColumn("bucket", floor_units(F.col(at), minutes * 60))
    sized = with_key_totals(bucketed, [*keys, "bucket"], F.count(F.lit(1)).alias("bundle_size"))
    return (sized.withColumn("bundle_penalty", 1.0 / F.greatest(F.col("bundle_size"), F.lit(1)))
            .withColumn("is_bundled", (F.col("bundle_size") >= minimum).cast("int")))


def bundle_fraction(events: DataFrame, keys: Sequence[str], at: str, minutes: int = 2, minimum: int = 3) -> DataFrame:
    """Share of a key's events that come in bundles: two aggregations, no join back."""
    sizes = (events.where(F.col(at).isNotNull()).groupBy(*keys, floor_units(F.col(at), minutes * 60).alias("__b"))
             .agg(F.count(F.lit(1)).alias("__n")))
    return sizes.groupBy(*keys).agg(
        (F.sum(F.when(F.col("__n") >= minimum, F.col("__n")).otherwise(0)) / F.sum("__n")).alias("bundle_frac"))


def bundle_signatures(events: DataFrame, keys: Sequence[str], at: str, token: str, minutes: int = 2,
                      minimum: int = 3) -> DataFrame:
    """Bundles with their sorted distinct tokens joined by '|'."""
    per_token = (events.where(F.col(at).isNotNull())
                 .groupBy(*keys, floor_units(F.col(at), minutes * 60).alias("bucket"), token)
                 .agg(F.count(F.lit(1)).alias("__n")))
    return (per_token.groupBy(*keys, "bucket")
            .agg(F.sum("__n").alias("bundle_size"),
                 F.array_join(F.array_sort(F.collect_list(token)), "|").alias("signature"))
            .where(F.col("bundle_size") >= minimum))


# ---- token tables ----
def vocabulary(events: DataFrame, token: str) -> DataFrame:
    """Tokens with count and index 0.. by falling frequency, ties by token (one row per distinct token)."""
    counts = (events.where(F.col(token).isNotNull()).groupBy(token).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("__neg", -F.col("n")))
    ranked = ordered(counts, [], ["__neg", token],
                     F.struct(value_band(F.col("__neg")), F.substring(token, 1, 3)), row_number="__i")
    return ranked.select(token, "n", (F.col("__i") - 1).cast("int").alias("index"))


def encode_sequences(events: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, vocab: DataFrame,
                     maxlen: int, keep: str = "last", numbers: Sequence[Column] = ()) -> DataFrame:
    """Integer arrays of fixed length per key, padded with the vocabulary size, and the length used.

    ``keep`` picks the first or last ``maxlen`` events before anything is collected. ``numbers`` are per-event doubles
    collected in the same order, padded with 0.
    """
    sort = [F.desc(c) if keep == "last" else F.asc(c) for c in order]
    kept = top_k(events, keys, sort, maxlen)
    size = vocab.agg(F.count(F.lit(1)).cast("int")).scalar()
    coded = kept.join(vocab.select(token, F.col("index").alias("__i")), token, "left").withColumn(
        "__i", F.coalesce("__i", size))
    named = [n.cast("double").alias(f"__x{i}") for i, n in enumerate(numbers)]
    rows = coded.select(*keys, F.struct(*order, "__i", *named).alias("__r"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("__r")).alias("__l"))

    def padded(field: str, fill: Column) -> Column:
        values = F.transform(F.col("__l"), lambda x: x[field])
        return F.concat(values, F.array_repeat(fill, F.lit(maxlen) - F.size("__l")))

    return listed.select(*keys, padded("__i", size).alias("tokens"),
                         *[padded(f"__x{i}", F.lit(0.0)).alias(f"num_{i}") for i in range(len(named))],
                         F.greatest(F.size("__l"), F.lit(1)).alias("length"))


def step_numbers(repeat: Column, gap_minutes: Column, at: Column, position: Column, maxlen: int) -> list[Column]:
    """Per-step numbers of an encoded order run: log repeats, log gap, position share, sine and cosine of the hour."""
    sine, cosine = day_cycle(F.coalesce(hour_of_day(at), F.lit(0.0)))
    positive = [F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))) for c in (repeat, gap_minutes)]
    return [*positive, position / F.lit(float(maxlen)), sine, cosine]


def time_tokens(events: DataFrame, keys: Sequence[str], at: str, out: str = "time_id") -> DataFrame:
    """Elapsed-time bucket 1..6 of each event since the first event of its key."""
    return mins_from_start(events, keys, at, "__m").withColumn(out, elapsed_bucket(F.col("__m"))).drop("__m")


def temporal_edges(events: DataFrame, key: str, token: str, position: Column, k: int = 30,
                   penalty: Column | None = None) -> DataFrame:
    """Key-token edges weighted by mean position (times mean bundle penalty), the ``k`` most frequent tokens per key."""
    rows = events.withColumn("__pos", position).where(F.col("__pos").isNotNull())
    rows = rows.withColumn("__pen", F.lit(1.0) if penalty is None else penalty)
    grouped = rows.groupBy(key, token).agg(F.count(F.lit(1)).alias("n"), F.avg("__pos").alias("mean_pos"),
                                           F.avg("__pen").alias("mean_penalty"))
    kept = top_k(grouped, [key], [F.desc("n"), F.asc(token)], k)
    return kept.withColumn("weight", F.col("mean_pos") * F.col("mean_penalty"))


def token_lift(tokens: DataFrame, groups: DataFrame, key: str, token: str, group: str, minimum: int = 50,
               k: int = 5) -> DataFrame:
    """Tokens over-represented in a group: share of its cases that show the token over the share in the cohort."""
    present = tokens.select(key, token).distinct()
    cohort = groups.agg(F.count_distinct(key)).scalar()
    sizes = groups.groupBy(group).agg(F.count_distinct(key).alias("__size"))
    member = present.join(groups.select(key, group), key)
    overall = member.groupBy(token).agg(F.count_distinct(key).alias("__all"))
    within = member.groupBy(group, token).agg(F.count_distinct(key).alias("n")).where(F.col("n") >= minimum)
    joined = within.join(sizes, group).join(overall, token)
    lift = (F.col("n") / F.col("__size")) / (F.col("__all") / cohort)
    scored = joined.select(group, token, "n", (F.col("n") / F.col("__size")).alias("share"), lift.alias("lift"))
    return top_k(scored, [group], [F.desc("lift"), F.asc(token)], k)


def prevalence(tokens: DataFrame, groups: DataFrame, key: str, token: str, group: str, k: int = 8) -> DataFrame:
    """Share of a group's cases (those with any token) that show the token, top ``k`` per group."""
    member = tokens.select(key, token).distinct().join(groups.select(key, group), key)
    sizes = member.groupBy(group).agg(F.count_distinct(key).alias("__size"))
    counts = member.groupBy(group, token).agg(F.count_distinct(key).alias("n"))
    scored = counts.join(sizes, group).withColumn("share", F.col("n") / F.greatest(F.col("__size"), F.lit(1)))
    return top_k(scored.drop("__size"), [group], [F.desc("share"), F.asc(token)], k)


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p-value by the complementary error function of Abramowitz and Stegun 7.1.26 (error < 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def two_proportions(df: DataFrame, flag: str, y: str, strata: Sequence[str] = ()) -> DataFrame:
    """Rates with and without the flag, risk ratio, two-proportion z and p, per stratum; 0-row groups drop out."""
    on = F.col(flag) == 1
    counted = df.groupBy(*strata).agg(
        F.count_if(on).alias("n1"), F.sum(F.when(on, F.col(y)).otherwise(0)).alias("x1"),
        F.count_if(~on).alias("n0"), F.sum(F.when(~on, F.col(y)).otherwise(0)).alias("x0"))
    rows = counted.where((F.col("n1") > 0) & (F.col("n0") > 0))
    p1, p0 = F.col("x1") / F.col("n1"), F.col("x0") / F.col("n0")
    pooled = (F.col("x1") + F.col("x0")) / (F.col("n1") + F.col("n0"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n0")))
    z = F.try_divide(p1 - p0, se)
    return rows.select(*strata, "n1", "x1", "n0", "x0", p1.alias("rate1"), p0.alias("rate0"),
                       F.try_divide(p1, p0).alias("risk_ratio"), z.alias("z"), normal_two_sided(z).alias("p_value"))


def care_structure(stays: DataFrame, key: str, unit_type: str = "UnitType", categories: Mapping[str, str] | None = None,
                   institution: str = "InstitutionType") -> DataFrame:
    """Flags per case: any emergency stay, surgery only, number of unit types, each institution category touched."""
    touched = [F.max(F.coalesce(F.col(institution) == value, F.lit(False)).cast("int")).alias(name)
               for name, value in (categories or {}).items()]
    only = F.count_distinct(unit_type)
    return stays.groupBy(key).agg(
        F.max((F.col(unit_type) == "ED").cast("int")).alias("has_ED"),
        F.min((F.col(unit_type) == "OR").cast("int")).alias("OR_only"), only.alias("n_units"), *touched)
