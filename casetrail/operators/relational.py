"""Joins, set operations and pivots that assemble case tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions.clock import seconds_between, shift
from casetrail.functions.scalars import normalize_id, number, yn
from casetrail.operators.ordering import null_safe_join, with_key_totals
from casetrail.operators.predicates import classify_provider
from casetrail.operators.ranks import grouped_quantiles, top_k
from casetrail.operators.temporal import broadcast_if_bounded, interval_join
from casetrail.session import in_parts


# ---- joins ----
def assemble(cases: DataFrame, key: str, *blocks: DataFrame) -> DataFrame:
    """Left join feature blocks (each one row per key) onto the case table."""
    for block in blocks:
        cases = cases.join(block, key, "left")
    return cases


def assemble_frame(encounters: DataFrame, features: DataFrame, labels: DataFrame, key: str = "LogID",
                   label: str = "ReadmittedWithin30Days") -> DataFrame:
    """Inner join of cases, features and label; feature columns that the cases already have are dropped first."""
    repeated = [c for c in features.columns if c != key and (c in encounters.columns or c == label)]
    return encounters.join(features.drop(*repeated), key).join(labels.select(key, label), key)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, only left, only right."""
    left = a.select(key).distinct().withColumn("__a", F.lit(1))
    right = b.select(key).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, key, "full")
    in_a, in_b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(F.count_if(in_a & in_b).alias("in_both"), F.count_if(in_a & ~in_b).alias("left_only"),
                    F.count_if(~in_a & in_b).alias("right_only"))


def restrict_to(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def first_match(df: DataFrame, dim: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Left join with one dimension row per key, the first in the given total order."""
    return df.join(top_k(dim, [key], order, 1).select(key, *columns), key, "left")


def episode_window(cases: DataFrame, adt: DataFrame, key: str, at: str = "EFFECTIVE_TIME",
                   event: str = "EVENT_TYPE_C", subtype: str = "EVENT_SUBTYPE_C",
                   first_as: str = "EpiStart", last_as: str = "EpiEnd") -> DataFrame:
    """Cases with first event and last discharge of their encounter; cases without a discharge drop out."""
    kept = adt.where(F.col(subtype).isNull() | (F.col(subtype) != 2))
    span = kept.groupBy(key).agg(F.min(at).alias(first_as), F.max(F.when(F.col(event) == 2, F.col(at))).alias(last_as))
    return cases.join(span.where(F.col(last_as).isNotNull() & F.col(first_as).isNotNull()), key)


def milestone_pair(cases: DataFrame, times: DataFrame, key: str, event: str, at: str, start: int | str,
                   stop: int | str, start_as: str = "StartTime", stop_as: str = "StopTime") -> DataFrame:
    """Start and stop milestones side by side; a repeated milestone repeats the case."""
    a = times.where(F.col(event) == start).select(key, F.col(at).alias(start_as))
    b = times.where(F.col(event) == stop).select(key, F.col(at).alias(stop_as))
    return cases.join(a, key, "left").join(b, key, "left")


def merge_closure(ids: DataFrame, edges: DataFrame, source: str, target: str, id_column: str, hops: int = 2) -> DataFrame:
    """All ids reached over merge links, forward (merged into) and backward (merged from), each with its direction."""
    links = edges.where(F.col(target).isNotNull()).select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    start = ids.select(id_column, F.col(id_column).alias("RelatedID")).distinct()
    found = start.withColumn("MergeDir", F.lit("direct"))
    for direction, here, there in (("forward", "__s", "__t"), ("backward", "__t", "__s")):
        reached = start
        for hop in range(1, hops + 1):
            reached = (reached.join(links, F.col("RelatedID") == F.col(here))
                       .select(id_column, F.col(there).alias("RelatedID")).distinct())
            tag = direction if hop == 1 else f"{direction}-{hop}hop"
            found = found.unionByName(reached.withColumn("MergeDir", F.lit(tag)))
    return found.distinct()


def link_records(a: DataFrame, b: DataFrame, keys: Sequence[str], order_a: Sequence[Column],
                 order_b: Sequence[Column]) -> DataFrame:
    """Inner join of two systems on normalised id and date, first row per key on either side."""
    left = top_k(a.where(F.col(keys[0]).isNotNull()), keys, order_a, 1)
    right = top_k(b.where(F.col(keys[0]).isNotNull()), keys, order_b, 1)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: f"{c}__a" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}__b" for c in shared})
    return left.join(right, list(keys))


def decode(df: DataFrame, dim: DataFrame, code: str, dim_code: str, dim_name: str, name_as: str) -> DataFrame:
    """Name of a code: the dimension's name, else the code as text, else '(none)'."""
    names = dim.select(F.col(dim_code).alias("__code"), F.col(dim_name).alias("__name"))
    joined = df.join(broadcast_if_bounded(names), F.col(code) == F.col("__code"), "left")
    name = F.coalesce("__name", F.col(code).cast("string"), F.lit("(none)"))
    return joined.withColumn(name_as, name).drop("__code", "__name")


def remap(df: DataFrame, dim: DataFrame, key: str, dim_key: str, dim_value: str, column: str,
          order: Sequence[Column]) -> DataFrame:
    """Override a column by lookup and keep the old value where the id is unknown."""
    names = top_k(dim.select(F.col(dim_key).alias("__k"), F.col(dim_value).alias("__v"), *order), ["__k"],
                  order, 1).select("__k", "__v") if order else dim.select(
        F.col(dim_key).alias("__k"), F.col(dim_value).alias("__v")).groupBy("__k").agg(F.min("__v").alias("__v"))
    joined = df.join(names, normalize_id(F.col(key)) == F.col("__k"), "left")
    return joined.withColumn(column, F.coalesce("__v", F.col(column))).drop("__k", "__v")


def gold_override(df: DataFrame, gold: DataFrame, key: str, label: str, gold_label: str) -> DataFrame:
    """Linked label where there is one, else the own label."""
    joined = df.join(gold.select(key, F.col(gold_label).alias("__gold")), key, "left")
    return joined.withColumn(label, F.coalesce("__gold", F.col(label))).drop("__gold")


# ---- set operations ----
def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order (``dropDuplicates`` keeps an arbitrary one)."""
    return top_k(df, keys, order, 1)


def union_distinct(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.distinct()


def order_stream(scope: DataFrame, procedures: DataFrame, medications: DataFrame) -> DataFrame:
    """One typed stream from two order tables, each inside the case's episode.

    ``scope`` has LogID, PAT_ID, EpiStart, EpiEnd; the order tables PAT_ID, OrderTime and GroupName.
    """
    parts = []
    for source, table in (("PROC", procedures), ("MED", medications)):
        inside = interval_join(scope, table, ["PAT_ID"], "EpiStart", "EpiEnd", "OrderTime", 7 * 86400)
        parts.append(inside.select(*scope.columns, F.lit(source).alias("OrderSource"), "OrderTime", F.concat(
            F.lit(f"{source}:"), F.coalesce("GroupName", F.lit("Other"))).alias("OrderGroup")))
    return parts[0].unionByName(parts[1])


def timeline(df: DataFrame, key: str, source: str, milestones: Mapping[str, str], keep_missing: bool = False) -> DataFrame:
    """Milestone columns turned into (key, Source, EventName, EventTime) rows."""
    long = df.unpivot([key], list(milestones.values()), "__column", "EventTime")
    named = F.create_map(*[F.lit(x) for name, c in milestones.items() for x in (c, name)])[F.col("__column")]
    rows = long.select(key, F.lit(source).alias("Source"), named.alias("EventName"), "EventTime")
    return rows if keep_missing else rows.where(F.col("EventTime").isNotNull())


def split_list(df: DataFrame, column: str, out: str, separator: str = ";") -> DataFrame:
    """One row per non-empty trimmed element of a delimited list."""
    parts = df.withColumn(out, F.explode(F.split(F.col(column), separator)))
    return parts.withColumn(out, F.trim(out)).where(F.length(out) > 0)


def provider_edges(surgical: DataFrame, leads: DataFrame, staff: DataFrame, providers: DataFrame) -> DataFrame:
    """Case-provider edges from three sources with source tag and provider type.

    ``surgical`` has LogID, ProvID, RoleCode; ``leads`` LogID, ProvID; ``staff`` LogID and a delimited ProvID list.
    """
    flags = providers.select("ProvID", "EMPLOYED_CRNA_YN", "IS_RESIDENT", "DOCTORS_DEGREE", "MCD_PROF_CD_C")
    no_role = F.lit(None).cast(surgical.schema["RoleCode"].dataType).alias("RoleCode")
    sources = (
        (surgical.select("LogID", F.col("ProvID").cast("string"), "RoleCode"), "surgical_team", "surgical"),
        (leads.where(F.col("ProvID").isNotNull()).select("LogID", F.col("ProvID").cast("string"), no_role),
         "anesthesia_lead", "anesthesia_lead"),
        (split_list(staff.where(F.col("ProvList").isNotNull()), "ProvList", "ProvID").select("LogID", "ProvID", no_role),
         "anesthesia_staff", "anesthesia_staff"),
    )
    result = None
    for rows, tag, context in sources:
        kind = classify_provider(context, F.col("EMPLOYED_CRNA_YN"), F.col("IS_RESIDENT"), F.col("DOCTORS_DEGREE"),
                                 F.col("MCD_PROF_CD_C"))
        part = rows.join(flags, "ProvID", "left").select(
            "LogID", "ProvID", "RoleCode", F.lit(tag).alias("RoleSource"), kind.alias("ProviderType"))
        result = part if result is None else result.unionByName(part)
    return result


# ---- aggregates ----
def flag_pivot(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One 0/1 column per rule: does any row of the key satisfy it?"""
    return df.groupBy(*keys).agg(*[F.max(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in rules.items()])


def value_pivot(df: DataFrame, keys: Sequence[str], code: str, value: str, columns: Mapping[str, Sequence]) -> DataFrame:
    """Largest value per group of codes. On text values the largest is the last in text order ('9' beats '10')."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(code).isin(*codes), F.col(value))).alias(name)
                                   for name, codes in columns.items()])


def pivot_count(df: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """Row counts per category, with a fixed list so that no extra pass looks for the values."""
    return df.groupBy(key).pivot(category, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def pivot_share(df: DataFrame, key: str, category: str, values: Sequence[str]) -> DataFrame:
    """Counts per category divided by their row total."""
    counts = pivot_count(df, key, category, values)
    total = F.greatest(sum((F.col(f"`{v}`") for v in values), F.lit(0)), F.lit(1))
    return counts.select(key, *[(F.col(f"`{v}`") / total).alias(v) for v in values])


def stay_summary(stays: DataFrame, key: str, unit_type: str = "UnitType", hours: str = "Hours") -> DataFrame:
    """Counts and hours per unit type; 'Other' stands for intermediate."""
    kinds = {"acute": "Acute", "intensive": "Intensive", "intermediate": "Other"}
    aggregates = []
    for name, kind in kinds.items():
        hit = F.col(unit_type) == kind
        aggregates += [F.count_if(hit).alias(f"{name}_count"),
                       F.sum(F.when(hit, F.col(hours)).otherwise(0.0)).alias(f"{name}_hours")]
    return stays.groupBy(key).agg(*aggregates, F.count(F.lit(1)).alias("total_count"),
                                  F.coalesce(F.sum(hours), F.lit(0.0)).alias("total_hours"))


def length_of_stay(stays: DataFrame, key: str, start: str = "InTime", end: str = "OutTime") -> DataFrame:
    """Days from the first arrival to the last departure."""
    span = stays.groupBy(key).agg(F.min(start).alias("__a"), F.max(end).alias("__b"))
    return span.select(key, (seconds_between(F.col("__a"), F.col("__b")) / 86400.0).alias("los_days"))


def prolonged_stay(stays: DataFrame, value: str = "los_days", p: float = 0.75) -> DataFrame:
    """Flag values above the cohort's quantile; rows without a value drop out."""
    known = stays.where(F.col(value).isNotNull())
    cutoff = grouped_quantiles(known, [], value, {"cutoff": p}).select("cutoff").scalar()
    return known.withColumn("plos", (F.col(value) > cutoff).cast("int"))


def turnaround(df: DataFrame, keys: Sequence[str], measures: Sequence[str], count_as: str = "n") -> DataFrame:
    """Row count, median and 95th percentile of each measure per group."""
    result = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_as))
    return null_safe_join(result, quantiles_of(df, keys, measures, {"med": 0.5, "p95": 0.95}), keys)


def quantiles_of(df: DataFrame, keys: Sequence[str], measures: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Quantiles of several measures per group as columns ``name_measure``; all measures share one pass."""
    keys, measures = list(keys), list(measures)
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(keys, measures, "__measure", "__value")
    found = grouped_quantiles(long, [*keys, "__measure"], "__value", dict(shares))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__measure") == m, F.col(n))).alias(f"{n}_{m}") for m in measures for n in shares])


def pct(flag: Column) -> Column:
    """Share of rows with the flag in percent, null for an empty group."""
    return F.lit(100.0) * F.sum(flag) / F.nullif(F.count(F.lit(1)), F.lit(0))


def assemble_text(lines: DataFrame, keys: Sequence[str], line: str, text: str, out: str = "NoteText",
                  separator: str = "\r\n") -> DataFrame:
    """Lines of one text joined in order. The result is a single value, so a task holds one text at a time."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(line).alias("l"),
                                                                                F.col(text).alias("t")))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(out))


def entropy(df: DataFrame, key: str, category: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy (nats) of the category counts of each key."""
    counts = df.groupBy(key, category).agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("__n") / F.col("__t")
    return (with_key_totals(counts, [key], F.sum("__n").alias("__t")).groupBy(key)
            .agg((-F.sum(share * F.log(share + 1e-9))).alias(out)))


def keyword_fraction(df: DataFrame, key: str, category: str, hit: Column, out: str = "fraction") -> DataFrame:
    """Share of the distinct categories of a key that satisfy the test."""
    distinct = df.select(key, category).distinct()
    return distinct.groupBy(key).agg((F.count_if(hit) / F.greatest(F.count(category), F.lit(1))).alias(out))


def team_features(edges: DataFrame, providers: DataFrame, encounters: DataFrame) -> DataFrame:
    """Care team make-up and the primary surgeon's case volumes, one row per case, missing as 0.

    Edges are shuffled once, by case and into parts of bounded size, so no task aggregates more than its part.
    """
    people = providers.select(
        normalize_id(F.col("ProvID")).alias("ProvID"), yn(F.col("IsResident")).alias("__r"),
        yn(F.col("EmployedCRNA")).alias("__c"), yn(F.col("IsHospitalist")).alias("__h"),
        number(F.col("CaseVolume2yr")).alias("__v2"), number(F.col("CaseVolume5yr")).alias("__v5"))
    pairs = in_parts(edges.select(normalize_id(F.col("LogID")).alias("LogID"), normalize_id(F.col("ProvID")).alias("ProvID")), "LogID").distinct()
    # One row per provider, so the pairs stay distinct behind the join.
    known = people.groupBy("ProvID").agg(*[F.sum(c).alias(c) for c in ("__r", "__c", "__h")])
    team = pairs.join(known, "ProvID", "left").groupBy("LogID").agg(
        F.count("ProvID").alias("team_size"), F.sum("__r").alias("n_residents"),
        F.sum("__c").alias("n_crna"), F.sum("__h").alias("n_hospitalists"))
    for flag, source in (("has_resident", "n_residents"), ("has_crna", "n_crna"), ("has_hospitalist", "n_hospitalists")):
        team = team.withColumn(flag, (F.col(source) > 0).cast("int"))
    surgeons = people.select(F.col("ProvID").alias("__s"), F.col("__v2").alias("surg_casevol_2yr"),
                             F.col("__v5").alias("surg_casevol_5yr"))
    cases = encounters.select(normalize_id(F.col("LogID")).alias("LogID"),
                              normalize_id(F.col("PrimarySurgID")).alias("__p"))
    joined = cases.join(surgeons, F.col("__p") == F.col("__s"), "left").withColumn(
        "surg_vol_unmatched", F.col("__s").isNull().cast("int")).drop("__p", "__s")
    return joined.join(team, "LogID", "left").na.fill(0)


def case_volume(cases: DataFrame, team: DataFrame, as_of: Column, case: str = "LOG_ID", provider: str = "ProvID",
                day: str = "SURGERY_DATE") -> DataFrame:
    """Distinct cases per provider in the two years before ``as_of`` and in all."""
    recent = F.col(day) >= shift(as_of, "year", -2)
    return (team.join(cases.select(case, day), case).groupBy(provider)
            .agg(F.count_distinct(F.when(recent, F.col(case))).alias("CaseVolume2yr"),
                 F.count_distinct(case).alias("CaseVolume5yr")))


def cluster_profile(df: DataFrame, label: str, medians: Sequence[str], shares: Mapping[str, Column]) -> DataFrame:
    """Size, share, medians and percentages of conditions per cluster."""
    total = df.agg(F.count(F.lit(1))).scalar()
    result = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[
        (F.lit(100.0) * F.avg(F.coalesce(test, F.lit(False)).cast("int"))).alias(name) for name, test in shares.items()])
    result = result.withColumn("pct", F.lit(100.0) * F.col("n") / total)
    return result.join(quantiles_of(df, [label], medians, {"med": 0.5}), label, "left") if medians else result


def lead_units(stays: DataFrame, clusters: DataFrame, case: str, label: str, unit: str, minimum: int = 20) -> DataFrame:
    """Per cluster the unit most typical of it: the highest share of its cases over the share in the cohort.

    Units with under ``minimum`` cases of the cluster do not count; ties go to the first name. Columns: label, lead_unit.
    """
    seen = stays.select(case, unit).where(F.col(unit).isNotNull()).distinct().join(clusters.select(case, label), case)
    sizes = clusters.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    whole = seen.groupBy(unit).agg(F.count(F.lit(1)).alias("__all"))
    cells = seen.groupBy(label, unit).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum)
    lift = F.col("__n").cast("double") / F.col("__size") / F.col("__all")
    rated = cells.join(whole, unit).join(sizes, label).withColumn("__lift", lift)
    return rated.groupBy(label).agg(F.min(F.struct((-F.col("__lift")).alias("l"), F.col(unit).alias("u")))["u"].alias("lead_unit"))


def name_clusters(profile: DataFrame) -> Column:
    """Readable name of a care-delivery profile from its percentages (columns as produced by ``cluster_profile``), with
    the lead unit if the profile has a column ``lead_unit``."""
    unit = (F.when(F.col("pct_icu") >= 25, "ICU/critical-care").when(F.col("pct_or_only") >= 40, "ambulatory/procedural")
            .when(F.col("pct_ed") >= 40, "ED-origin").otherwise("inpatient-ward"))
    acuity = (F.when(F.col("asa_ge3") >= 55, "high-acuity").when(F.col("asa_ge3") <= 35, "low-acuity")
              .otherwise("mixed-acuity"))
    setting = (F.when(F.col("inpatient") >= 55, "inpatient").when(F.col("inpatient") <= 35, "outpatient")
               .otherwise("mixed"))
    team = (F.when(F.col("pct_highvol") >= 55, "; high-vol attendings")
            .when(F.col("pct_resident") >= 55, "; teaching (resident/fellow)").otherwise(""))
    lead = F.coalesce(F.concat(F.lit("; lead unit: "), F.nullif(F.col("lead_unit"), F.lit(""))), F.lit("")) if "lead_unit" in profile.columns else F.lit("")
    return F.concat(unit, F.lit(", "), setting, F.lit(", "), acuity, team, lead)
