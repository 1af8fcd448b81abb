"""Composite data products: cohort, label, scores, comorbidity and medication blocks, trajectories, referral patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import fixed
from casetrail.functions.clock import age_years, boundaries, shift
from casetrail.functions.scalars import bmi, contains_any, inches_to_cm, number, ounces_to_kg, yn
from casetrail.operators.ordering import null_safe_join
from casetrail.operators.predicates import classify_unit, cohort_filter, isin_codes, not_cancelled
from casetrail.operators.ranks import top_k
from casetrail.operators.relational import (case_volume, decode, flag_pivot, length_of_stay, milestone_pair, pct, provider_edges,
                                            turnaround, union_distinct, value_pivot)
from casetrail.operators.sampling import stratified_sample
from casetrail.operators.sequences import first_last
from casetrail.operators.temporal import (asof, broadcast_if_bounded, covering_anchor, interval_join, lookback, scd2_current, scd2_join, to_intervals,
                                          window_counts)
from casetrail.session import stored

# Shares a patient's cases are dealt into where they meet the patient's history.
SALTS = 8

# Stretch of time whose rows of one patient are ordered together, about as many rows as its summary is worth.
HISTORY_CHUNK = 365 * 86400


def open_end() -> Column:
    """Time that stands for "not ended yet"."""
    return F.lit("9999-12-31").cast("timestamp")


# ---- cohort and label ----
def build_cohort(cases: DataFrame, details: DataFrame, patients: DataFrame, links: DataFrame, sites: DataFrame,
                 billing: DataFrame, first_day: str, last_day: str, parent_site: int,
                 codes: Sequence[str] = fixed.PROCEDURE_CODES, per_year: int = 10_000, seed: int = 42) -> DataFrame:
    """Included cases with their top-value listed procedure code, at most ``per_year`` per year in hash order.

    ``billing``: EncounterCSN, PAT_ID, CPT_CODE, RVU_WORK.
    """
    included = cohort_filter(cases, details, patients, links, sites, first_day, last_day, parent_site)
    listed = isin_codes(billing, "CPT_CODE", codes).join(
        included.select("EncounterCSN", "PAT_ID").distinct(), ["EncounterCSN", "PAT_ID"], "left_semi")
    top = top_k(listed, ["EncounterCSN"], [F.desc_nulls_last("RVU_WORK"), F.asc("CPT_CODE")], 1).select(
        "EncounterCSN", F.col("CPT_CODE").alias("PrimaryCPT"))
    return stratified_sample(included.join(top, "EncounterCSN"), "SurgeryYear", ["LogID"], per_year, seed).select(
        *fixed.COHORT_COLUMNS)


def primary_code(cohort: DataFrame) -> DataFrame:
    return cohort.select("LogID", "PrimaryCPT").orderBy("LogID")


def index_discharge(cases: DataFrame, adt: DataFrame) -> DataFrame:
    """Latest uncancelled discharge of each case's encounter."""
    leaving = adt.where((F.col("EVENT_TYPE_C") == 2) & not_cancelled(F.col("EVENT_SUBTYPE_C"), keep_null=False))
    last = leaving.groupBy(F.col("PAT_ENC_CSN_ID").alias("EncounterCSN")).agg(
        F.max("EFFECTIVE_TIME").alias("DischargeTime"))
    return cases.join(last, "EncounterCSN")


def readmission_label(cases: DataFrame, adt: DataFrame, stays: DataFrame, days: int = 30,
                      types: Sequence[int] = fixed.UNPLANNED_ADMISSION_TYPES) -> DataFrame:
    """DaysToReadmission and the label: first unplanned admission after the index discharge, on day 1..30 after surgery.

    ``cases``: LogID, EncounterCSN, PAT_ID, SurgeryDate. ``stays``: PAT_ENC_CSN_ID, HOSP_ADMSN_TYPE_C. The first
    admission after the discharge is found as of, so a patient with very many rows costs no pairs.
    """
    indexed = index_discharge(cases, adt)
    unplanned = (adt.where((F.col("EVENT_TYPE_C") == 1) & not_cancelled(F.col("EVENT_SUBTYPE_C"), keep_null=False))
                 .join(stays.where(F.col("HOSP_ADMSN_TYPE_C").isin(*types)).select("PAT_ENC_CSN_ID").distinct(),
                       "PAT_ENC_CSN_ID", "left_semi")
                 .select("PAT_ID", F.col("EFFECTIVE_TIME").alias("AdmitTime")).distinct()
                 .withColumn("Admit", F.col("AdmitTime")))
    next_one = asof(indexed, unplanned, ["PAT_ID"], "DischargeTime", "AdmitTime", ["Admit"], "forward", strict=True, chunk_seconds=HISTORY_CHUNK)
    inside = F.col("Admit") < shift(F.col("SurgeryDate").cast("timestamp"), "day", days + 1)
    found = next_one.select("LogID", F.when(inside, F.datediff(F.to_date("Admit"), F.to_date("SurgeryDate"))).alias(
        "DaysToReadmission"))
    label = F.coalesce(F.col("DaysToReadmission").between(1, days), F.lit(False)).cast("int")
    return cases.select("LogID").join(found, "LogID", "left").withColumn("ReadmittedWithin30Days", label)


# ---- comorbidities and scores ----
def charlson_category(code: Column, corrected: bool = False) -> Column:
    """Charlson category of a code. The list is tested in order and the first match wins; ``corrected`` returns all."""
    if corrected:
        hits = F.array(*[F.when(code.rlike(p), F.lit(name)) for name, _, _, p in fixed.CHARLSON])
        return F.array_compact(hits)
    category = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, _, _, pattern in fixed.CHARLSON:
        category = category.when(code.rlike(pattern), name)
    return category


def charlson_flags(codes: DataFrame, key: str, code: str, corrected: bool = False) -> DataFrame:
    """One 0/1 column per category for the codes of each key."""
    tagged = codes.withColumn("__cat", charlson_category(F.col(code), corrected))
    if corrected:
        tagged = tagged.withColumn("__cat", F.explode_outer("__cat"))
    return flag_pivot(tagged, [key], {flag: F.col("__cat") == name for name, flag, _, _ in fixed.CHARLSON})


def charlson_points(columns: Mapping[str, Column] | None = None) -> Column:
    """Weighted sum of the 17 flags, not capped."""
    return sum((F.coalesce((columns or {}).get(f, F.col(f)), F.lit(0)) * w for _, f, w, _ in fixed.CHARLSON), F.lit(0))


def charlson_score(cap: int = 5) -> Column:
    return F.least(charlson_points(), F.lit(cap))


def charlson_score_partial(diabetes: Column, heart_failure: Column, kidney_injury: Column, dialysis: Column, cancer: Column,
                           immunosuppressed: Column, cap: int = 5) -> Column:
    """Fallback from yes/no history columns when diagnosis codes are missing."""
    def yes(c: Column) -> Column:
        return yn(c, "insulin")
    total = (yes(diabetes) + yes(heart_failure) + 2 * F.greatest(yes(kidney_injury), yes(dialysis)) + 6 * yes(cancer)
             + 2 * yes(immunosuppressed))
    return F.least(total, F.lit(cap))


def stay_points(days: Column) -> Column:
    """Length-of-stay points: the highest limit reached counts, below one day 0."""
    limits = ((14, 7), (7, 5), (4, 4), (3, 3), (2, 2), (1, 1))
    points = F.when(F.lit(False), F.lit(0))
    for limit, value in limits:
        points = points.when(days >= limit, value)
    return points.otherwise(0)


def lace(df: DataFrame, source: str = "ed_first") -> DataFrame:
    """L, A, C, E points and their sum. Expects los_days, is_ED_first or PatientType, the 17 flags and
    n_ed_visits_180d.
    """
    emergent = F.col("is_ED_first") == 1 if source in ("ed_first", "auto") else F.upper("PatientType") == "I"
    points = {"L_pts": stay_points(F.coalesce("los_days", F.lit(0.0))),
              "A_pts": F.when(F.coalesce(emergent, F.lit(False)), 3).otherwise(0), "C_pts": charlson_score(),
              "E_pts": F.least(F.coalesce("n_ed_visits_180d", F.lit(0)), F.lit(4)).cast("int")}
    scored = df.withColumns(points)
    return scored.withColumn("LACE_score", sum((F.col(c) for c in points), F.lit(0)))


def hospital_score(df: DataFrame, source: str = "ed_first") -> DataFrame:
    """Seven components and their sum. Expects HCT, NA, disseminated cancer, los_days, is_ED_first or PatientType and
    n_admits_365d.
    """
    emergent = F.col("is_ED_first") == 1 if source == "ed_first" else F.upper("PatientType") == "I"
    admits = F.coalesce("n_admits_365d", F.lit(0))
    points = {"H_pts": F.coalesce(number(F.col("HCT")) < 36, F.lit(False)).cast("int"),
              "O_pts": 2 * yn(F.col("`Disseminated Cancer`"), "yes"),
              "S_pts": F.coalesce(number(F.col("NA")) < 135, F.lit(False)).cast("int"), "P_pts": F.lit(1),
              "I_pts": F.coalesce(emergent, F.lit(False)).cast("int"),
              "T_pts": F.when(admits > 5, 5).when(admits >= 2, 2).otherwise(0),
              "A_pts": F.when(F.coalesce("los_days", F.lit(0.0)) >= 5, 2).otherwise(0)}
    scored = df.withColumns(points)
    return scored.withColumn("HOSPITAL_score", sum((F.col(c) for c in points), F.lit(0)))


def first_unit_flag(stays: DataFrame, key: str) -> DataFrame:
    """Whether the first stay was an emergency unit, by either classification."""
    ends = first_last(stays, [key], ["InTime", "SeqInEncounter"], ["UnitType", "InstitutionType"])
    hit = (F.col("first_UnitType") == "ED") | F.coalesce(F.col("first_InstitutionType") == "ED", F.lit(False))
    return ends.select(key, F.coalesce(hit, F.lit(False)).cast("int").alias("is_ED_first"))


def lace_inputs(cohort: DataFrame, problems: DataFrame, encounter_codes: DataFrame, ed_visits: DataFrame,
                admissions: DataFrame) -> DataFrame:
    """Case rows with 17 flags, emergency visits in 180 days and other admissions in 365 days before surgery.

    Visit counts come from running totals along each patient's time line instead of case-visit pairs.
    """
    anchored = cohort.withColumn("__at", F.col("SurgeryDate").cast("timestamp"))
    history = dx_history(anchored, problems, encounter_codes, pattern=None, key="LogID")
    flags = charlson_flags(history, "LogID", "code")
    base = anchored.select("LogID", "PAT_ID", "EncounterCSN", "__at")
    ed = window_counts(base, "LogID", ed_visits.select("PAT_ID", "visit", "at").dropDuplicates(["PAT_ID", "visit"]),
                       ["PAT_ID"], shift(F.col("__at"), "day", -180), F.col("__at"), "at", {"n_ed_visits_180d": F.lit(1)})
    stays = admissions.where(F.col("at").isNotNull()).select("PAT_ID", "visit", "at").dropDuplicates(["PAT_ID", "visit"])
    all_stays = window_counts(base, "LogID", stays, ["PAT_ID"], shift(F.col("__at"), "day", -365), F.col("__at"), "at",
                              {"n_admits_365d": F.lit(1)})
    own = base.join(stays.select("PAT_ID", F.col("visit").alias("EncounterCSN"), "at"), ["PAT_ID", "EncounterCSN"]).where(
        (F.col("at") < F.col("__at")) & (F.col("at") >= shift(F.col("__at"), "day", -365))).select(
        "LogID", F.lit(1).alias("__own")).distinct()
    counted = (cohort.select("LogID").join(flags, "LogID", "left").join(ed.select("LogID", "n_ed_visits_180d"), "LogID", "left")
               .join(all_stays.select("LogID", "n_admits_365d"), "LogID", "left").join(own, "LogID", "left").na.fill(0))
    return counted.withColumns({"n_admits_365d": (F.col("n_admits_365d") - F.col("__own")).cast("long"),
                                "n_ed_visits_180d": F.col("n_ed_visits_180d").cast("long")}).drop("__own")


def dx_history(cases: DataFrame, problems: DataFrame, encounter_codes: DataFrame, months: int = 24,
               pattern: str | None = fixed.DX_HISTORY, key: str = "PAT_ID", anchor: str = "__at") -> DataFrame:
    """Distinct (key, code): problems active at the anchor, with encounter codes of the ``months`` before it.

    ``problems``: PAT_ID, code, noted, resolved. ``encounter_codes``: PAT_ID, code, at. Grouping by patient lets the
    cases of one patient share their codes (and needs no case-code pairs); grouping by case keeps each case's own
    window, and the pairs formed are the result.
    """
    if pattern is not None:
        problems, encounter_codes = (t.where(F.col("code").rlike(pattern)) for t in (problems, encounter_codes))
    spans = problems.where(F.col("noted").isNotNull()).select(
        "PAT_ID", "code", F.col("noted").cast("timestamp").alias("__a"),
        F.coalesce(F.col("resolved").cast("timestamp"), open_end()).alias("__b")).distinct()
    dated = encounter_codes.where(F.col("at").isNotNull()).select("PAT_ID", "code", F.col("at").cast("timestamp").alias("at"))
    if key == "PAT_ID":
        # Both kinds meet the first anchor from their time on, in one pass. A problem counts if it has not ended by then; a code of
        # [t, t + months] holds an anchor exactly when it lies in the months before that anchor.
        points = cases.select("PAT_ID", F.col(anchor).alias("__an")).distinct().withColumn("__hit", F.col("__an"))
        lines = spans.select("PAT_ID", "code", F.col("__a").alias("at"), "__b").unionByName(
            dated.withColumn("__b", F.lit(None).cast("timestamp")))
        met = asof(lines, points, ["PAT_ID"], "at", "__an", ["__hit"], "forward", chunk_seconds=HISTORY_CHUNK)
        counts = F.when(F.col("__b").isNotNull(), F.col("__hit") <= F.col("__b")).otherwise(
            F.col("at") >= shift(F.col("__hit"), "month", -months))
        return met.where(counts).select(key, "code").distinct()
    base = cases.select(key, "PAT_ID", anchor).distinct()
    # Spans of one code that start together merge; cases of one patient are dealt over salts, so no task owns a patient.
    merged = spans.groupBy("PAT_ID", "code", "__a").agg(F.max("__b").alias("__b")).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = base.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    active = dealt.join(merged, ["PAT_ID", "__salt"]).where(F.col(anchor).between(F.col("__a"), F.col("__b"))).select(key, "code")
    recent = lookback(base, dated.distinct(), ["PAT_ID"], anchor, "at", months, "month", include_anchor=True)
    return union_distinct(active, recent.select(key, "code"))


def comorbidity_flags(history: DataFrame, key: str = "PAT_ID", draft: bool = False) -> DataFrame:
    rules = fixed.DX_FLAGS_DRAFT if draft else fixed.DX_FLAGS
    return flag_pivot(history, [key], {n: F.col("code").rlike(p) for n, p in rules.items()})


def draft_comorbidities(cases: DataFrame, problems: DataFrame, anchor: str = "__at") -> DataFrame:
    """Draft variant: active problems noted up to the anchor, or without a noted date."""
    active = problems.where(F.col("status") == 1)
    last = cases.groupBy("PAT_ID").agg(F.max(anchor).alias("__last"))
    known = active.join(last, "PAT_ID").where(F.col("noted").isNull() | (F.col("noted") <= F.col("__last")))
    return comorbidity_flags(known.select("PAT_ID", "code").distinct(), draft=True)


def medication_flags(cases: DataFrame, medications: DataFrame, names: DataFrame | None = None,
                     anchor: str = "__at") -> DataFrame:
    """Medication families active at any of the patient's anchors; some count only after 30 days of use.

    ``medications``: PAT_ID, GENERIC (or MEDICATION_ID with ``names``), START_DATE, END_DATE, DISCON_TIME. Use lasts
    to the earlier of end and discontinuation; an open one never ends. Long use looks for an anchor from day 30 on.
    """
    table = medications if names is None else medications.join(names, "MEDICATION_ID", "left")
    ends = [F.coalesce(F.col(c).cast("timestamp"), open_end()) for c in ("END_DATE", "DISCON_TIME")]
    spans = table.where(F.col("START_DATE").isNotNull()).select(
        "PAT_ID", F.upper("GENERIC").alias("__g"), F.col("START_DATE").cast("timestamp").alias("__a"),
        F.least(*ends).alias("__b"))
    # The last anchor up to the end tells both kinds of use; of uses that end together the one that began first decides.
    spans = spans.groupBy("PAT_ID", "__g", "__b").agg(F.min("__a").alias("__a"))
    points = cases.select("PAT_ID", F.col(anchor).alias("__an")).distinct().withColumn("__hit", F.col("__an"))
    used = asof(spans, points, ["PAT_ID"], "__b", "__an", ["__hit"], chunk_seconds=HISTORY_CHUNK).where(F.col("__hit") >= F.col("__a"))
    long_use = F.col("__hit") >= shift(F.col("__a"), "day", 30)
    return flag_pivot(used, ["PAT_ID"], {n: contains_any(F.col("__g"), words) & (long_use if chronic else F.lit(True))
                                         for n, (words, chronic) in fixed.MED_FLAGS.items()})


def smoking_status(cases: DataFrame, history: DataFrame, key: str = "PAT_ID", anchor: str = "__at") -> DataFrame:
    """Current smoker, or quit within a year, at the latest contact up to the anchor.

    The contact is found as of the anchor; with several cases per key the latest contact of any of them counts.
    """
    payload = history.select("PAT_ID", F.col("CONTACT_DATE").cast("timestamp").alias("__contact"), "TOBACCO_USER_C",
                             "SMOKING_QUIT_DATE")
    found = asof(cases.select(*dict.fromkeys([key, "PAT_ID"]), anchor).distinct(), payload, ["PAT_ID"], anchor, "__contact",
                 ["TOBACCO_USER_C", "SMOKING_QUIT_DATE"], chunk_seconds=365 * 86400)
    known = found.where(F.col("__contact_matched").isNotNull())
    latest = top_k(known, [key], [F.desc("__contact_matched"), F.asc(anchor)], 1)
    recent_quit = (F.col("TOBACCO_USER_C") == 4) & (F.col("SMOKING_QUIT_DATE") >= shift(F.col(anchor), "year", -1))
    yes = F.coalesce((F.col("TOBACCO_USER_C") == 1) | recent_quit, F.lit(False))
    return latest.select(key, yes.cast("int").alias("Smoker_Yes"))


def transfusion_flag(cases: DataFrame, orders: DataFrame, blood: DataFrame, anchor: str = "InRoomTime",
                     day: str = "SurgeryDate") -> DataFrame:
    """Red cells started in the 72 h before the in-room time, for cases with a red-cell order around surgery.

    Orders are first cut to 7 days before through the day of surgery; that predicate prunes the order table.
    """
    framed = cases.withColumn("__from", shift(F.col(day).cast("timestamp"), "day", -7)).withColumn(
        "__to", shift(F.col(day).cast("timestamp"), "day", 1))
    near = interval_join(framed, orders, ["PAT_ID"], "__from", "__to", "ORDER_TIME", 16 * 86400).where(
        F.col("ORDER_TIME") < F.col("__to"))
    red = blood.where((F.col("IS_BLOOD_YN") == "Y") & F.left("BLOOD_PRODUCT_CODE", F.lit(5)).isin(*fixed.RED_CELL_CODES))
    joined = near.join(red, "ORDER_ID")
    inside = F.col("BLOOD_START_INSTANT").between(shift(F.col(anchor), "hour", -72), F.col(anchor))
    return joined.groupBy("LogID").agg(F.max(F.when(inside, 1).otherwise(0)).alias("RBC_Yes"))


def room_anchor(cases: DataFrame, times: DataFrame, key: str = "LogID", event: str = "TRACKING_EVENT_C",
                at: str = "TRACKING_TIME_IN", day: str = "SurgeryDate") -> DataFrame:
    """In-room time (first event 60, else the day of surgery) and cut-to-close minutes (events 80 to 390)."""
    rooms = times.where(F.col(event) == 60).groupBy(key).agg(F.min(at).alias("__room"))
    anchored = cases.join(rooms, key, "left").withColumn(
        "InRoomTime", F.coalesce("__room", F.col(day).cast("timestamp"))).drop("__room")
    paired = milestone_pair(anchored, times, key, event, at, 80, 390, "__start", "__stop")
    return paired.withColumn("CutToClose", boundaries("minute", F.col("__start"), F.col("__stop"))).drop("__start", "__stop")


def procedure_counts(procedures: DataFrame, key: str = "LogID") -> DataFrame:
    """Distinct other procedures of the first panel and distinct procedures of further panels."""
    first, later = F.col("panel") == 1, F.col("panel") > 1
    return procedures.groupBy(key).agg(
        F.count_distinct(F.when(first & (F.col("ordinal") > 1), F.col("procedure"))).alias("OtherProcedures"),
        F.count_distinct(F.when(later, F.col("procedure"))).alias("ConcurrentProcedures"))


def latest_labs(cases: DataFrame, results: DataFrame, anchor: str = "InRoomTime", days: int = 180, key: str = "LogID",
                components: Mapping[str, Sequence[str]] = fixed.LAB_COMPONENTS) -> DataFrame:
    """Most recent value per component in the ``days`` up to the anchor, one column each.

    ``results``: PAT_ID, COMPONENT_ID, ORD_VALUE, RESULT_TIME. The newest time per component id is a grouped maximum
    that keeps ties; of tied values the last in text order counts, as values are text.
    """
    wanted = [c for ids in components.values() for c in ids]
    rows = lookback(cases.select(key, "PAT_ID", anchor), results.where(F.col("COMPONENT_ID").isin(*wanted)), ["PAT_ID"],
                    anchor, "RESULT_TIME", days, "day", include_anchor=True)
    latest = rows.groupBy(key, "COMPONENT_ID").agg(
        F.max(F.struct("RESULT_TIME", "ORD_VALUE"))["ORD_VALUE"].alias("ORD_VALUE"))
    return value_pivot(latest, [key], "COMPONENT_ID", "ORD_VALUE", components)


def encounter_vitals(cases: DataFrame, encounters: DataFrame) -> DataFrame:
    """Height and weight of the case's encounter as recorded. ``encounters``: EncounterCSN, HEIGHT, WEIGHT."""
    return cases.select("LogID", "EncounterCSN").join(encounters, "EncounterCSN").select("LogID", "HEIGHT", "WEIGHT")


def discharge_info(cases: DataFrame, stays: DataFrame, names: DataFrame) -> DataFrame:
    """Name of the disposition the stay ended with. ``stays``: EncounterCSN, DISCH_DISP_C; ``names``: DISCH_DISP_C, NAME."""
    named = stays.join(names, "DISCH_DISP_C").select("EncounterCSN", F.col("NAME").alias("DischargeDisposition"))
    return cases.select("LogID", "EncounterCSN").join(named, "EncounterCSN").select("LogID", "DischargeDisposition")


def anesthesia_block(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Type, ASA class and complication counts over the patient's anesthesia records of the day of surgery.

    ``records``: PAT_ID, RECORD_DATE, AN_TYPE, ASA_SCORE_C, CARDIAC_ARREST, CABG_STROKE, REINTUBATION. Records meet their cases on
    patient and day, so a patient with many records is spread over the days. A count that no record has is 0.
    """
    largest = {"AnesType": "AN_TYPE", "ASA_FromAnes": "ASA_SCORE_C", "CardiacArrestCount": "CARDIAC_ARREST", "CVAStrokeCount": "CABG_STROKE",
               "ReintubationCount": "REINTUBATION"}
    daily = records.groupBy("PAT_ID", F.to_date("RECORD_DATE").alias("SurgeryDate")).agg(*[F.max(c).alias(n) for n, c in largest.items()])
    block = cases.select("LogID", "PAT_ID", "SurgeryDate").join(daily, ["PAT_ID", "SurgeryDate"])
    return block.select("LogID", *largest).na.fill(0, ["CardiacArrestCount", "CVAStrokeCount", "ReintubationCount"])


def demographics(patients: DataFrame, races: DataFrame, race_names: DataFrame, ethnicities: DataFrame,
                 languages: DataFrame) -> DataFrame:
    """Race (first line), ethnicity, language and postal code per patient."""
    first = races.where(F.col("LINE") == 1).join(race_names, "PATIENT_RACE_C", "left").select("PAT_ID", "Race")
    return (patients.join(first, "PAT_ID", "left").join(ethnicities, "ETHNIC_GROUP_C", "left")
            .join(languages, "LANGUAGE_C", "left").select("PAT_ID", "Race", "Ethnicity", "Language", "ZIP"))


def social_flags(accounts: DataFrame, codes: DataFrame, key: str = "HSP_ACCOUNT_ID") -> DataFrame:
    """Social circumstance flags per hospital account, over all its diagnosis lines."""
    mine = codes.join(accounts.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi")
    return flag_pivot(mine, [key], {n: F.col("code").rlike(p) for n, p in fixed.SOCIAL_FLAGS.items()})


def bulk_features(cases: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Wide row per case from its blocks, in the fixed column order.

    ``cases``: LogID, PAT_ID, EncounterCSN, SurgeryDate, PAT_MRN_ID, BirthDate, SEX_C, PAT_TYPE_C, ACCT_BASECLS_HA_C,
    ASA_RATE_C, HSP_ACCOUNT_ID, PrimaryCPT. Blocks by name, each optional and one row per key: room (CutToClose),
    procedures, vitals (HEIGHT, WEIGHT), discharge, anesthesia, labs, dx, meds, smoking, transfusion, label,
    demographics, social.
    """
    keys = {"dx": "PAT_ID", "meds": "PAT_ID", "smoking": "PAT_ID", "demographics": "PAT_ID", "social": "HSP_ACCOUNT_ID"}
    wide = cases
    # Key by key, so that the growing row is shuffled once per key; the blocks by case, the widest, come last.
    for key in ("HSP_ACCOUNT_ID", "PAT_ID", "LogID"):
        for name, block in blocks.items():
            if keys.get(name, "LogID") == key:
                # Written first: what a block shuffles goes before the next block begins.
                wide = wide.join(stored(block), key, "left")

    def col(name: str, kind: str = "string") -> Column:
        return F.col(f"`{name}`") if name in wide.columns else F.lit(None).cast(kind)

    def on(*names: str) -> Column:
        return sum((F.coalesce(col(n, "int"), F.lit(0)) for n in names), F.lit(0)) > 0

    def yes(*names: str) -> Column:
        return F.when(on(*names), "Yes").otherwise("No")

    days = col("DaysToReadmission", "int")
    columns = {
        "LogID": col("LogID"), "PAT_ID": col("PAT_ID"), "EncounterCSN": col("EncounterCSN"),
        "SurgeryDate": col("SurgeryDate"), "PAT_MRN_ID": col("PAT_MRN_ID"),
        "AgeYears": age_years(col("BirthDate", "date"), col("SurgeryDate", "date"), 6),
        "Gender": F.when(col("SEX_C", "int") == 1, "F").when(col("SEX_C", "int") == 2, "M"),
        "PatientType": F.when(col("ACCT_BASECLS_HA_C", "int") == 1, "I").when(col("ACCT_BASECLS_HA_C", "int").isin(2, 3), "O")
        .when(col("PAT_TYPE_C", "int").isin(1, 3), "I").otherwise("O"),
        "ASAClass": F.coalesce(col("ASA_FromAnes", "int"), col("ASA_RATE_C", "int")).cast("string"),
        "AnesType": col("AnesType"), "Discharge Disposition": col("DischargeDisposition"),
        "Height (cm)": inches_to_cm(col("HEIGHT")), "Weight (kg)": ounces_to_kg(col("WEIGHT")),
        "BMI": bmi(col("HEIGHT"), col("WEIGHT")), "CutToClose": col("CutToClose", "long"),
        "# of Other Procedures": F.coalesce(col("OtherProcedures", "long"), F.lit(0)),
        "# of Concurrent Procedures": F.coalesce(col("ConcurrentProcedures", "long"), F.lit(0)),
    }
    for lab in ("NA", "BUN", "Creat", "ALB", "BT", "SGOT", "ALKPhos", "WBC", "HCT", "PLT", "INR", "APTT"):
        columns[lab] = number(col(lab), "decimal(8,2)")
    insulin = on("Insulin_Rx")
    columns |= {
        "Diabetes Mellitus": F.when(insulin, "Insulin").when(on("Diabetes_Dx"), "Non-insulin").otherwise("No"),
        "Current Smoker within 1 year": yes("Smoker_Yes"), "Ventilator Dependent": yes("VentDep_Dx"),
        "History of Severe COPD": yes("COPD_Dx"), "Ascites": yes("Ascites_Dx"), "Heart Failure": yes("HF_Dx"),
        "Hypertension requiring medication": yes("HTN_Dx", "Antihypertensive_Rx"),
        "Preop Acute Kidney Injury": yes("AKI_Dx"), "Preop Dialysis": yes("Dialysis_Dx"),
        "Disseminated Cancer": yes("DisseminatedCa_Dx"),
        "Immunosuppressive Therapy": yes("Steroid_Dx", "Immunosuppressant_Rx"),
        "Bleeding Disorder": yes("Bleeding_Dx", "Anticoagulant_Rx"), "Preop RBC Transfusions (72h)": yes("RBC_Yes"),
        "# of Cardiac Arrest Requiring CPR": F.coalesce(col("CardiacArrestCount", "int"), F.lit(0)),
        "# of Stroke/Cerebral Vascular Acccident (CVA)": F.coalesce(col("CVAStrokeCount", "int"), F.lit(0)),
        "# of Postop Unplanned Intubation": F.coalesce(col("ReintubationCount", "int"), F.lit(0)),
        "DaysToReadmission": days,
        "ReadmittedWithin30Days": F.coalesce(days.between(1, 30), F.lit(False)).cast("int"),
        "PrimaryCPT": col("PrimaryCPT"), "Race": col("Race"), "Ethnicity": col("Ethnicity"),
        "Language": col("Language"), "ZIP": col("ZIP"),
    }
    for flag in fixed.SOCIAL_FLAGS:
        columns[flag] = F.coalesce(col(flag, "int"), F.lit(0))
    return wide.select(*[c.alias(n) for n, c in columns.items()])


# ---- referral ----
def referral_patterns(cases: DataFrame, visits: DataFrame, departments: DataFrame, providers: DataFrame,
                      referrals: DataFrame, days: int = 90) -> DataFrame:
    """Referral source, depth of the workup, handoff and referral record per case.

    ``cases``: LogID, PAT_ID, PrimarySurgID, SurgeryDate. ``visits``: PAT_ID, ClinicCSN, VisitDate, VisitProvID,
    ReferringProvID, DEPARTMENT_ID. ``departments``: DEPARTMENT_ID, SPECIALTY. ``providers``: PROV_ID, PROV_TYPE,
    PRIMARY_DEPT_ID. ``referrals``: PAT_ID, REFERRAL_ID, REFERRAL_TYPE_C, ENTRY_DATE. A referral counts whatever its
    department.
    """
    surgical = departments.where(F.col("SPECIALTY").startswith("SURG") | F.col("SPECIALTY").contains("SURGERY")
                                 | F.col("SPECIALTY").isin(*fixed.SURGICAL_SPECIALTIES)).select("DEPARTMENT_ID")
    anchored = cases.withColumn("__at", F.col("SurgeryDate").cast("timestamp"))
    base = anchored.select("LogID", "PAT_ID", "__at")
    clinic = visits.join(surgical, "DEPARTMENT_ID", "left_semi").withColumn("__v", F.col("VisitDate").cast("timestamp"))
    seen = lookback(base, clinic.drop("DEPARTMENT_ID"), ["PAT_ID"], "__at", "__v", days, "day")
    ends = first_last(seen, ["LogID"], ["__v", "ClinicCSN"], ["VisitProvID", "ReferringProvID"]).select(
        "LogID", F.col("first_VisitProvID").alias("FirstSurgeryConsultProvID"),
        F.col("last_ReferringProvID").alias("ReferringProvID"))
    depth = seen.groupBy("LogID").agg(
        F.count_distinct("ClinicCSN").alias("n_preop_surg_clinic_visits_90d"),
        F.datediff(F.to_date(F.max("__at")), F.to_date(F.min("__v"))).alias("days_first_surg_clinic_to_surgery"))
    records = lookback(base, referrals.withColumn("__e", F.col("ENTRY_DATE").cast("timestamp")), ["PAT_ID"], "__at", "__e",
                       days, "day").groupBy("LogID").agg(
        F.max(F.when(F.col("REFERRAL_ID").isNotNull(), 1).otherwise(0)).alias("HasEpicReferralRecord"),
        F.max("REFERRAL_TYPE_C").alias("EpicReferralTypeCode"))
    people = providers.join(departments.select(F.col("DEPARTMENT_ID").alias("PRIMARY_DEPT_ID"),
                                               F.col("SPECIALTY").alias("ReferringProvSpecialty")), "PRIMARY_DEPT_ID", "left")
    named = people.select(F.col("PROV_ID").alias("__prov"), F.col("PROV_TYPE").alias("ReferringProvType"),
                          "ReferringProvSpecialty")
    wide = (cases.join(ends, "LogID", "left").join(depth, "LogID", "left").join(records, "LogID", "left")
            .join(named, F.col("ReferringProvID") == F.col("__prov"), "left"))
    referrer, first = F.col("ReferringProvID"), F.col("FirstSurgeryConsultProvID")
    source = (F.when(referrer.isNull(), "Unknown").when(referrer == F.col("PAT_ID"), "Self")
              .when(F.col("__prov").isNotNull(), "Internal").otherwise("External"))
    handoff = F.when(first.isNotNull(), F.coalesce((first != F.col("PrimarySurgID")).cast("int"), F.lit(1)))
    return wide.withColumns({
        "ReferralSource": source, "within_service_handoff": handoff,
        "n_preop_surg_clinic_visits_90d": F.coalesce("n_preop_surg_clinic_visits_90d", F.lit(0)),
        "HasEpicReferralRecord": F.coalesce("HasEpicReferralRecord", F.lit(0))}).drop("__prov")


# ---- trajectories and node tables ----
def unit_trajectory(cases: DataFrame, adt: DataFrame, departments: DataFrame, lookup: DataFrame) -> DataFrame:
    """Care-unit stays of each case inside its hospital stay (or -3 / +30 days of surgery when times are missing).

    ``cases``: LogID, PAT_ID, SurgeryDate, AdmTime, DischTime. ``adt`` carries its own encounter number.
    """
    day = F.col("SurgeryDate").cast("timestamp")
    framed = cases.withColumn("__lo", F.coalesce("AdmTime", shift(day, "day", -3))).withColumn(
        "__hi", F.coalesce("DischTime", shift(day, "day", 30))).select("LogID", "PAT_ID", "__lo", "__hi")
    moves = adt.where(F.col("EVENT_TYPE_C").isin(1, 2, 3) & not_cancelled(F.col("EVENT_SUBTYPE_C"), keep_null=False)).select(
        "PAT_ID", F.col("PAT_ENC_CSN_ID").alias("EncounterCSN"), "DEPARTMENT_ID", "EVENT_TYPE_C", "EFFECTIVE_TIME", "EVENT_ID")
    inside = interval_join(framed, moves, ["PAT_ID"], "__lo", "__hi", "EFFECTIVE_TIME", 7 * 86400)
    stays = to_intervals(inside, ["LogID"], "EFFECTIVE_TIME", ["EFFECTIVE_TIME", "EVENT_ID"], F.col("EVENT_TYPE_C") == 2)
    dated = stays.withColumn("__day", F.to_date("EFFECTIVE_TIME"))
    typed = scd2_join(dated, lookup.select(F.col("Clarity_ID"), F.col("GNNUnitType"), F.col("UnitType").alias(
        "InstitutionType"), "StartDate", "EndDate").withColumnRenamed("Clarity_ID", "DEPARTMENT_ID"), "DEPARTMENT_ID",
        "__day", "StartDate", "EndDate", ["GNNUnitType", "InstitutionType"])
    named = typed.join(departments.select("DEPARTMENT_ID", "DEPARTMENT_NAME"), "DEPARTMENT_ID", "left")
    return named.select("LogID", "EncounterCSN", "PAT_ID", F.col("DEPARTMENT_ID").alias("DepartmentID"),
                        F.col("DEPARTMENT_NAME").alias("DepartmentName"),
                        F.coalesce("GNNUnitType", F.lit("Other")).alias("UnitType"), "InstitutionType", "InTime",
                        "OutTime", "Hours", "SeqInEncounter")


def provider_nodes(edges: DataFrame, providers: DataFrame, cases: DataFrame, team: DataFrame, as_of: Column) -> DataFrame:
    """Attributes and case volumes of the providers that occur in the edges."""
    present = edges.select("ProvID").distinct()
    volumes = case_volume(cases, team, as_of)
    return (providers.join(present, "ProvID", "left_semi").join(volumes, "ProvID", "left")
            .na.fill(0, ["CaseVolume2yr", "CaseVolume5yr"]))


def unit_nodes(trajectory: DataFrame, departments: DataFrame, lookup: DataFrame) -> DataFrame:
    """Attributes of the departments that occur, with their current classification."""
    current = scd2_current(lookup, "EndDate").select(
        F.col("Clarity_ID").alias("DEPARTMENT_ID"), F.col("GNNUnitType"), F.col("UnitType").alias("InstitutionType"))
    present = trajectory.select(F.col("DepartmentID").alias("DEPARTMENT_ID")).distinct()
    return (departments.join(present, "DEPARTMENT_ID", "left_semi").join(broadcast_if_bounded(current), "DEPARTMENT_ID", "left")
            .withColumn("UnitType", F.coalesce("GNNUnitType", F.lit("Other"))).drop("GNNUnitType"))


def patient_case_view(patient: str | int, cases: DataFrame, surgical: DataFrame, leads: DataFrame, staff: DataFrame,
                      providers: DataFrame, adt: DataFrame, departments: DataFrame) -> dict[str, DataFrame]:
    """On-demand tables of one patient: provider edges and unit stays of the patient's cases.

    The id is compared as a literal, so it cannot change the query, and it reaches the scans as a filter.
    """
    mine = cases.where(F.col("PAT_ID") == F.lit(patient))
    keys = broadcast_if_bounded(mine.select("LogID").distinct())
    edges = provider_edges(*[t.join(keys, "LogID", "left_semi") for t in (surgical, leads, staff)], providers)
    visits = mine.select(F.col("EncounterCSN").alias("PAT_ENC_CSN_ID"), "LogID").where(F.col("PAT_ENC_CSN_ID").isNotNull())
    moves = adt.where(F.col("EVENT_TYPE_C").isin(1, 3) & not_cancelled(F.col("EVENT_SUBTYPE_C"), keep_null=False)).join(
        broadcast_if_bounded(visits), "PAT_ENC_CSN_ID")
    stays = to_intervals(moves, ["PAT_ENC_CSN_ID"], "EFFECTIVE_TIME", ["EFFECTIVE_TIME", "EVENT_ID"])
    named = stays.join(departments, "DEPARTMENT_ID", "left").withColumn("UnitType", classify_unit(
        F.col("DEPARTMENT_NAME"), F.col("ADT_UNIT_TYPE_C"), F.col("OR_UNIT_TYPE_C"), F.col("INPATIENT_DEPT_YN")))
    return {"edges": edges, "stays": named.select("LogID", F.col("PAT_ENC_CSN_ID").alias("EncounterCSN"), "DEPARTMENT_ID",
                                                  "UnitType", "InTime", "OutTime", "Hours", "SeqInEncounter")}


def structure_features(stays: DataFrame, key: str = "LogID") -> DataFrame:
    """Length of stay and first-unit flag side by side, the inputs both scores share."""
    return length_of_stay(stays, key).join(first_unit_flag(stays, key), key)


def interval_report(rows: DataFrame, keys: Sequence[str], intervals: Mapping[str, tuple[str, str, str]], required: Sequence[str],
                    lookups: Mapping[str, tuple[DataFrame, str, str]] | None = None, overdue: tuple[str, str] | None = None,
                    count_as: str = "n") -> DataFrame:
    """Turnaround report: row count, median and 95th percentile of each interval per group of ``keys``.

    ``intervals`` maps an output name to (unit, start column, end column), counted in unit boundaries; rows lacking a
    ``required`` column are left out. ``lookups`` maps a key to (table, code column, name column) with one row per code: the key becomes the
    name, the code as text where it has none, '(none)' without a code. Rows are grouped by code, so codes of equal name
    stay apart. ``overdue`` (end column, limit column) adds ``pct_overdue``; a missing limit is not overdue.
    """
    known = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required]))
    late = [] if overdue is None else [F.coalesce((F.col(overdue[0]) > F.col(overdue[1])).cast("int"), F.lit(0)).alias("__late")]
    measured = known.select(*keys, *[boundaries(unit, F.col(a), F.col(b)).alias(n) for n, (unit, a, b) in intervals.items()], *late)
    report = turnaround(measured, keys, list(intervals), count_as)
    if overdue is not None:
        report = null_safe_join(report, measured.groupBy(*keys).agg(pct(F.col("__late")).alias("pct_overdue")), list(keys))
    for key, (table, code, name) in (lookups or {}).items():
        report = decode(report, table, key, code, name, key)
    return report
