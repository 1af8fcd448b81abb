"""Filters and prioritised classifications."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.functions import fixed
from casetrail.functions.clock import boundaries
from casetrail.functions.scalars import number, yn


def not_cancelled(subtype: Column, keep_null: bool, cancelled: int = 2) -> Column:
    """Events that were not cancelled; a missing subtype is kept or dropped as asked."""
    return (subtype.isNull() | (subtype != cancelled)) if keep_null else (subtype != cancelled)


def cohort_filter(cases: DataFrame, details: DataFrame, patients: DataFrame, links: DataFrame, sites: DataFrame,
                  first_day: str, last_day: str, parent_site: int, completed: int = 2,
                  minimum_age: int = 18) -> DataFrame:
    """Completed adult cases of one campus inside a date window that link to an encounter.

    ``details`` may lack a case: the missing row counts as "nothing recorded against it". Age is tested on calendar
    years, while AgeYears uses days / 365.25, so the two may disagree near a birthday.
    """
    rows = (cases.where(F.col("SURGERY_DATE").between(F.lit(first_day).cast("timestamp"),
                                                      F.lit(last_day).cast("timestamp")))
            .where((F.col("STATUS_C") == completed) & F.col("PROC_NOT_PERF_C").isNull())
            .join(details, "LOG_ID", "left").where(F.col("PROC_NOT_DONE_RSN_C").isNull())
            .join(patients, "PAT_ID").where(F.col("BIRTH_DATE").isNotNull())
            .join(links.withColumn("EncounterCSN", F.coalesce("OR_LINK_CSN", "PAT_ENC_CSN_ID"))
                  .select("LOG_ID", "EncounterCSN"), "LOG_ID")
            .where(F.col("EncounterCSN").isNotNull())
            .join(sites.where(F.col("HOSP_PARENT_LOC_ID") == parent_site).select("LOC_ID"), "LOC_ID"))
    age = F.datediff("SURGERY_DATE", "BIRTH_DATE") / F.lit(365.25)
    return (rows.where(boundaries("year", F.col("BIRTH_DATE"), F.col("SURGERY_DATE")) >= minimum_age)
            .select(F.col("LOG_ID").cast("string").alias("LogID"), "EncounterCSN", "PAT_ID",
                    F.to_date("SURGERY_DATE").alias("SurgeryDate"), F.year("SURGERY_DATE").alias("SurgeryYear"),
                    age.cast("decimal(5,2)").alias("AgeYears")))


def isin_codes(df: DataFrame, column: str, codes: Sequence, inline: int = 200) -> DataFrame:
    """Rows whose code is listed; a long list becomes a semi join instead of a huge IN predicate."""
    if len(codes) <= inline:
        return df.where(F.col(column).isin(*codes))
    kind = df.schema[column].dataType
    listed = df.sparkSession.createDataFrame([(c,) for c in codes], "code string").select(
        F.col("code").cast(kind).alias(column))
    return df.join(listed.distinct(), column, "left_semi")


def exclude_labels(df: DataFrame, column: str, labels: Sequence[str] = fixed.EXCLUDED_DISPOSITIONS) -> DataFrame:
    """Drop rows with a listed label; rows without a label stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*labels))


def select_features(df: DataFrame, allow: Sequence[str], deny: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Allow-list projection for leakage control; warns about allowed columns that are absent."""
    missing = [c for c in allow if c not in df.columns]
    if missing:
        warnings.warn(f"allowed columns not present: {missing}", stacklevel=2)
    chosen = [c for c in allow if c in df.columns and c not in deny]
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *chosen]])


def classify_provider(context: str, crna: Column, resident: Column, degree: Column, profession: Column) -> Column:
    """Provider type by precedence; the surgical list and the two anesthesia lists rank the flags differently."""
    is_crna = F.coalesce(crna == "1", F.lit(False))
    is_resident = F.coalesce(resident == "Y", F.lit(False))
    physician = F.coalesce(degree.contains("MD") | degree.contains("DO"), F.lit(False))
    nurse = F.coalesce(profession == 22, F.lit(False))
    technician = F.coalesce(profession.isin(52, 53), F.lit(False))
    if context == "surgical":
        return (F.when(is_resident, "SurgicalTeam").when(is_crna, "OtherClinician").when(physician, "SurgicalTeam")
                .when(nurse, "Nurse").when(technician, "Technician").otherwise("Other"))
    if context == "anesthesia_lead":
        return F.lit("OtherClinician")
    if context == "anesthesia_staff":
        return F.when(~is_crna & ~is_resident & ~physician & nurse, "Nurse").otherwise("OtherClinician")
    raise ValueError(f"unknown context {context!r}")


def classify_unit(name: Column, adt_type: Column, or_type: Column, inpatient: Column, short: bool = False) -> Column:
    """Unit type from codes, then name patterns; the short form knows no emergency units and uses Y for inpatient."""
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    if not short:
        result = result.when((adt_type == 1) | name.rlike("EMERGENCY|TRIAGE"), "ED")
    result = result.when(or_type.isin(1, 2), "OR").when(or_type.isin(3, 4), "Intermediate")
    if not short:
        result = result.when(adt_type == 7, "Intensive")
    return (result.when(name.rlike("ICU|CCU|INTENSIVE|CRITICAL"), "Intensive")
            .when(name.rlike("STEP DOWN|STEPDOWN|IMU|INTERMEDIATE|TELEMETRY"), "Intermediate")
            .when((inpatient == ("Y" if short else "1")) | (adt_type == 0), "Acute").otherwise("Other"))


# Fixed cut-offs of the single-feature triggers.
RED_FLAG_LABS = {
    "Albumin <3.0 g/dL": ("ALB", lambda v: v < 3.0),
    "Hematocrit <27%": ("HCT", lambda v: v < 27.0),
    "Creatinine >2.0 mg/dL": ("Creat", lambda v: v > 2.0),
    "Sodium <130 or >150": ("NA", lambda v: (v < 130) | (v > 150)),
    "INR >1.5": ("INR", lambda v: v > 1.5),
    "WBC >15 x10^3/uL": ("WBC", lambda v: v > 15.0),
    "ASA class >=IV": ("ASAClass", lambda v: v >= 4.0),
}
RED_FLAG_HISTORY = {
    "Preoperative dialysis": "Preop Dialysis",
    "Preoperative AKI": "Preop Acute Kidney Injury",
    "Disseminated cancer": "Disseminated Cancer",
    "Heart failure": "Heart Failure",
    "Ventilator dependent": "Ventilator Dependent",
}


def red_flags(df: DataFrame, keep: Sequence[str] = (), names: Mapping[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns with one 0/1 column per trigger and ``any_flag``; a missing value never raises a flag.

    ``names`` maps the expected column names to the ones in ``df``.
    """
    names = dict(names or {})
    zero = F.lit(0)

    def column(c: str) -> Column | None:
        actual = names.get(c, c)
        return F.col(f"`{actual}`") if actual in df.columns else None

    flags = {}
    for label, (c, test) in RED_FLAG_LABS.items():
        col = column(c)
        flags[label] = zero if col is None else F.coalesce(test(number(col)), F.lit(False)).cast("int")
    for label, c in RED_FLAG_HISTORY.items():
        col = column(c)
        flags[label] = zero if col is None else yn(col, "not_negative")
    icu = column("has_ICU")
    flags["Post-op ICU stay"] = zero if icu is None else F.coalesce((icu > 0), F.lit(False)).cast("int")
    return df.select(*[F.col(f"`{c}`") for c in keep], *[f.alias(label) for label, f in flags.items()],
                     F.greatest(*flags.values()).alias("any_flag"))
