"""Composite products on the test tables: cohort, label, scores, flags, trajectories, referral patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.frames import SCORES_SQL, STAYS_SQL, scores, stays
from casetrail.catalog.registry import SQL, Tables, day, query, r6, rounded
from casetrail.catalog.relational import FLAGS_SQL, STAFF_SQL, SURGICAL_SQL, edge_sources, provider_flags, unit_lookup
from casetrail.functions import fixed
from casetrail.functions.clock import shift
from casetrail.operators import relational as R
from casetrail.operators import stats as E
from casetrail.operators import temporal as J
from casetrail.plans import clinical as C


# ---- cohort ----
_COHORT_SQL = """inc AS (SELECT o_orderkey::VARCHAR AS log, o_orderkey AS k, o_custkey AS pat, o_orderdate::DATE AS d, year(o_orderdate)::INT AS yr,
  round(date_diff('day', DATE '1970-06-15' + (o_custkey % 4000)::INT, o_orderdate::DATE) / 365.25, 2)::DOUBLE AS age FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' AND o_orderstatus <> 'O'
  AND year(o_orderdate) - year(DATE '1970-06-15' + (o_custkey % 4000)::INT) >= 18),
top AS (SELECT l_orderkey AS k, p_brand AS code FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN
  ('Brand#1', 'Brand#3', 'Brand#7', 'Brand#12', 'Brand#19', 'Brand#22') QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, p_brand) = 1),
cand AS (SELECT inc.*, code FROM inc JOIN top USING (k)),
cohort AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY md5('42:' || log)) AS rn FROM cand) WHERE rn <= 400)"""


def cohort(t: Tables) -> DataFrame:
    o, c = t.orders, t.customer
    cases = o.select(F.col("o_orderkey").alias("LOG_ID"), F.col("o_custkey").alias("PAT_ID"), F.col("o_orderdate").alias("SURGERY_DATE"),
                     F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("STATUS_C"),
                     F.lit(None).cast("int").alias("PROC_NOT_PERF_C"), (F.col("o_custkey") % 5).alias("LOC_ID"))
    details = o.select(F.col("o_orderkey").alias("LOG_ID"), F.lit(None).cast("int").alias("PROC_NOT_DONE_RSN_C"))
    patients = c.select(F.col("c_custkey").alias("PAT_ID"), F.date_add(
        F.lit("1970-06-15").cast("date"), (F.col("c_custkey") % 4000).cast("int")).alias("BIRTH_DATE"))
    links = o.select(F.col("o_orderkey").alias("LOG_ID"), F.lit(None).cast("bigint").alias("OR_LINK_CSN"),
                     F.col("o_orderkey").alias("PAT_ENC_CSN_ID"))
    sites = t.region.select(F.col("r_regionkey").cast("long").alias("LOC_ID"), F.lit(9).alias("HOSP_PARENT_LOC_ID"))
    keys = o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("PAT_ID"))
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("CPT_CODE"))
    billing = t.lineitem.join(keys, "l_orderkey").join(brands, "l_partkey").select(
        F.col("l_orderkey").alias("EncounterCSN"), "PAT_ID", "CPT_CODE", F.col("l_extendedprice").alias("RVU_WORK"))
    codes = ["Brand#1", "Brand#3", "Brand#7", "Brand#12", "Brand#19", "Brand#22"]
    return C.build_cohort(cases, details, patients, links, sites, billing, "1996-01-01", "2000-12-31", 9, codes, 400)


@query("c01_build_cohort", f"""
WITH {_COHORT_SQL} SELECT log AS "LogID", pat AS "PAT_ID", yr AS "SurgeryYear", age AS "AgeYears", code AS "PrimaryCPT" FROM cohort""")
def _(t: Tables) -> DataFrame:
    return cohort(t).select("LogID", "PAT_ID", "SurgeryYear", F.col("AgeYears").cast("double"), "PrimaryCPT")


@query("c22_primary_code", f"""
WITH {_COHORT_SQL} SELECT log AS "LogID", code AS "PrimaryCPT" FROM cohort ORDER BY 1""")
def _(t: Tables) -> DataFrame:
    return C.primary_code(cohort(t))


# ---- label: orders are stays that last (key % 9) days, an order's priority gives its admission type ----
_LABEL_SQL = """s AS (SELECT o_orderkey AS k, o_custkey AS pat, o_orderdate AS a, o_orderdate + to_days((o_orderkey % 9)::INT) AS d,
  CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 12 ELSE 5 END AS typ FROM orders),
label AS (SELECT x.k, min(date_diff('day', x.a, y.a)) AS days FROM s x JOIN s y ON y.pat = x.pat AND y.typ IN (3, 7, 8, 13, 14) AND y.k % 10 <> 0
  AND y.a > x.d AND y.a < x.a + INTERVAL 31 DAY WHERE x.k % 8 <> 0 GROUP BY 1)"""


def label_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, admission and discharge events, encounter types. Every eighth stay has no discharge, every tenth
    admission is cancelled.
    """
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    leave = F.timestamp_micros(F.unix_micros(at) + (k % 9) * 86_400_000_000)
    base = t.orders.select(k.alias("PAT_ENC_CSN_ID"), F.col("o_custkey").alias("PAT_ID"), at.alias("a"), leave.alias("b"),
                           F.when(F.col("o_orderpriority") == "1-URGENT", 8).when(F.col("o_orderpriority") == "2-HIGH", 3)
                           .when(F.col("o_orderpriority") == "3-MEDIUM", 12).otherwise(5).alias("HOSP_ADMSN_TYPE_C"))
    admits = base.select("PAT_ENC_CSN_ID", "PAT_ID", F.lit(1).alias("EVENT_TYPE_C"), F.when(
        F.col("PAT_ENC_CSN_ID") % 10 == 0, 2).otherwise(1).alias("EVENT_SUBTYPE_C"), F.col("a").alias("EFFECTIVE_TIME"))
    leaves = base.where("PAT_ENC_CSN_ID % 8 <> 0").select("PAT_ENC_CSN_ID", "PAT_ID", F.lit(2).alias("EVENT_TYPE_C"),
                                                         F.lit(1).alias("EVENT_SUBTYPE_C"), F.col("b").alias("EFFECTIVE_TIME"))
    cases = base.select(F.col("PAT_ENC_CSN_ID").alias("LogID"), F.col("PAT_ENC_CSN_ID").alias("EncounterCSN"), "PAT_ID",
                        F.to_date("a").alias("SurgeryDate"))
    return cases, admits.unionByName(leaves), base.select("PAT_ENC_CSN_ID", "HOSP_ADMSN_TYPE_C")


@query("c02_readmission_label", f"""
WITH {_LABEL_SQL} SELECT s.k AS "LogID", days::INT AS "DaysToReadmission", coalesce((days BETWEEN 1 AND 30)::INT, 0) AS "ReadmittedWithin30Days"
FROM s LEFT JOIN label USING (k)""")
def _(t: Tables) -> DataFrame:
    return C.readmission_label(*label_tables(t))


# ---- codes: a line is a coded diagnosis; the code mixes part brand and size ----
_LETTERS = ("I21", "I50", "I70", "I63", "G30", "J44", "M05", "K26", "K70.4", "E11.2", "G81", "N18", "C78.0", "C80.1", "K72", "B20",
            "E08", "I11.0", "Z99.2", "N18.6", "R18", "D66", "N17", "Z79.52", "Z59.0", "Z59.4", "Z60", "E10.9")
_CODE_SQL = "CASE l_partkey % 28 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_LETTERS)) + " END"
_CAT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(code, '{p}') THEN '{n}'" for n, _, _, p in fixed.CHARLSON) + " END"
_FLAG_SQL = ", ".join(f"max((cat = '{n}')::INT)::INT AS {f}" for n, f, _, _ in fixed.CHARLSON)


def code():
    c = F.when(F.lit(False), "")
    for i, value in enumerate(_LETTERS):
        c = c.when(F.col("l_partkey") % 28 == i, value)
    return c


@query("c03_charlson_category", f"""
WITH x AS (SELECT {_CODE_SQL} AS code FROM lineitem) SELECT code, {_CAT_SQL} AS cat, count(*) AS n FROM x GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select(code().alias("code")).groupBy("code", C.charlson_category(F.col("code")).alias("cat")).agg(
        F.count(F.lit(1)).alias("n"))


@query("c03_charlson_flags", f"""
WITH x AS (SELECT l_orderkey, {_CODE_SQL} AS code FROM lineitem), y AS (SELECT l_orderkey, {_CAT_SQL} AS cat FROM x)
SELECT l_orderkey, {_FLAG_SQL.replace('max((', 'max(coalesce((').replace(')::INT)::INT', ')::INT, 0))::INT')} FROM y GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return C.charlson_flags(t.lineitem.select("l_orderkey", code().alias("code")), "l_orderkey", "code")


_WEIGHT_SQL = " + ".join(f"{w} * {f}" for _, f, w, _ in fixed.CHARLSON)
_FLAGS_CTE = f"""x AS (SELECT l_orderkey, {_CODE_SQL} AS code FROM lineitem), y AS (SELECT l_orderkey, {_CAT_SQL} AS cat FROM x),
flags AS (SELECT l_orderkey, {_FLAG_SQL.replace('max((', 'max(coalesce((').replace(')::INT)::INT', ')::INT, 0))::INT')} FROM y GROUP BY 1)"""


@query("c04_charlson_score", f"""
WITH {_FLAGS_CTE} SELECT l_orderkey, ({_WEIGHT_SQL})::INT AS weighted, least({_WEIGHT_SQL}, 5)::INT AS score FROM flags""")
def _(t: Tables) -> DataFrame:
    flags = C.charlson_flags(t.lineitem.select("l_orderkey", code().alias("code")), "l_orderkey", "code")
    return flags.select("l_orderkey", C.charlson_points().alias("weighted"), C.charlson_score().alias("score"))


@query("c04_charlson_partial", """
WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Insulin' WHEN 1 THEN 'No' ELSE 'Non-insulin' END AS dm, o_orderkey % 5 = 0 AS hf,
 o_orderkey % 7 = 0 AS aki, o_orderkey % 2 = 0 AS dia, o_orderkey % 11 = 0 AS ca, o_orderkey % 13 = 0 AS im FROM orders)
SELECT o_orderkey, least((dm <> 'No')::INT + hf::INT + 2 * greatest(aki::INT, dia::INT) + 6 * ca::INT + 2 * im::INT, 5)::INT AS score FROM f""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")

    def yes(n: int):
        return F.when(k % n == 0, "Yes").otherwise("No")
    dm = F.when(k % 3 == 0, "Insulin").when(k % 3 == 1, "No").otherwise("Non-insulin")
    return t.orders.select("o_orderkey", C.charlson_score_partial(dm, yes(5), yes(7), yes(2), yes(11), yes(13)).alias("score"))


def score_inputs(t: Tables) -> DataFrame:
    """Case rows for both scores: span of shipments as length of stay, flags from line codes, prior orders as visits."""
    line = t.lineitem.select(F.col("l_orderkey").alias("LogID"), "l_shipdate", code().alias("code"), "l_quantity")
    flags = C.charlson_flags(line, "LogID", "code")
    stay = line.groupBy("LogID").agg((F.datediff(F.max("l_shipdate"), F.min("l_shipdate")) / 100.0).alias("los_days"),
                                     F.min("l_quantity").alias("HCT"), (F.max("l_quantity") + 100).alias("NA"))
    at = F.col("at")
    cases = t.orders.select(F.col("o_orderkey").alias("LogID"), "o_custkey", F.col("o_orderdate").alias("at"),
                            (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_ED_first"), F.when(
                                F.col("o_orderstatus") == "F", "I").otherwise("O").alias("PatientType"),
                            F.when(F.col("o_orderkey") % 6 == 0, "Yes").otherwise("No").alias("Disseminated Cancer"))
    events = t.orders.select("o_custkey", "o_orderdate")
    ed = J.window_counts(cases.select("LogID", "o_custkey", "at"), "LogID", events, ["o_custkey"], shift(at, "day", -180), at,
                         "o_orderdate", {"n_ed_visits_180d": F.lit(1)}, chunk_seconds=180 * 86400)
    ad = J.window_counts(cases.select("LogID", "o_custkey", "at"), "LogID", events, ["o_custkey"], shift(at, "day", -365), at,
                         "o_orderdate", {"n_admits_365d": F.lit(1)}, chunk_seconds=365 * 86400)
    return (cases.join(flags, "LogID", "left").join(stay, "LogID", "left")
            .join(ed.select("LogID", F.col("n_ed_visits_180d").cast("int")), "LogID")
            .join(ad.select("LogID", F.col("n_admits_365d").cast("int")), "LogID"))


_SCORE_SQL = f"""{_FLAGS_CTE}, st AS (SELECT l_orderkey, date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) / 100::DOUBLE AS los,
  min(l_quantity) AS hct, max(l_quantity) + 100 AS na FROM lineitem GROUP BY 1),
v AS (SELECT a.o_orderkey AS k, count(CASE WHEN b.o_orderdate >= a.o_orderdate - INTERVAL 180 DAY THEN 1 END) AS ed, count(b.o_orderkey) AS ad
  FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY GROUP BY 1),
base AS (SELECT o.*, coalesce(los, 0) AS los, hct, na, ed, ad, CASE WHEN flags.l_orderkey IS NULL THEN 0 ELSE least({_WEIGHT_SQL}, 5) END::INT AS c FROM orders o LEFT JOIN st ON st.l_orderkey = o.o_orderkey
  LEFT JOIN flags ON flags.l_orderkey = o.o_orderkey JOIN v ON v.k = o.o_orderkey)"""


@query("c05_lace", f"""
WITH {_SCORE_SQL} SELECT o_orderkey AS "LogID", CASE WHEN los >= 14 THEN 7 WHEN los >= 7 THEN 5 WHEN los >= 4 THEN 4 WHEN los >= 3 THEN 3 WHEN los >= 2 THEN 2
 WHEN los >= 1 THEN 1 ELSE 0 END AS "L_pts", CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END AS "A_pts", c AS "C_pts", least(ed, 4)::INT AS "E_pts",
 (CASE WHEN los >= 14 THEN 7 WHEN los >= 7 THEN 5 WHEN los >= 4 THEN 4 WHEN los >= 3 THEN 3 WHEN los >= 2 THEN 2 WHEN los >= 1 THEN 1 ELSE 0 END
 + CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END + c + least(ed, 4))::INT AS "LACE_score" FROM base""")
def _(t: Tables) -> DataFrame:
    return C.lace(score_inputs(t)).select("LogID", "L_pts", "A_pts", "C_pts", "E_pts", "LACE_score")


@query("c06_hospital_score", f"""
WITH {_SCORE_SQL}, p AS (SELECT o_orderkey AS "LogID", coalesce((hct < 36)::INT, 0) AS "H_pts", CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END AS "O_pts",
 coalesce((na < 135)::INT, 0) AS "S_pts", 1 AS "P_pts", (o_orderstatus = 'F')::INT AS "I_pts", CASE WHEN ad > 5 THEN 5 WHEN ad >= 2 THEN 2 ELSE 0 END AS "T_pts",
 CASE WHEN los >= 5 THEN 2 ELSE 0 END AS "A_pts" FROM base)
SELECT *, "H_pts" + "O_pts" + "S_pts" + "P_pts" + "I_pts" + "T_pts" + "A_pts" AS "HOSPITAL_score" FROM p""")
def _(t: Tables) -> DataFrame:
    return C.hospital_score(score_inputs(t), "patient_type").select(
        "LogID", "H_pts", "O_pts", "S_pts", "P_pts", "I_pts", "T_pts", "A_pts", "HOSPITAL_score")


@query("c07_score_rate", f"""
WITH {SCORES_SQL}, s AS (SELECT *, floor(p * 20)::INT AS score FROM scores) SELECT id, score, round(avg(y) OVER (PARTITION BY score), 6) AS rate FROM s""")
def _(t: Tables) -> DataFrame:
    s = scores(t).select("id", "y", F.floor(F.col("p") * 20).cast("int").alias("score"))
    return rounded(E.score_rate(s, "score").drop("y"), "rate")


@query("c07_bands", f"""
WITH {SCORES_SQL}, s AS (SELECT y, floor(p * 20)::INT AS score FROM scores), b AS (SELECT y, CASE WHEN score <= 4 THEN 'Low (0-4)' WHEN score <= 7 THEN 'Med (5-7)'
 WHEN score <= 9 THEN 'High (8-9)' ELSE 'Very high (10+)' END AS band FROM s WHERE score <= 20)
SELECT band, count(*) AS n, round(100.0::DOUBLE * avg(y), 6) AS event_pct, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM scores), 6) AS share_pct FROM b GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    s = scores(t).select("y", F.floor(F.col("p") * 20).cast("int").alias("score"))
    return rounded(E.bands(s, "score"), "event_pct", "share_pct")


# ---- history blocks ----
def history_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases with anchors, problems with noted and resolved dates, dated encounter codes."""
    keys = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("PAT_ID"))
    lines = t.lineitem.join(keys, "l_orderkey").select("PAT_ID", code().alias("code"), F.col("l_shipdate").alias("at"),
                                                      "l_quantity", "l_linenumber")
    problems = lines.where("l_linenumber <= 2").select("PAT_ID", "code", F.col("at").alias("noted"), F.when(
        F.col("l_quantity") > 10, F.timestamp_micros(F.unix_micros("at") + F.col("l_quantity").cast("long") * 864_000_000_000)).alias(
        "resolved"))
    visits = lines.where("l_linenumber > 2").select("PAT_ID", "code", "at")
    cases = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("LogID"), F.col("o_custkey").alias("PAT_ID"),
                                                        F.col("o_orderdate").alias("__at"))
    return cases, problems, visits


_HISTORY_SQL = f"""ln AS (SELECT o_custkey AS pat, {_CODE_SQL} AS code, l_shipdate AS tm, l_quantity AS q, l_linenumber AS num
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cs AS (SELECT o_orderkey AS log, o_custkey AS pat, o_orderdate AS tm FROM orders WHERE o_orderstatus = 'F'),
pr AS (SELECT pat, code, tm AS noted, CASE WHEN q > 10 THEN tm + to_days((q * 10)::INT) END AS resolved FROM ln WHERE num <= 2),
hist AS (SELECT cs.log, cs.pat, code FROM cs JOIN pr ON pr.pat = cs.pat AND noted <= cs.tm AND (resolved IS NULL OR resolved >= cs.tm)
  UNION SELECT cs.log, cs.pat, code FROM cs JOIN ln ON ln.pat = cs.pat AND num > 2 AND ln.tm >= cs.tm - INTERVAL 24 MONTH AND ln.tm <= cs.tm)"""
_DX_SQL = ", ".join(f"max(regexp_matches(code, '{p}')::INT)::INT AS \"{n}\"" for n, p in fixed.DX_FLAGS.items())


@query("c08_comorbidity_flags", f"""
WITH {_HISTORY_SQL} SELECT pat AS "PAT_ID", {_DX_SQL} FROM hist WHERE regexp_matches(code, '{fixed.DX_HISTORY}') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return C.comorbidity_flags(C.dx_history(*history_tables(t)))


@query("c08_comorbidity_flags_by_case", f"""
WITH {_HISTORY_SQL} SELECT log AS "LogID", {_DX_SQL} FROM hist WHERE regexp_matches(code, '{fixed.DX_HISTORY}') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return C.comorbidity_flags(C.dx_history(*history_tables(t), key="LogID"), "LogID")


@query("c08_draft_comorbidities", f"""
WITH {_HISTORY_SQL} SELECT pr.pat AS "PAT_ID", {", ".join(f"max(regexp_matches(code, '{p}')::INT)::INT AS {chr(34)}{n}{chr(34)}" for n, p in fixed.DX_FLAGS_DRAFT.items())}
FROM pr JOIN cs ON cs.pat = pr.pat WHERE noted <= cs.tm GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    cases, problems, _ = history_tables(t)
    return C.draft_comorbidities(cases, problems.withColumn("status", F.lit(1)))


_MEDS = ("insulin glargine", "Lisinopril 10", "prednisone", "warfarin", "metoprolol", "saline", "tacrolimus", "apixaban")
_MED_SQL = "CASE l_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MEDS)) + " END"


def medication_table(t: Tables) -> DataFrame:
    """Lines as prescriptions; the supplier gives the drug, quantity and line number the ends of use."""
    g = F.when(F.lit(False), "")
    for i, m in enumerate(_MEDS):
        g = g.when(F.col("l_suppkey") % 8 == i, m)
    at, q = F.col("l_shipdate"), F.col("l_quantity").cast("long")
    keys = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("PAT_ID"))
    return t.lineitem.join(keys, "l_orderkey").select(
        "PAT_ID", g.alias("GENERIC"), at.alias("START_DATE"),
        F.when(q > 20, F.timestamp_micros(F.unix_micros(at) + q * 3 * 86_400_000_000)).alias("END_DATE"),
        F.when(F.col("l_linenumber") % 3 == 0, shift(at, "day", 60)).alias("DISCON_TIME"))


@query("c09_medication_flags", f"""
WITH m AS (SELECT o_custkey AS pat, upper({_MED_SQL}) AS g, l_shipdate AS a, CASE WHEN l_quantity > 20 THEN l_shipdate + to_days((l_quantity * 3)::INT) END AS e,
  CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate + INTERVAL 60 DAY END AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
cs AS (SELECT o_custkey AS pat, o_orderdate AS at FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT cs.pat, g, (a <= cs.at - INTERVAL 30 DAY)::INT AS chronic FROM cs JOIN m ON m.pat = cs.pat AND a <= cs.at AND (e IS NULL OR e >= cs.at) AND (d IS NULL OR d >= cs.at))
SELECT pat AS "PAT_ID", max((g LIKE '%INSULIN%')::INT)::INT AS "Insulin_Rx", max(regexp_matches(g, 'LISINOPRIL|METOPROLOL')::INT)::INT AS "Antihypertensive_Rx",
 max((chronic = 1 AND regexp_matches(g, 'PREDNISONE|TACROLIMUS'))::INT)::INT AS "Immunosuppressant_Rx",
 max((chronic = 1 AND regexp_matches(g, 'WARFARIN|APIXABAN'))::INT)::INT AS "Anticoagulant_Rx" FROM j GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return C.medication_flags(history_tables(t)[0], medication_table(t))


@query("c10_smoking_status", """
WITH s AS (SELECT o_custkey AS pat, o_orderdate AS tm, max(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END) AS tob FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
cs AS (SELECT o_custkey AS pat, min(o_orderdate) AS tm FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
x AS (SELECT cs.pat, cs.tm, s.tob, s.tm - INTERVAL 200 DAY AS quit, row_number() OVER (PARTITION BY cs.pat ORDER BY s.tm DESC) AS rn FROM cs JOIN s ON s.pat = cs.pat AND s.tm <= cs.tm)
SELECT pat AS "PAT_ID", (tob = 1 OR (tob = 4 AND quit >= tm - INTERVAL 1 YEAR))::INT AS "Smoker_Yes" FROM x WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    hist = t.orders.where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("PAT_ID"), F.col("o_orderdate").alias("CONTACT_DATE")).agg(
        F.max(F.when(k == 0, 1).when(k == 1, 4).otherwise(5)).alias("TOBACCO_USER_C"))
    hist = hist.withColumn("SMOKING_QUIT_DATE", shift(F.col("CONTACT_DATE"), "day", -200))
    cases = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("PAT_ID")).agg(F.min("o_orderdate").alias("__at"))
    return C.smoking_status(cases, hist)


@query("c11_transfusion_flag", """
WITH b AS (SELECT o_custkey AS pat, l_shipdate AS ot, l_shipdate + to_hours((l_quantity * 2)::INT) AS st, 'E033' || CASE WHEN l_linenumber % 2 = 0 THEN '2' ELSE '6' END || 'V' AS cd
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o.o_orderkey AS "LogID", max((b.st BETWEEN o.o_orderdate - INTERVAL 72 HOUR + INTERVAL 8 HOUR AND o.o_orderdate + INTERVAL 8 HOUR)::INT)::INT AS "RBC_Yes"
FROM orders o JOIN b ON b.pat = o.o_custkey AND b.ot >= o.o_orderdate - INTERVAL 7 DAY AND b.ot < o.o_orderdate + INTERVAL 1 DAY GROUP BY 1""")
def transfusions(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("PAT_ID"))
    # The digest of a line, in 16 bytes, is formed where the line is read, so that no other columns are shuffled. It begins with the
    # order's key: a line without an order in the table has no equal among the joined ones, so blood is read without the join.
    lines = t.lineitem.where("l_orderkey IS NOT NULL").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", F.unhex(F.md5(F.concat_ws(
        "|", *[F.col(c).cast("string") for c in t.lineitem.columns]))).alias("ORDER_ID"))
    orders = lines.join(keys, "l_orderkey").select("PAT_ID", "ORDER_ID", F.col("l_shipdate").alias("ORDER_TIME"))
    blood = lines.select("ORDER_ID", F.lit("Y").alias("IS_BLOOD_YN"), F.concat(
        F.lit("E033"), F.when(F.col("l_linenumber") % 2 == 0, "2").otherwise("6"), F.lit("V")).alias("BLOOD_PRODUCT_CODE"),
        F.timestamp_micros(F.unix_micros("l_shipdate") + F.col("l_quantity").cast("long") * 7_200_000_000).alias("BLOOD_START_INSTANT"))
    cases = t.orders.select(F.col("o_orderkey").alias("LogID"), F.col("o_custkey").alias("PAT_ID"), F.to_date("o_orderdate").alias(
        "SurgeryDate"), shift(F.col("o_orderdate"), "hour", 8).alias("InRoomTime"))
    return C.transfusion_flag(cases, orders, blood)


def room_times(t: Tables) -> DataFrame:
    """Milestones 60, 80 and 390 of each order, from the first shipment of a third of its lines."""
    n = F.col("l_linenumber") % 3
    return t.lineitem.groupBy(F.col("l_orderkey").alias("LogID"), F.when(n == 1, 60).when(n == 2, 80).otherwise(390).alias(
        "TRACKING_EVENT_C")).agg(F.min("l_shipdate").alias("m")).withColumn("TRACKING_TIME_IN", F.timestamp_micros(
            F.unix_micros("m") + (F.col("LogID") % 50) * 60_000_000))


@query("c12_room_anchor", """
WITH m AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 1 THEN 60 WHEN 2 THEN 80 ELSE 390 END AS ev, min(l_shipdate) + to_minutes((l_orderkey % 50)::BIGINT) AS tm
  FROM lineitem GROUP BY l_orderkey, l_linenumber % 3)
SELECT o.o_orderkey AS "LogID", epoch_us(coalesce(r.tm, o.o_orderdate)) AS room_us, date_diff('minute', s.tm, e.tm) AS "CutToClose" FROM orders o
LEFT JOIN m r ON r.l_orderkey = o.o_orderkey AND r.ev = 60 LEFT JOIN m s ON s.l_orderkey = o.o_orderkey AND s.ev = 80
LEFT JOIN m e ON e.l_orderkey = o.o_orderkey AND e.ev = 390""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("LogID"), F.to_date("o_orderdate").alias("SurgeryDate"))
    return C.room_anchor(cases, room_times(t)).select("LogID", F.unix_micros("InRoomTime").alias("room_us"), "CutToClose")


@query("c12_procedure_counts", """
SELECT l_orderkey AS "LogID", count(DISTINCT CASE WHEN l_suppkey % 3 = 1 AND l_linenumber > 1 THEN l_partkey END) AS "OtherProcedures",
 count(DISTINCT CASE WHEN l_suppkey % 3 > 1 THEN l_partkey END) AS "ConcurrentProcedures" FROM lineitem GROUP BY 1""")
def procedures(t: Tables) -> DataFrame:
    return C.procedure_counts(t.lineitem.select(F.col("l_orderkey").alias("LogID"), (F.col("l_suppkey") % 3).alias("panel"),
                                                F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("procedure")))


def people(t: Tables) -> DataFrame:
    """Race, ethnicity, language and postal code of the customers."""
    k = F.col("c_custkey")
    patients = t.customer.select(k.alias("PAT_ID"), (F.col("c_nationkey") % 2).alias("ETHNIC_GROUP_C"), (k % 7).cast("int").alias(
        "LANGUAGE_C"), k.cast("string").alias("ZIP"))
    races = t.customer.select(k.alias("PAT_ID"), F.lit(1).alias("LINE"), F.col("c_nationkey").alias("PATIENT_RACE_C"))
    names = t.nation.select(F.col("n_nationkey").alias("PATIENT_RACE_C"), F.col("n_name").alias("Race"))
    ethnic = t.region.where("r_regionkey = 0").select(F.col("r_regionkey").alias("ETHNIC_GROUP_C"), F.lit("eth0").alias("Ethnicity"))
    langs = t.region.select(F.col("r_regionkey").alias("LANGUAGE_C"), F.col("r_name").alias("Language"))
    return C.demographics(patients, races, names, ethnic, langs)


@query("c13_demographics_social", f"""
WITH d AS (SELECT c_custkey AS "PAT_ID", n_name AS "Race", CASE WHEN c_nationkey % 2 = 0 THEN 'eth0' ELSE NULL END AS "Ethnicity", r_name AS "Language",
  c_custkey::VARCHAR AS "ZIP" FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_custkey % 7),
s AS (SELECT o_custkey, {", ".join(f"max(regexp_matches({_CODE_SQL}, '{p}')::INT)::INT AS {chr(34)}{n}{chr(34)}" for n, p in fixed.SOCIAL_FLAGS.items())}
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT d.*, coalesce("SDOH_Housing_Z", 0) AS "SDOH_Housing_Z", coalesce("SDOH_Food_Z", 0) AS "SDOH_Food_Z", coalesce("SDOH_Financial_Z", 0) AS "SDOH_Financial_Z",
 coalesce("SDOH_Any_Z", 0) AS "SDOH_Any_Z" FROM d LEFT JOIN s ON s.o_custkey = d."PAT_ID" """)
def _(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("HSP_ACCOUNT_ID"))
    codes = t.lineitem.join(keys, "l_orderkey").select("HSP_ACCOUNT_ID", code().alias("code"))
    social = C.social_flags(keys, codes).withColumnRenamed("HSP_ACCOUNT_ID", "PAT_ID")
    return people(t).join(social, "PAT_ID", "left").na.fill(0)


@query("a06_latest_labs", """
WITH r AS (SELECT l_orderkey AS k, l_returnflag AS comp, l_shipdate AS rt, l_quantity::INT::VARCHAR AS v FROM lineitem),
w AS (SELECT o_orderkey AS k, comp, v, dense_rank() OVER (PARTITION BY o_orderkey, comp ORDER BY rt DESC) AS s FROM orders JOIN r ON r.k = o_orderkey
  WHERE rt BETWEEN o_orderdate - INTERVAL 180 DAY AND o_orderdate)
SELECT k AS "LogID", max(CASE WHEN comp IN ('A') THEN v END) AS a, max(CASE WHEN comp IN ('N', 'R') THEN v END) AS nr FROM w WHERE s = 1 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("LogID"), F.col("o_orderkey").alias("PAT_ID"), F.col("o_orderdate").alias("InRoomTime"))
    results = t.lineitem.select(F.col("l_orderkey").alias("PAT_ID"), F.col("l_returnflag").alias("COMPONENT_ID"), F.col(
        "l_quantity").cast("int").cast("string").alias("ORD_VALUE"), F.col("l_shipdate").alias("RESULT_TIME"))
    return C.latest_labs(cases, results, components={"a": ["A"], "nr": ["N", "R"]})


# ---- the wide row: all thirteen blocks ----
_LAB_IDS = [i for ids in fixed.LAB_COMPONENTS.values() for i in ids]
_LAB_SQL = "CASE l_partkey % 24 " + " ".join(f"WHEN {n} THEN '{i}'" for n, i in enumerate(_LAB_IDS)) + " END"
_PIVOT_SQL = ", ".join("max(CASE WHEN comp IN ({}) THEN v END) AS {}".format(", ".join(f"'{i}'" for i in ids), f"lab_{n}") for n, ids in fixed.LAB_COMPONENTS.items())
# Histories look back from every case here; two codes become dependence on a ventilator and low income, which the other queries lack.
_ALL_DX_SQL = SQL["c08_comorbidity_flags"].replace("FROM orders WHERE o_orderstatus = 'F'", "FROM orders").replace("'B20'", "'Z99.11'")
_SOCIAL_SQL = _CODE_SQL.replace("'K72'", "'Z59.6'")
_ALL_RX_SQL = SQL["c09_medication_flags"].replace("FROM orders WHERE o_orderstatus = 'F'", "FROM orders")


def _yes_sql(name: str, *flags: str) -> str:
    return "CASE WHEN " + " OR ".join(f'"{f}" = 1' for f in flags) + f" THEN 'Yes' ELSE 'No' END AS \"{name}\""


_YES_SQL = ",\n ".join(_yes_sql(*names) for names in (
    ("Current Smoker within 1 year", "Smoker_Yes"), ("Ventilator Dependent", "VentDep_Dx"), ("History of Severe COPD", "COPD_Dx"), ("Ascites", "Ascites_Dx"),
    ("Heart Failure", "HF_Dx"), ("Hypertension requiring medication", "HTN_Dx", "Antihypertensive_Rx"), ("Preop Acute Kidney Injury", "AKI_Dx"),
    ("Preop Dialysis", "Dialysis_Dx"), ("Disseminated Cancer", "DisseminatedCa_Dx"),
    ("Immunosuppressive Therapy", "Steroid_Dx", "Immunosuppressant_Rx"), ("Bleeding Disorder", "Bleeding_Dx", "Anticoagulant_Rx"),
    ("Preop RBC Transfusions (72h)", "RBC_Yes")))


@query("c14_bulk_features", f"""
WITH room AS ({SQL["c12_room_anchor"]}), procs AS ({SQL["c12_procedure_counts"]}), label AS ({SQL["c02_readmission_label"]}), dx AS ({_ALL_DX_SQL}),
rx AS ({_ALL_RX_SQL}), rbc AS ({SQL["c11_transfusion_flag"]}), who AS (SELECT "PAT_ID", "Race", "Ethnicity", "Language", "ZIP" FROM ({SQL["c13_demographics_social"]})),
contacts AS (SELECT o_custkey AS pat, o_orderdate - INTERVAL 100 DAY AS tm, max(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 5 END) AS tob FROM orders GROUP BY 1, 2),
met AS (SELECT o_custkey AS pat, tob, (tob = 1 OR (tob = 4 AND contacts.tm - INTERVAL 200 DAY >= o_orderdate - INTERVAL 1 YEAR))::INT AS "Smoker_Yes",
  row_number() OVER (PARTITION BY o_custkey ORDER BY contacts.tm DESC, o_orderdate) AS n FROM orders JOIN contacts ON pat = o_custkey AND contacts.tm <= o_orderdate),
smoke AS (SELECT pat, "Smoker_Yes" FROM met WHERE n = 1),
anes AS (SELECT a.o_orderkey AS k, max(b.o_orderpriority) AS typ, max(CASE WHEN b.o_orderkey % 5 > 0 THEN b.o_orderkey % 5 END)::INT AS asa,
  max((b.o_orderkey % 40 = 0)::INT) AS arrest, max((b.o_orderkey % 50 = 1)::INT * 2) AS stroke, coalesce(max(CASE WHEN b.o_orderkey % 3 > 0 THEN (b.o_orderkey % 60 = 2)::INT END), 0) AS tube
  FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate::DATE = a.o_orderdate::DATE AND b.o_orderkey % 4 < 3 GROUP BY 1),
res AS (SELECT o_custkey AS pat, {_LAB_SQL} AS comp, l_shipdate AS tm, CASE WHEN l_linenumber = 5 THEN 'pending' ELSE l_quantity::INT::VARCHAR END AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
newest AS (SELECT room."LogID" AS k, comp, v, dense_rank() OVER (PARTITION BY room."LogID", comp ORDER BY tm DESC) AS n FROM room JOIN orders ON o_orderkey = room."LogID"
  JOIN res ON res.pat = o_custkey AND tm BETWEEN make_timestamp(room_us) - INTERVAL 180 DAY AND make_timestamp(room_us)),
labs AS (SELECT k, {_PIVOT_SQL} FROM newest WHERE n = 1 GROUP BY 1),
soc AS (SELECT l_orderkey AS k, {", ".join(f"max(regexp_matches({_SOCIAL_SQL}, '{p}')::INT)::INT AS {chr(34)}{n}{chr(34)}" for n, p in fixed.SOCIAL_FLAGS.items())} FROM lineitem GROUP BY 1),
enc AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE (CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE 50 + o_orderkey % 30 END)::VARCHAR END AS h,
  CASE WHEN o_orderkey % 13 > 0 THEN (1500 + o_orderkey % 3000)::VARCHAR END AS w FROM orders)
SELECT o_orderkey AS "LogID", o_custkey AS "PAT_ID", o_orderkey AS "EncounterCSN", strftime(o_orderdate, '%Y-%m-%d') AS "SurgeryDate", 'M' || o_custkey AS "PAT_MRN_ID",
 round(date_diff('day', DATE '1940-01-01' + (o_custkey % 4000)::INT, o_orderdate::DATE) / 365.25, 2)::DOUBLE AS "AgeYears",
 CASE o_orderkey % 3 WHEN 1 THEN 'F' WHEN 2 THEN 'M' END AS "Gender",
 CASE WHEN o_orderkey % 4 = 1 THEN 'I' WHEN o_orderkey % 4 IN (2, 3) THEN 'O' WHEN o_orderkey % 6 IN (1, 3) THEN 'I' ELSE 'O' END AS "PatientType",
 coalesce(asa, (o_orderkey % 7)::INT)::VARCHAR AS "ASAClass", typ AS "AnesType", r_name AS "Discharge Disposition",
 round(TRY_CAST(h AS DECIMAL(6, 2))::DOUBLE * 2.54::DOUBLE, 1) AS "Height (cm)", round(TRY_CAST(w AS DECIMAL(7, 2))::DOUBLE * 0.0283495::DOUBLE, 1) AS "Weight (kg)",
 CASE WHEN TRY_CAST(h AS DECIMAL(6, 2)) > 0 THEN round(w::DOUBLE * 0.0283495::DOUBLE / pow(TRY_CAST(h AS DOUBLE) * 2.54::DOUBLE / 100, 2), 6) END AS "BMI", "CutToClose",
 coalesce("OtherProcedures", 0) AS "# of Other Procedures", coalesce("ConcurrentProcedures", 0) AS "# of Concurrent Procedures",
 {", ".join(f'TRY_CAST("lab_{n}" AS DECIMAL(8, 2))::DOUBLE AS {chr(34)}{n}{chr(34)}' for n in fixed.LAB_COMPONENTS)},
 CASE WHEN "Insulin_Rx" = 1 THEN 'Insulin' WHEN "Diabetes_Dx" = 1 THEN 'Non-insulin' ELSE 'No' END AS "Diabetes Mellitus",
 {_YES_SQL},
 coalesce(arrest, 0)::INT AS "# of Cardiac Arrest Requiring CPR", coalesce(stroke, 0)::INT AS "# of Stroke/Cerebral Vascular Acccident (CVA)",
 coalesce(tube, 0)::INT AS "# of Postop Unplanned Intubation", "DaysToReadmission", "ReadmittedWithin30Days", 'C' || o_custkey % 90 AS "PrimaryCPT", "Race", "Ethnicity", "Language", "ZIP",
 {", ".join(f'coalesce({chr(34)}{n}{chr(34)}, 0)::INT AS {chr(34)}{n}{chr(34)}' for n in fixed.SOCIAL_FLAGS)}
FROM orders LEFT JOIN room ON room."LogID" = o_orderkey LEFT JOIN procs ON procs."LogID" = o_orderkey LEFT JOIN label ON label."LogID" = o_orderkey
LEFT JOIN dx ON dx."PAT_ID" = o_custkey LEFT JOIN rx ON rx."PAT_ID" = o_custkey LEFT JOIN rbc ON rbc."LogID" = o_orderkey LEFT JOIN who ON who."PAT_ID" = o_custkey
LEFT JOIN smoke ON smoke.pat = o_custkey LEFT JOIN anes ON anes.k = o_orderkey LEFT JOIN labs ON labs.k = o_orderkey LEFT JOIN soc ON soc.k = o_orderkey
LEFT JOIN enc ON enc.k = o_orderkey LEFT JOIN region ON r_regionkey = o_orderkey % 8""")
def _(t: Tables) -> DataFrame:
    """Every case with all thirteen blocks and all columns."""
    stays, adt, types = label_tables(t)
    k, pat = F.col("LogID"), F.col("PAT_ID")
    cases = stays.withColumns({
        "PAT_MRN_ID": F.concat(F.lit("M"), pat.cast("string")), "BirthDate": F.date_add(F.lit("1940-01-01").cast("date"), (pat % 4000).cast("int")),
        "SEX_C": (k % 3).cast("int"), "PAT_TYPE_C": (k % 6).cast("int"), "ACCT_BASECLS_HA_C": (k % 4).cast("int"), "ASA_RATE_C": (k % 7).cast("int"),
        "HSP_ACCOUNT_ID": k, "PrimaryCPT": F.concat(F.lit("C"), (pat % 90).cast("string"))})
    room = C.room_anchor(cases.select("LogID", "PAT_ID", "SurgeryDate"), room_times(t))
    anchors = cases.select("LogID", "PAT_ID", F.col("SurgeryDate").cast("timestamp").alias("__at"))

    o = F.col("o_orderkey")
    inches = F.when(o % 17 == 0, "n/a").otherwise(F.when(o % 19 == 0, 0).otherwise(50 + o % 30).cast("string"))
    encounters = t.orders.select(o.alias("EncounterCSN"), inches.alias("HEIGHT"), F.when(o % 13 > 0, (1500 + o % 3000).cast("string")).alias("WEIGHT"))
    ends = t.orders.select(o.alias("EncounterCSN"), (o % 8).alias("DISCH_DISP_C"))
    dispositions = t.region.select(F.col("r_regionkey").cast("long").alias("DISCH_DISP_C"), F.col("r_name").alias("NAME"))
    records = t.orders.where(o % 4 < 3).select(
        F.col("o_custkey").alias("PAT_ID"), F.col("o_orderdate").alias("RECORD_DATE"), F.col("o_orderpriority").alias("AN_TYPE"),
        F.when(o % 5 > 0, (o % 5).cast("int")).alias("ASA_SCORE_C"), (o % 40 == 0).cast("int").alias("CARDIAC_ARREST"),
        ((o % 50 == 1).cast("int") * 2).alias("CABG_STROKE"), F.when(o % 3 > 0, (o % 60 == 2).cast("int")).alias("REINTUBATION"))
    keys = t.orders.select(o.alias("l_orderkey"), F.col("o_custkey").alias("PAT_ID"))
    component = F.element_at(F.array(*map(F.lit, _LAB_IDS)), (F.col("l_partkey") % 24 + 1).cast("int"))
    results = t.lineitem.join(keys, "l_orderkey").select("PAT_ID", component.alias("COMPONENT_ID"), F.when(F.col("l_linenumber") == 5, "pending").otherwise(
        F.col("l_quantity").cast("int").cast("string")).alias("ORD_VALUE"), F.col("l_shipdate").alias("RESULT_TIME"))
    _, problems, visits = (d if "code" not in d.columns else d.replace({"B20": "Z99.11"}, subset=["code"]) for d in history_tables(t))
    third = o % 3
    contacts = t.orders.groupBy(F.col("o_custkey").alias("PAT_ID"), shift(F.col("o_orderdate"), "day", -100).alias("CONTACT_DATE")).agg(
        F.max(F.when(third == 0, 1).when(third == 1, 4).otherwise(5)).alias("TOBACCO_USER_C"))
    contacts = contacts.withColumn("SMOKING_QUIT_DATE", shift(F.col("CONTACT_DATE"), "day", -200))
    codes = t.lineitem.select(F.col("l_orderkey").alias("HSP_ACCOUNT_ID"), code().alias("code")).replace({"K72": "Z59.6"}, subset=["code"])
    wide = C.bulk_features(cases, {
        "room": room.select("LogID", "CutToClose"), "procedures": procedures(t), "vitals": C.encounter_vitals(cases, encounters),
        "discharge": C.discharge_info(cases, ends, dispositions), "anesthesia": C.anesthesia_block(cases, records), "labs": C.latest_labs(room, results),
        "dx": C.comorbidity_flags(C.dx_history(anchors, problems, visits)), "meds": C.medication_flags(anchors, medication_table(t)),
        "smoking": C.smoking_status(anchors, contacts), "transfusion": transfusions(t),
        "label": C.readmission_label(stays, adt, types).drop("ReadmittedWithin30Days"), "demographics": people(t), "social": C.social_flags(cases, codes)})
    doubles = {c: F.col(c).cast("double") for c in ("AgeYears", *fixed.LAB_COMPONENTS)}
    return wide.withColumns(doubles | {"BMI": r6("BMI"), "SurgeryDate": day("SurgeryDate")})


# ---- referral: prior orders are clinic visits, suppliers are providers ----
_REFERRAL_SQL = """v AS (SELECT o_custkey AS pat, o_orderkey AS csn, o_orderdate AS d, o_orderkey % 100 AS prov, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 130 END AS ref
  FROM orders WHERE o_orderkey % 6 IN (0, 1, 3)),
c AS (SELECT o_orderkey AS log, o_custkey AS pat, o_orderkey % 50 AS surg, o_orderdate AS d FROM orders),
s AS (SELECT c.log, c.d AS sd, v.*, row_number() OVER (PARTITION BY c.log ORDER BY v.d, v.csn) AS a, row_number() OVER (PARTITION BY c.log ORDER BY v.d DESC, v.csn DESC) AS z
  FROM c JOIN v ON v.pat = c.pat AND v.d >= c.d - INTERVAL 90 DAY AND v.d < c.d),
g AS (SELECT log, count(DISTINCT csn) AS n, date_diff('day', min(d), max(sd)) AS days, max(CASE WHEN a = 1 THEN prov END) AS first, max(CASE WHEN z = 1 THEN ref END) AS ref FROM s GROUP BY 1),
r AS (SELECT c.log, max(o.o_orderkey % 5) AS typ FROM c JOIN orders o ON o.o_custkey = c.pat AND o.o_orderstatus = 'P' AND o.o_orderdate >= c.d - INTERVAL 90 DAY AND o.o_orderdate < c.d GROUP BY 1)"""


@query("c15_referral_patterns", f"""
WITH {_REFERRAL_SQL} SELECT c.log AS "LogID", g.ref AS "ReferringProvID", n_name AS "ReferringProvSpecialty",
 CASE WHEN g.ref IS NULL THEN 'Unknown' WHEN g.ref = c.pat THEN 'Self' WHEN s_suppkey IS NOT NULL THEN 'Internal' ELSE 'External' END AS "ReferralSource",
 coalesce(g.n, 0) AS n_preop_surg_clinic_visits_90d, days::INT AS days_first_surg_clinic_to_surgery, g.first AS "FirstSurgeryConsultProvID",
 CASE WHEN g.first IS NOT NULL THEN (g.first <> c.surg)::INT END AS within_service_handoff, (r.log IS NOT NULL)::INT AS "HasEpicReferralRecord", r.typ AS "EpicReferralTypeCode"
FROM c LEFT JOIN g ON g.log = c.log LEFT JOIN r ON r.log = c.log LEFT JOIN supplier ON s_suppkey = g.ref LEFT JOIN nation ON n_nationkey = s_nationkey""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    cases = t.orders.select(k.alias("LogID"), F.col("o_custkey").alias("PAT_ID"), (k % 50).alias("PrimarySurgID"), F.to_date(
        "o_orderdate").alias("SurgeryDate"))
    visits = t.orders.select(F.col("o_custkey").alias("PAT_ID"), k.alias("ClinicCSN"), F.to_date("o_orderdate").alias("VisitDate"), (
        k % 100).alias("VisitProvID"), F.when(k % 4 != 0, k % 130).alias("ReferringProvID"), (k % 6).cast("int").alias("DEPARTMENT_ID"))
    # Departments 0..24 carry the nation names as specialty; 100 + n mark the three surgical ones.
    names = t.nation.select(F.col("n_nationkey").alias("DEPARTMENT_ID"), F.col("n_name").alias("SPECIALTY"))
    label = F.when(F.col("DEPARTMENT_ID") == 0, "SURG A").when(F.col("DEPARTMENT_ID") == 1, "Urology").when(
        F.col("DEPARTMENT_ID") == 3, "HAND SURGERY").otherwise(F.col("SPECIALTY"))
    surgical = names.withColumn("SPECIALTY", label)
    homes = names.withColumn("DEPARTMENT_ID", F.col("DEPARTMENT_ID") + 100)
    providers = t.supplier.select(F.col("s_suppkey").alias("PROV_ID"), F.lit("P").alias("PROV_TYPE"), (
        F.col("s_nationkey") + 100).alias("PRIMARY_DEPT_ID"))
    referrals = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("PAT_ID"), k.alias("REFERRAL_ID"), (
        k % 5).alias("REFERRAL_TYPE_C"), F.to_date("o_orderdate").alias("ENTRY_DATE"))
    got = C.referral_patterns(cases, visits, surgical.unionByName(homes), providers, referrals)
    return got.select("LogID", "ReferringProvID", "ReferringProvSpecialty", "ReferralSource", "n_preop_surg_clinic_visits_90d",
                      "days_first_surg_clinic_to_surgery", "FirstSurgeryConsultProvID", "within_service_handoff",
                      "HasEpicReferralRecord", "EpicReferralTypeCode")


# ---- trajectories ----
def trajectory(t: Tables) -> DataFrame:
    """Users are patients with one case at day 15; stays with key % 3 = 0 know their admission and discharge."""
    anchor = F.lit("2024-01-15").cast("timestamp")
    k = F.col("user_id")
    cases = t.events.select("user_id").distinct().select(
        k.alias("LogID"), k.alias("PAT_ID"), F.to_date(anchor).alias("SurgeryDate"), F.when(k % 3 == 0, shift(anchor, "day", -5)).alias(
            "AdmTime"), F.when(k % 3 == 0, shift(anchor, "day", 6)).alias("DischTime"))
    adt = t.events.select(
        k.alias("PAT_ID"), (k * 100 + F.col("event_id") % 3).alias("PAT_ENC_CSN_ID"), (F.col("event_id") % 25).cast("int").alias(
            "DEPARTMENT_ID"), F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(
            F.col("event_type") == "view", 3).otherwise(4).alias("EVENT_TYPE_C"), F.when(F.col("event_id") % 7 == 0, 2).when(
            F.col("event_id") % 7 < 6, 1).alias("EVENT_SUBTYPE_C"), F.col("ts").alias("EFFECTIVE_TIME"), F.col("event_id").alias("EVENT_ID"))
    departments = t.nation.select(F.col("n_nationkey").alias("DEPARTMENT_ID"), F.col("n_name").alias("DEPARTMENT_NAME"))
    lookup = unit_lookup(t).select(F.col("k").alias("Clarity_ID"), F.col("name").alias("UnitType"), F.col("kind").alias("GNNUnitType"),
                                   F.col("s").alias("StartDate"), F.col("e").alias("EndDate"))
    return C.unit_trajectory(cases, adt, departments, lookup)


@query("c16_unit_trajectory", """
WITH adt AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS et, event_id % 7 AS m FROM events),
x AS (SELECT user_id, event_id, et, ts, (event_id % 25)::INT AS dep FROM adt WHERE et IN (1, 2, 3) AND m BETWEEN 1 AND 5
  AND ts >= CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-10' ELSE TIMESTAMP '2024-01-12' END
  AND ts <= CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-01-21' ELSE TIMESTAMP '2024-02-14' END),
w AS (SELECT *, lead(ts) OVER o AS nxt, row_number() OVER o AS seq FROM x WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS "LogID", user_id * 100 + event_id % 3 AS "EncounterCSN", dep AS "DepartmentID", n_name AS "DepartmentName",
 CASE WHEN dep < 20 THEN CASE dep % 3 WHEN 0 THEN 'ED' WHEN 1 THEN 'ICU' ELSE 'Med/Surg' END ELSE 'Other' END AS "UnitType",
 CASE WHEN dep < 20 THEN 'UNIT ' || dep || ' B' END AS "InstitutionType", epoch_us(ts) AS in_us, epoch_us(nxt) AS out_us,
 round(date_diff('minute', ts, nxt) / 60::DOUBLE, 6) AS "Hours", seq AS "SeqInEncounter" FROM w JOIN nation ON n_nationkey = dep WHERE et <> 2""")
def _(t: Tables) -> DataFrame:
    return trajectory(t).select("LogID", "EncounterCSN", "DepartmentID", "DepartmentName", "UnitType", "InstitutionType",
                                F.unix_micros("InTime").alias("in_us"), F.unix_micros("OutTime").alias("out_us"),
                                r6("Hours").alias("Hours"), "SeqInEncounter")


@query("c17_provider_nodes", """
WITH e AS (SELECT DISTINCT l_suppkey AS k FROM lineitem UNION SELECT l_suppkey + 1 FROM lineitem WHERE l_linenumber % 4 = 0),
v AS (SELECT l_suppkey AS k, count(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '1999-08-01' THEN o_orderkey END) AS v2, count(DISTINCT o_orderkey) AS v5
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT s_suppkey::VARCHAR AS "ProvID", s_name, coalesce(v2, 0) AS "CaseVolume2yr", coalesce(v5, 0) AS "CaseVolume5yr" FROM supplier JOIN e ON e.k = s_suppkey LEFT JOIN v ON v.k = s_suppkey""")
def _(t: Tables) -> DataFrame:
    providers = t.supplier.select(F.col("s_suppkey").cast("string").alias("ProvID"), "s_name")
    cases = t.orders.select(F.col("o_orderkey").alias("LOG_ID"), F.col("o_orderdate").alias("SURGERY_DATE"))
    team = t.lineitem.select(F.col("l_orderkey").alias("LOG_ID"), F.col("l_suppkey").cast("string").alias("ProvID"))
    return C.provider_nodes(edge_sources(t), providers, cases, team, F.lit("2001-08-01").cast("timestamp"))


@query("c17_unit_nodes", """
SELECT n_nationkey AS "DEPARTMENT_ID", n_name, CASE WHEN n_nationkey < 20 THEN CASE n_nationkey % 3 WHEN 0 THEN 'ED' WHEN 1 THEN 'ICU' ELSE 'Med/Surg' END ELSE 'Other' END AS "UnitType",
 CASE WHEN n_nationkey < 20 THEN 'UNIT ' || n_nationkey || ' B' END AS "InstitutionType"
FROM nation WHERE n_nationkey IN (SELECT (event_id % 25)::INT FROM events)""")
def _(t: Tables) -> DataFrame:
    seen = t.events.select((F.col("event_id") % 25).cast("int").alias("DepartmentID"))
    departments = t.nation.select(F.col("n_nationkey").alias("DEPARTMENT_ID"), "n_name")
    lookup = unit_lookup(t).select(F.col("k").alias("Clarity_ID"), F.col("name").alias("UnitType"), F.col("kind").alias("GNNUnitType"),
                                   F.col("e").alias("EndDate"))
    return C.unit_nodes(seen, departments, lookup)


@query("c18_patient_case_view", f"""
WITH {FLAGS_SQL}, m AS (SELECT ts, event_id, (event_id % 25)::INT AS dep FROM events WHERE user_id = 42 AND event_type IN ('signup', 'view')),
e AS (SELECT l_suppkey AS k, 'surgical_team' AS src FROM lineitem WHERE l_orderkey = 42 UNION ALL SELECT l_suppkey, 'anesthesia_lead' FROM lineitem WHERE l_orderkey = 42
  UNION ALL SELECT l_suppkey, 'anesthesia_staff' FROM lineitem WHERE l_orderkey = 42)
SELECT 'stay' AS what, CASE WHEN dep % 2 = 0 THEN 'Intensive' ELSE 'Acute' END AS kind, row_number() OVER (ORDER BY ts, event_id) AS n,
 round(date_diff('minute', ts, lead(ts) OVER (ORDER BY ts, event_id)) / 60::DOUBLE, 6) AS hours FROM m
UNION ALL SELECT src, CASE src WHEN 'surgical_team' THEN {SURGICAL_SQL} WHEN 'anesthesia_lead' THEN 'OtherClinician' ELSE {STAFF_SQL} END, count(*), NULL
 FROM e LEFT JOIN f ON f.s_suppkey = e.k GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    k = F.col("user_id")
    cases = t.events.select(k.alias("LogID"), k.alias("PAT_ID"), k.alias("EncounterCSN")).distinct()
    adt = t.events.select(
        k.alias("PAT_ENC_CSN_ID"), F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 3).otherwise(
            2).alias("EVENT_TYPE_C"), F.lit(1).alias("EVENT_SUBTYPE_C"), F.col("ts").alias("EFFECTIVE_TIME"), F.col("event_id").alias(
            "EVENT_ID"), (F.col("event_id") % 25).cast("int").alias("DEPARTMENT_ID"))
    departments = t.nation.select(
        F.col("n_nationkey").alias("DEPARTMENT_ID"), F.upper(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " icu").otherwise(
            ""))).alias("DEPARTMENT_NAME"), F.lit(None).cast("int").alias("ADT_UNIT_TYPE_C"), F.lit(None).cast("int").alias(
            "OR_UNIT_TYPE_C"), F.lit("1").alias("INPATIENT_DEPT_YN"))
    line = t.lineitem.select(F.col("l_orderkey").alias("LogID"), F.col("l_suppkey").alias("ProvID"), F.col("l_linenumber").alias("RoleCode"))
    people = provider_flags(t).withColumn("ProvID", F.col("s_suppkey").cast("string"))
    staff = line.select("LogID", F.col("ProvID").cast("string").alias("ProvList"))
    view = C.patient_case_view(42, cases, line, line.drop("RoleCode"), staff, people, adt, departments)
    stays_n = view["stays"].select(F.lit("stay").alias("what"), F.col("UnitType").alias("kind"), F.col("SeqInEncounter").alias("n"),
                                   r6("Hours").alias("hours"))
    edges_n = view["edges"].groupBy(F.col("RoleSource").alias("what"), F.col("ProviderType").alias("kind")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("hours", F.lit(None).cast("double"))
    return stays_n.unionByName(edges_n)


@query("c20_turnaround_overdue", """
WITH x AS (SELECT l_linestatus, l_returnflag, date_diff('minute', o_orderdate, l_shipdate) AS mi, (l_shipdate > o_orderdate + INTERVAL 30 DAY)::INT AS late
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT coalesce(l_linestatus, '(none)') AS status, l_returnflag, count(*) AS n, round(100.0::DOUBLE * sum(late) / count(*), 6) AS pct_overdue,
 round(quantile_cont(mi::DOUBLE, 0.5), 6) AS med_mi, round(quantile_cont(mi::DOUBLE, 0.95), 6) AS p95_mi FROM x GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    from casetrail.functions.clock import boundaries
    rows = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").join(
        t.lineitem.select("l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus"), "l_orderkey")
    rows = rows.select(F.coalesce("l_linestatus", F.lit("(none)")).alias("status"), "l_returnflag", boundaries(
        "minute", F.col("o_orderdate"), F.col("l_shipdate")).alias("mi"), (F.col("l_shipdate") > shift(
            F.col("o_orderdate"), "day", 30)).cast("int").alias("late"))
    late = rows.groupBy("status", "l_returnflag").agg(r6(R.pct(F.col("late"))).alias("pct_overdue"))
    got = R.turnaround(rows, ["status", "l_returnflag"], ["mi"]).join(late, ["status", "l_returnflag"])
    return rounded(got, "med_mi", "p95_mi")


@query("c20_case_intervals", """
WITH k AS (SELECT l_orderkey, min(l_shipdate) AS recv, max(l_shipdate) AS sign FROM lineitem GROUP BY 1),
x AS (SELECT year(o_orderdate)::INT AS yr, c_nationkey AS code, date_diff('hour', o_orderdate, recv) AS ar, date_diff('hour', recv, sign) AS rs, date_diff('hour', o_orderdate, sign) AS s
  FROM orders LEFT JOIN k ON l_orderkey = o_orderkey LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 11 <> 0) ON c_custkey = o_custkey WHERE sign IS NOT NULL AND o_orderdate IS NOT NULL)
SELECT yr, coalesce(n_name, code::VARCHAR, '(none)') AS unit, count(*) AS n_cases, round(quantile_cont(ar::DOUBLE, 0.5), 6) AS med_acc_to_recv_hrs, round(quantile_cont(ar::DOUBLE, 0.95), 6) AS p95_acc_to_recv_hrs,
 round(quantile_cont(rs::DOUBLE, 0.5), 6) AS med_recv_to_sign_hrs, round(quantile_cont(rs::DOUBLE, 0.95), 6) AS p95_recv_to_sign_hrs, round(quantile_cont(s::DOUBLE, 0.5), 6) AS med_acc_to_sign_hrs,
 round(quantile_cont(s::DOUBLE, 0.95), 6) AS p95_acc_to_sign_hrs FROM x LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = code GROUP BY yr, code, n_name""")
def _(t: Tables) -> DataFrame:
    """Case milestones (order, first and last shipment) by year and unit; some units have no name, some cases no unit."""
    milestones = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("recv"), F.max("l_shipdate").alias("sign"))
    units = t.customer.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("unit"))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("yr")).join(milestones, "o_orderkey", "left").join(units, "o_custkey", "left")
    spans = {"acc_to_recv_hrs": ("hour", "o_orderdate", "recv"), "recv_to_sign_hrs": ("hour", "recv", "sign"), "acc_to_sign_hrs": ("hour", "o_orderdate", "sign")}
    got = C.interval_report(rows, ["yr", "unit"], spans, ["sign", "o_orderdate"], {"unit": (t.nation.where("n_nationkey < 20"), "n_nationkey", "n_name")}, count_as="n_cases")
    return rounded(got, *[f"{q}_{s}" for s in spans for q in ("med", "p95")])


@query("c20_task_intervals", """
WITH x AS (SELECT l_linenumber AS task, l_returnflag AS action, date_diff('minute', o_orderdate, l_shipdate) AS mi FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_linestatus = 'O' AND o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL), z(code, name) AS (VALUES ('A', 'confirmed'), ('R', 'redone'))
SELECT CASE task WHEN 1 THEN 'block' WHEN 2 THEN 'slide' ELSE coalesce(task::VARCHAR, '(none)') END AS task, coalesce(name, action, '(none)') AS action, count(*) AS n_tasks,
 round(quantile_cont(mi::DOUBLE, 0.5), 6) AS med_ord_to_comp_min, round(quantile_cont(mi::DOUBLE, 0.95), 6) AS p95_ord_to_comp_min FROM x LEFT JOIN z ON code = action GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """Tasks that were not taken back, by kind and action, from order to completion in minutes."""
    rows = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").join(t.lineitem.where("l_linestatus = 'O'").select(
        "l_orderkey", "l_shipdate", F.col("l_linenumber").alias("task"), F.col("l_returnflag").alias("action")), "l_orderkey")
    tasks = t.spark.createDataFrame([(1, "block"), (2, "slide")], "code int, name string")
    actions = t.spark.createDataFrame([("A", "confirmed"), ("R", "redone")], "code string, name string")
    got = C.interval_report(rows, ["task", "action"], {"ord_to_comp_min": ("minute", "o_orderdate", "l_shipdate")}, ["o_orderdate", "l_shipdate"],
                            {"task": (tasks, "code", "name"), "action": (actions, "code", "name")}, count_as="n_tasks")
    return rounded(got, "med_ord_to_comp_min", "p95_ord_to_comp_min")


@query("c21_gold_override", """
SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderkey % 4 = 0 THEN (o.o_totalprice > 250000)::INT END, (o.o_orderstatus = 'F')::INT) AS y FROM orders o""")
def _(t: Tables) -> DataFrame:
    base = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    gold = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", (F.col("o_totalprice") > 250000).cast("int").alias("g"))
    return R.gold_override(base, gold, "o_orderkey", "y", "g")


@query("c05_first_unit", f"""
WITH {STAYS_SQL} SELECT user_id, (arg_min(UnitType, SeqInEncounter) = 'ED')::INT AS "is_ED_first" FROM stays GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return C.first_unit_flag(stays(t).withColumn("InstitutionType", F.lit(None).cast("string")), "user_id")


@query("c05_lace_inputs", f"""
WITH {_HISTORY_SQL}, f AS (SELECT log, {_CAT_SQL} AS cat FROM hist), fl AS (SELECT log, {_FLAG_SQL} FROM f GROUP BY 1),
v AS (SELECT cs.log, count(DISTINCT CASE WHEN o.o_orderdate >= cs.tm - INTERVAL 180 DAY AND o.o_orderpriority = '1-URGENT' THEN o.o_orderkey END) AS ed,
  count(DISTINCT CASE WHEN o.o_orderkey <> cs.log THEN o.o_orderkey END) AS ad
  FROM cs LEFT JOIN orders o ON o.o_custkey = cs.pat AND o.o_orderdate < cs.tm AND o.o_orderdate >= cs.tm - INTERVAL 365 DAY GROUP BY 1)
SELECT cs.log AS "LogID", {", ".join(f"coalesce({f}, 0)::INT AS {f}" for _, f, _, _ in fixed.CHARLSON)}, ed AS n_ed_visits_180d, ad AS n_admits_365d
FROM cs LEFT JOIN fl ON fl.log = cs.log JOIN v ON v.log = cs.log""")
def _(t: Tables) -> DataFrame:
    cases, problems, visits = history_tables(t)
    base = cases.select("LogID", "PAT_ID", F.col("LogID").alias("EncounterCSN"), F.to_date("__at").alias("SurgeryDate"))
    stays_ = t.orders.select(F.col("o_custkey").alias("PAT_ID"), F.col("o_orderkey").alias("visit"), F.col("o_orderdate").alias("at"),
                             "o_orderpriority")
    return C.lace_inputs(base, problems, visits, stays_.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority"),
                         stays_.drop("o_orderpriority"))

