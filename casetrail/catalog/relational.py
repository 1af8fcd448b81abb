"""Sources, predicates, joins, set operations and aggregates on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.frames import STAYS_SQL, UNIT_SQL, moves, stays
from casetrail.catalog.registry import Tables, day, query, r6, rounded
from casetrail.functions.clock import boundaries, seconds_between, shift
from casetrail.functions.scalars import code_matches, contains_any, try_code_in, yn
from casetrail.operators import predicates as P
from casetrail.operators import relational as R
from casetrail.operators import temporal as J
from casetrail.operators.ranks import grouped_quantiles
from casetrail.sources import readers


# ---- sources ----
@query("s02_normalize_ids", """
SELECT regexp_replace(trim(' ' || c_custkey::VARCHAR || '.00 '), '\\.0+$', '') AS id, count(*) AS n
FROM customer GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    raw = t.customer.select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".00 ")).alias("LogID"))
    return readers.normalize_ids(raw).groupBy(F.col("LogID").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("s07_rename_present", "SELECT c_custkey AS PAT_ID, c_name AS Gender, c_acctbal FROM customer")
def _(t: Tables) -> DataFrame:
    raw = t.customer.select(F.col("c_custkey").alias("PAT_ID"), F.col("c_name").alias("Sex"), "c_acctbal")
    return readers.rename_present(raw)


UNIT_ROWS = [(n, f"UNIT {n}", ("ED", "ICU", "Med/Surg")[n % 3], s, e) for n in range(0, 20)
             for s, e in (("1990-01-01", "1998-01-01"), ("1998-01-01", "2050-01-01"))]
LOOKUP_SQL = "lookup(k, name, kind, s, e) AS (VALUES " + ", ".join(
    f"({n}, '{name}{' B' if e == '2050-01-01' else ''}', '{kind}', DATE '{s}', DATE '{e}')"
    for n, name, kind, s, e in UNIT_ROWS) + ")"


def unit_lookup(t: Tables) -> DataFrame:
    rows = [(n, name + (" B" if e == "2050-01-01" else ""), kind, s, e) for n, name, kind, s, e in UNIT_ROWS]
    table = readers.inline_table(t.spark, rows, "k int, name string, kind string, s string, e string")
    return table.withColumns({"s": F.to_date("s"), "e": F.to_date("e")})


@query("s08_unit_lookup", f"""
WITH {LOOKUP_SQL} SELECT kind, count(*) AS n FROM nation JOIN lookup ON k = n_nationkey GROUP BY kind""")
def _(t: Tables) -> DataFrame:
    joined = t.nation.join(F.broadcast(unit_lookup(t)), F.col("k") == F.col("n_nationkey"))
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s10_materialize", """
SELECT o_orderstatus, count(*) AS n, min(o_custkey) AS first_customer FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    from casetrail.sources.sinks import materialize
    materialize(t.orders.select("o_orderstatus", "o_custkey"), "case_spine")
    return t.spark.table("case_spine").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("first_customer"))


# ---- predicates ----
@query("p01_cohort_filter", """
SELECT o.o_orderkey::VARCHAR AS LogID, o.o_custkey AS PAT_ID, o.o_custkey * 10 AS EncounterCSN,
       strftime(o.o_orderdate, '%Y-%m-%d') AS SurgeryDate, year(o.o_orderdate)::INT AS SurgeryYear,
       round(date_diff('day', DATE '1970-06-15' + (o.o_custkey % 4000)::INT, o.o_orderdate::DATE) / 365.25, 2)::DOUBLE AS AgeYears
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND o.o_orderstatus = 'F'
  AND (o.o_orderkey % 11 <> 0 OR o.o_orderkey % 2 = 0) AND c.c_nationkey % 5 = 1
  AND year(o.o_orderdate) - year(DATE '1970-06-15' + (o.o_custkey % 4000)::INT) >= 18""")
def _(t: Tables) -> DataFrame:
    o, c = t.orders, t.customer
    cases = o.select(F.col("o_orderkey").alias("LOG_ID"), F.col("o_custkey").alias("PAT_ID"),
                     F.col("o_orderdate").alias("SURGERY_DATE"), F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias(
                         "STATUS_C"), F.lit(None).cast("int").alias("PROC_NOT_PERF_C"), F.col("o_custkey").alias("LOC_ID"))
    # Every second eleventh case has a recorded reason; cases without a detail row must stay.
    details = o.where(F.col("o_orderkey") % 11 == 0).select(
        F.col("o_orderkey").alias("LOG_ID"),
        F.when(F.col("o_orderkey") % 2 == 1, 1).alias("PROC_NOT_DONE_RSN_C"))
    patients = c.select(F.col("c_custkey").alias("PAT_ID"), F.date_add(
        F.lit("1970-06-15").cast("date"), (F.col("c_custkey") % 4000).cast("int")).alias("BIRTH_DATE"))
    links = o.select(F.col("o_orderkey").alias("LOG_ID"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") * 10).alias(
        "OR_LINK_CSN"), (F.col("o_custkey") * 10).alias("PAT_ENC_CSN_ID"))
    sites = c.select(F.col("c_custkey").alias("LOC_ID"), (F.col("c_nationkey") % 5).alias("HOSP_PARENT_LOC_ID"))
    got = P.cohort_filter(cases, details, patients, links, sites, "1996-01-01", "1999-12-31", 1)
    return got.withColumns({"SurgeryDate": day("SurgeryDate"), "AgeYears": F.col("AgeYears").cast("double")})


@query("p02_isin_codes", """
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey IN (1, 5, 9, 44, 103, 977) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return P.isin_codes(t.lineitem, "l_partkey", [1, 5, 9, 44, 103, 977]).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"))


@query("p03_code_matches", """
SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_brand, '^Brand#1[013].*$|^Brand#2.*$') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    hit = code_matches(F.col("p_brand"), "Brand#1[013]%", "Brand#2%")
    return t.part.where(hit).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("p04_contains_any", """
SELECT p_name, count(*) AS n FROM part
WHERE upper(p_name) LIKE '%RING%' OR upper(p_name) LIKE '%WIDGET%' GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.part.where(contains_any(F.upper("p_name"), ["RING", "WIDGET"])).groupBy("p_name").agg(
        F.count(F.lit(1)).alias("n"))


FLAGS_SQL = """f AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '1' END AS crna,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Y' ELSE 'N' END AS res,
  CASE s_suppkey % 4 WHEN 0 THEN 'MD' WHEN 1 THEN 'DO, PhD' WHEN 2 THEN NULL ELSE 'RN' END AS deg,
  CASE s_suppkey % 3 WHEN 0 THEN 22 WHEN 1 THEN 52 END AS prof FROM supplier)"""


def provider_flags(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("s_suppkey"), F.when(k % 7 == 0, "1").alias("EMPLOYED_CRNA_YN"),
        F.when(k % 5 == 0, "Y").otherwise("N").alias("IS_RESIDENT"),
        F.when(k % 4 == 0, "MD").when(k % 4 == 1, "DO, PhD").when(k % 4 == 3, "RN").alias("DOCTORS_DEGREE"),
        F.when(k % 3 == 0, 22).when(k % 3 == 1, 52).alias("MCD_PROF_CD_C"))


SURGICAL_SQL = """CASE WHEN res = 'Y' THEN 'SurgicalTeam' WHEN crna = '1' THEN 'OtherClinician'
  WHEN deg LIKE '%MD%' OR deg LIKE '%DO%' THEN 'SurgicalTeam' WHEN prof = 22 THEN 'Nurse'
  WHEN prof IN (52, 53) THEN 'Technician' ELSE 'Other' END"""
STAFF_SQL = """CASE WHEN crna = '1' THEN 'OtherClinician' WHEN res = 'Y' THEN 'OtherClinician'
  WHEN deg LIKE '%MD%' OR deg LIKE '%DO%' THEN 'OtherClinician' WHEN prof = 22 THEN 'Nurse' ELSE 'OtherClinician' END"""


@query("p05_classify_provider", f"""
WITH {FLAGS_SQL} SELECT s_suppkey, {SURGICAL_SQL} AS surgical, {STAFF_SQL} AS staff FROM f""")
def _(t: Tables) -> DataFrame:
    flags = [F.col(c) for c in ("EMPLOYED_CRNA_YN", "IS_RESIDENT", "DOCTORS_DEGREE", "MCD_PROF_CD_C")]
    return provider_flags(t).select("s_suppkey", P.classify_provider("surgical", *flags).alias("surgical"),
                                    P.classify_provider("anesthesia_staff", *flags).alias("staff"))


@query("p06_classify_unit", """
WITH u AS (SELECT p_partkey, upper(CASE p_partkey % 6 WHEN 0 THEN 'emergency ' WHEN 1 THEN 'micu ' WHEN 2 THEN 'step down '
             WHEN 3 THEN 'telemetry ' ELSE '' END || p_name) AS nm,
           CASE p_size % 9 WHEN 1 THEN 1 WHEN 7 THEN 7 WHEN 0 THEN 0 END AS adt,
           CASE WHEN p_size % 10 < 5 THEN p_size % 10 END AS ort, CASE WHEN p_size % 2 = 0 THEN '1' END AS inp FROM part)
SELECT CASE WHEN adt = 1 OR nm LIKE '%EMERGENCY%' OR nm LIKE '%TRIAGE%' THEN 'ED' WHEN ort IN (1, 2) THEN 'OR'
  WHEN ort IN (3, 4) THEN 'Intermediate' WHEN adt = 7 THEN 'Intensive'
  WHEN nm LIKE '%ICU%' OR nm LIKE '%CCU%' OR nm LIKE '%INTENSIVE%' OR nm LIKE '%CRITICAL%' THEN 'Intensive'
  WHEN nm LIKE '%STEP DOWN%' OR nm LIKE '%STEPDOWN%' OR nm LIKE '%IMU%' OR nm LIKE '%INTERMEDIATE%'
    OR nm LIKE '%TELEMETRY%' THEN 'Intermediate'
  WHEN inp = '1' OR adt = 0 THEN 'Acute' ELSE 'Other' END AS kind, count(*) AS n, sum(p_partkey)::BIGINT AS keys
FROM u GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    word = (F.when(k % 6 == 0, "emergency ").when(k % 6 == 1, "micu ").when(k % 6 == 2, "step down ")
            .when(k % 6 == 3, "telemetry ").otherwise(""))
    kind = P.classify_unit(F.upper(F.concat(word, "p_name")),
                           F.when(size % 9 == 1, 1).when(size % 9 == 7, 7).when(size % 9 == 0, 0),
                           F.when(size % 10 < 5, size % 10), F.when(size % 2 == 0, "1"))
    return t.part.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("p07_not_cancelled", """
WITH e AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 2 WHEN event_id % 4 = 1 THEN 1 END AS sub FROM events)
SELECT 'keep' AS mode, count(*) AS n FROM e WHERE sub IS NULL OR sub <> 2
UNION ALL SELECT 'drop', count(*) FROM e WHERE sub <> 2""")
def _(t: Tables) -> DataFrame:
    sub = F.when(F.col("event_id") % 4 == 0, 2).when(F.col("event_id") % 4 == 1, 1)
    e = t.events.withColumn("sub", sub)
    parts = [e.where(P.not_cancelled(F.col("sub"), keep)).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(mode).alias("mode"), "n") for mode, keep in (("keep", True), ("drop", False))]
    return parts[0].unionByName(parts[1])


@query("p08_try_code_in", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '3041290019' WHEN event_id % 5 = 0 THEN 'x' || event_id::VARCHAR
  ELSE (event_id % 30)::VARCHAR END AS code FROM events)
SELECT code, count(*) AS n FROM e WHERE TRY_CAST(code AS BIGINT) IN (3, 4, 26, 27) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id")
    code = (F.when(k % 3 == 0, "3041290019").when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string")))
            .otherwise((k % 30).cast("string")))
    return t.events.withColumn("code", code).where(try_code_in(F.col("code"), [3, 4, 26, 27])).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))


@query("p09_exclude_labels", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return P.exclude_labels(t.orders, "o_orderpriority", ["5-LOW", "3-MEDIUM"]).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("p10_select_features", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(t: Tables) -> DataFrame:
    return P.select_features(t.orders, ["o_totalprice", "o_orderpriority", "o_orderstatus"], deny=["o_orderstatus"],
                             keep=["o_orderkey"])


@query("p11_yn", """
WITH f AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'Y' WHEN 1 THEN ' yes ' WHEN 2 THEN 'No' WHEN 3 THEN '1' WHEN 4 THEN NULL
  WHEN 5 THEN 'insulin' ELSE '0.0' END AS v FROM orders)
SELECT v, count(*) AS n, max(CASE WHEN upper(trim(v)) IN ('Y', '1', 'TRUE', 'YES') THEN 1 ELSE 0 END)::INT AS flag,
  max(CASE WHEN lower(trim(v)) IN ('yes', 'true', '1') THEN 1 ELSE 0 END)::INT AS yes,
  max(CASE WHEN lower(trim(v)) NOT IN ('no', '0', 'nan', 'none', '', '0.0') THEN 1 ELSE 0 END)::INT AS pos
FROM f GROUP BY v""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 7
    v = (F.when(k == 0, "Y").when(k == 1, " yes ").when(k == 2, "No").when(k == 3, "1").when(k == 5, "insulin")
         .when(k == 6, "0.0"))
    c = F.col("v")
    return t.orders.select(v.alias("v")).groupBy("v").agg(
        F.count(F.lit(1)).alias("n"), F.max(yn(c, "flag")).alias("flag"), F.max(yn(c, "yes")).alias("yes"),
        F.max(yn(c, "not_negative")).alias("pos"))


_LABS_SQL = """labs AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax,
  CASE WHEN l_quantity > 5 THEN l_quantity / 10 END AS alb, l_quantity AS hct, l_discount * 30 AS creat,
  120 + l_quantity AS na, CASE WHEN l_returnflag = 'R' THEN 'Yes' WHEN l_returnflag = 'A' THEN 'No' END AS hf FROM lineitem)"""


def labs(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(q > 5, q / 10).alias("ALB"), q.alias("HCT"), (F.col("l_discount") * 30).alias(
            "Creat"), (120 + q).alias("NA"), F.when(F.col("l_returnflag") == "R", "Yes").when(
            F.col("l_returnflag") == "A", "No").alias("Heart Failure"))


@query("p12_red_flags", f"""
WITH {_LABS_SQL}, f AS (SELECT coalesce((alb < 3.0)::INT, 0) AS a, (hct < 27)::INT AS h, (creat > 2.0)::INT AS c,
  (na < 130 OR na > 150)::INT AS n, CASE WHEN hf = 'Yes' THEN 1 ELSE 0 END AS hf FROM labs)
SELECT sum(a)::BIGINT AS albumin, sum(h)::BIGINT AS hct, sum(c)::BIGINT AS creatinine, sum(n)::BIGINT AS sodium,
  sum(hf)::BIGINT AS heart_failure, sum(greatest(a, h, c, n, hf))::BIGINT AS any_flag FROM f""")
def _(t: Tables) -> DataFrame:
    f = P.red_flags(labs(t))
    names = {"Albumin <3.0 g/dL": "albumin", "Hematocrit <27%": "hct", "Creatinine >2.0 mg/dL": "creatinine",
             "Sodium <130 or >150": "sodium", "Heart failure": "heart_failure", "any_flag": "any_flag"}
    return f.agg(*[F.sum(f"`{c}`").alias(n) for c, n in names.items()])


@query("p13_before_anchor", """
WITH a AS (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.user_id, count(*) AS n, max(e.event_id) AS last_event FROM events e JOIN a USING (user_id)
WHERE e.ts < a.anchor GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    anchors = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("anchor"))
    return J.before_anchor(t.events, anchors, "user_id", "ts", "anchor").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


# ---- joins ----
@query("j01_assemble", """
SELECT c.c_custkey, coalesce(o.n, 0) AS orders, coalesce(s.v, 0) AS urgent FROM customer c
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) o USING (c_custkey)
LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) s
USING (c_custkey)""")
def _(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    blocks = [o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("orders")),
              o.where("o_orderpriority = '1-URGENT'").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("urgent"))]
    return R.assemble(t.customer.select("c_custkey"), "c_custkey", *blocks).na.fill(0)


@query("j02_assemble_frame", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority, (o.o_orderstatus = 'F')::INT AS y FROM orders o""")
def _(t: Tables) -> DataFrame:
    enc = t.orders.select("o_orderkey", "o_custkey")
    feats = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.lit(9).alias("y"))
    labels = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return R.assemble_frame(enc, feats, labels, "o_orderkey", "y")


@query("j03_events_in_window", """
SELECT o.o_orderkey, count(*) AS n, max(l.l_partkey) AS last_part FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
AND l.l_shipdate >= CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderdate ELSE o.o_orderdate - INTERVAL 3 DAY END
AND l.l_shipdate <= CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderdate + INTERVAL 90 DAY ELSE o.o_orderdate + INTERVAL 30 DAY END
GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    admit, leave = F.when(k % 3 == 0, at), F.when(k % 5 == 0, shift(at, "day", 90))
    cases = t.orders.select(k.alias("l_orderkey"), F.coalesce(admit, shift(at, "day", -3)).alias("lo"),
                            F.coalesce(leave, shift(at, "day", 30)).alias("hi"))
    found = J.interval_join(cases, t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate"), ["l_orderkey"], "lo", "hi",
                            "l_shipdate", 30 * 86400)
    return found.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"),
                                                                       F.max("l_partkey").alias("last_part"))


@query("j04_lookback", """
SELECT a.o_orderkey, count(b.o_orderkey) AS prior_365d, count(CASE WHEN b.o_orderpriority = '1-URGENT' THEN 1 END) AS urgent_365d
FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate
AND b.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    events = t.orders.select("o_custkey", "o_orderdate", "o_orderpriority")
    at = F.col("at")
    got = J.window_counts(cases, "o_orderkey", events, ["o_custkey"], shift(at, "day", -365), at, "o_orderdate",
                          {"prior_365d": F.lit(1), "urgent_365d": (F.col("o_orderpriority") == "1-URGENT").cast("int")},
                          chunk_seconds=365 * 86400)
    return got.select("o_orderkey", F.col("prior_365d").cast("long"), F.col("urgent_365d").cast("long"))


@query("j04_lookback_pairs", """
SELECT a.o_orderkey, b.o_orderkey AS prior FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey
AND b.o_orderdate < a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 90 DAY""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    events = t.orders.select("o_custkey", F.col("o_orderkey").alias("prior"), "o_orderdate")
    return J.lookback(cases, events, ["o_custkey"], "at", "o_orderdate", 90, "day").select("o_orderkey", "prior")


@query("j05_followup", """
SELECT a.o_orderkey, min(date_diff('day', a.o_orderdate, b.o_orderdate)) AS days FROM orders a
LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderpriority IN ('1-URGENT', '2-HIGH')
AND b.o_orderdate > a.o_orderdate AND b.o_orderdate < a.o_orderdate + INTERVAL 91 DAY GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at"))
    urgent = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_custkey", "o_orderdate", F.col("o_orderdate").alias("nxt")).distinct()
    got = J.asof(cases, urgent, ["o_custkey"], "at", "o_orderdate", ["nxt"], "forward", strict=True, chunk_seconds=365 * 86400)
    inside = F.col("nxt") < shift(F.col("at"), "day", 91)
    return got.select("o_orderkey", F.when(inside, boundaries("day", F.col("at"), F.col("nxt"))).alias("days"))


@query("j06_scd2_join", f"""
WITH {LOOKUP_SQL} SELECT o.o_orderkey, name, kind FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN lookup ON k = c.c_nationkey AND s <= o.o_orderdate::DATE AND o.o_orderdate::DATE < e""")
def _(t: Tables) -> DataFrame:
    facts = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    facts = facts.select("o_orderkey", "k", F.to_date("o_orderdate").alias("d"))
    return J.scd2_join(facts, unit_lookup(t), "k", "d", "s", "e", ["name", "kind"]).select("o_orderkey", "name", "kind")


@query("j06_scd2_join_large", """
WITH v AS (SELECT o_custkey AS k, o_orderkey AS name, o_orderdate AS s, o_orderdate + to_days((o_orderkey % 400)::INT) AS e FROM orders)
SELECT o.o_orderkey, v.name FROM orders o LEFT JOIN v ON v.k = o.o_custkey AND v.s <= o.o_orderdate AND o.o_orderdate < v.e""")
def _(t: Tables) -> DataFrame:
    """Overlapping versions in a dimension that is never broadcast: every version that holds the time counts."""
    version = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("s"),
                              F.expr("o_orderdate + make_dt_interval(o_orderkey % 400)").alias("e"))
    facts = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"))
    return J.scd2_join(facts, version, "k", "d", "s", "e", ["name"], max_broadcast_rows=0).select("o_orderkey", "name")


@query("j07_scd2_current", f"""
WITH {LOOKUP_SQL} SELECT n_name, name FROM nation LEFT JOIN lookup ON k = n_nationkey AND e = DATE '2050-01-01'""")
def _(t: Tables) -> DataFrame:
    current = J.scd2_current(unit_lookup(t), "e").select("k", "name")
    return t.nation.join(F.broadcast(current), F.col("k") == F.col("n_nationkey"), "left").select("n_name", "name")


@query("j08_same_day_join", """
SELECT o.o_orderkey, count(*) AS lines FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
AND l.l_shipdate::DATE = o.o_orderdate::DATE GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    left = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderdate")
    right = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate")
    return J.same_day_join(left, right, ["k"], "o_orderdate", "l_shipdate").groupBy(F.col("k").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"))


_SIGNUP_SQL = """st AS (SELECT user_id, event_id AS stay, ts AS a, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
  - INTERVAL 1 HOUR, ts + INTERVAL 2 DAY) AS b FROM events WHERE event_type = 'signup')"""


def signup_stays(t: Tables) -> DataFrame:
    from casetrail.operators.ordering import ordered, time_chunk
    s = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("stay"), F.col("ts").alias("a"))
    line = ordered(s, ["user_id"], ["a", "stay"], time_chunk("a"), lead={"nxt": "a"})
    return line.select("user_id", "stay", "a", F.coalesce(shift(F.col("nxt"), "hour", -1), shift(F.col("a"), "day", 2)).alias("b"))


@query("j09_asof_containing", f"""
WITH {_SIGNUP_SQL} SELECT e.event_id, st.stay FROM events e JOIN st ON st.user_id = e.user_id
AND st.a = (SELECT max(x.a) FROM st x WHERE x.user_id = e.user_id AND x.a <= e.ts) WHERE e.ts <= st.b""")
def _(t: Tables) -> DataFrame:
    return J.asof_containing(t.events.select("event_id", "user_id", "ts"), signup_stays(t), ["user_id"], "ts", "a", "b",
                             ["stay"]).select("event_id", "stay")


@query("j10_key_overlap", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
SELECT count(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 END) AS in_both,
 count(CASE WHEN b.k IS NULL THEN 1 END) AS left_only, count(CASE WHEN a.k IS NULL THEN 1 END) AS right_only
FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderstatus = 'F'")
    b = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000")
    return R.key_overlap(a, b, "o_custkey")


@query("j11_restrict_to", """
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    keys = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.restrict_to(t.lineitem, keys, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("j12_first_match", """
SELECT o.o_orderkey, l.l_suppkey FROM orders o LEFT JOIN (SELECT l_orderkey, l_suppkey,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn FROM lineitem) l
 ON l.l_orderkey = o.o_orderkey AND rn = 1""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return R.first_match(cases, t.lineitem, "l_orderkey", [F.asc("l_linenumber"), F.asc("l_suppkey")], ["l_suppkey"]).select(
        F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")


@query("j13_episode_window", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS epi_start,
 strftime(max(CASE WHEN event_type = 'purchase' THEN ts END), '%Y-%m-%d %H:%M:%S') AS epi_end
FROM events WHERE event_id % 4 <> 0 GROUP BY 1 HAVING max(CASE WHEN event_type = 'purchase' THEN ts END) IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    adt = t.events.select("user_id", F.col("ts").alias("EFFECTIVE_TIME"), F.when(
        F.col("event_type") == "purchase", 2).otherwise(1).alias("EVENT_TYPE_C"),
        F.when(F.col("event_id") % 4 == 0, 2).when(F.col("event_id") % 4 == 1, 1).alias("EVENT_SUBTYPE_C"))
    got = R.episode_window(t.events.select("user_id").distinct(), adt, "user_id")
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for c, n in (("EpiStart", "epi_start"), ("EpiEnd", "epi_end"))]
    return got.select("user_id", *text)


@query("j14_milestone_pair", """
SELECT o.o_orderkey, date_diff('minute', a.l_shipdate, b.l_shipdate) AS minutes FROM orders o
LEFT JOIN lineitem a ON a.l_orderkey = o.o_orderkey AND a.l_linenumber = 1
LEFT JOIN lineitem b ON b.l_orderkey = o.o_orderkey AND b.l_linenumber = 3""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    got = R.milestone_pair(cases, t.lineitem, "l_orderkey", "l_linenumber", "l_shipdate", 1, 3)
    return got.select(F.col("l_orderkey").alias("o_orderkey"),
                      boundaries("minute", F.col("StartTime"), F.col("StopTime")).alias("minutes"))


@query("j15_merge_closure", """
WITH e AS (SELECT c_custkey AS s, c_custkey + 1 AS t FROM customer WHERE c_custkey % 7 IN (0, 1, 2)),
i AS (SELECT c_custkey AS id FROM customer),
f1 AS (SELECT id, t AS r FROM i JOIN e ON s = id), b1 AS (SELECT id, s AS r FROM i JOIN e ON t = id)
SELECT id, id AS related, 'direct' AS dir FROM i UNION SELECT id, r, 'forward' FROM f1 UNION SELECT id, r, 'backward' FROM b1
UNION SELECT f1.id, e.t, 'forward-2hop' FROM f1 JOIN e ON e.s = f1.r
UNION SELECT b1.id, e.s, 'backward-2hop' FROM b1 JOIN e ON e.t = b1.r""")
def _(t: Tables) -> DataFrame:
    edges = t.customer.select(F.col("c_custkey").alias("s"), F.when(
        F.col("c_custkey") % 7 < 3, F.col("c_custkey") + 1).alias("t"))
    ids = t.customer.select(F.col("c_custkey").alias("id"))
    got = R.merge_closure(ids, edges, "s", "t", "id")
    return got.select("id", F.col("RelatedID").alias("related"), F.col("MergeDir").alias("dir"))


@query("j16_link_records", """
WITH a AS (SELECT o_custkey::VARCHAR AS mrn, o_orderdate::DATE AS dt, min(o_orderkey) AS ka FROM orders
 WHERE o_orderstatus <> 'P' AND o_custkey > 0 GROUP BY 1, 2),
b AS (SELECT o_custkey::VARCHAR AS mrn, o_orderdate::DATE AS dt, min(o_orderkey) AS kb FROM orders
 WHERE o_orderpriority <> '5-LOW' AND o_custkey > 0 GROUP BY 1, 2)
SELECT mrn, strftime(dt, '%Y-%m-%d') AS dt, ka, kb FROM a JOIN b USING (mrn, dt)""")
def _(t: Tables) -> DataFrame:
    from casetrail.functions.scalars import matching_id
    base = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("dt"), matching_id(
        F.concat(F.lit("00"), F.col("o_custkey").cast("string"))).alias("mrn"), "o_orderstatus", "o_orderpriority")
    a = base.where("o_orderstatus <> 'P'").select("mrn", "dt", F.col("o_orderkey").alias("k"))
    b = base.where("o_orderpriority <> '5-LOW'").select("mrn", "dt", F.col("o_orderkey").alias("k"))
    got = R.link_records(a, b, ["mrn", "dt"], [F.asc("k")], [F.asc("k")])
    return got.select("mrn", day("dt").alias("dt"), F.col("k__a").alias("ka"), F.col("k__b").alias("kb"))


@query("j17_decode", """
SELECT coalesce(r.r_name, x.code::VARCHAR, '(none)') AS region, count(*) AS n FROM
(SELECT CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey % 8 END AS code FROM customer) x
LEFT JOIN region r ON r.r_regionkey = x.code GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    coded = t.customer.select(F.when(F.col("c_nationkey") != 7, F.col("c_nationkey") % 8).alias("code"))
    return R.decode(coded, t.region, "code", "r_regionkey", "r_name", "region").groupBy("region").agg(
        F.count(F.lit(1)).alias("n"))


@query("j18_remap", """
SELECT c.c_custkey, coalesce(n.n_name, c.c_mktsegment) AS label FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey < 10""")
def _(t: Tables) -> DataFrame:
    dim = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("id"), "n_name")
    cases = t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("label"))
    return R.remap(cases, dim, "c_nationkey", "id", "n_name", "label", []).select("c_custkey", "label")


# ---- aggregates ----
@query("a01_group_aggregates", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
 round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a02_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS cases FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("cases"))


@query("a03_conditional_distinct", """
SELECT l_suppkey, count(DISTINCT CASE WHEN l_linenumber > 1 THEN l_partkey END) AS other,
 count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_distinct(F.when(F.col("l_linenumber") > 1, F.col("l_partkey"))).alias("other"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))


@query("a04_flag_pivot", """
SELECT l_orderkey, max(CASE WHEN p_brand LIKE 'Brand#1%' THEN 1 ELSE 0 END)::INT AS b1,
 max(CASE WHEN regexp_matches(p_brand, '^Brand#2[0-3]') THEN 1 ELSE 0 END)::INT AS b2,
 max(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END)::INT AS promo
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.part, "p_partkey")
    return R.flag_pivot(rows, ["l_orderkey"], {
        "b1": code_matches(F.col("p_brand"), "Brand#1%"), "b2": F.col("p_brand").rlike("^Brand#2[0-3]"),
        "promo": F.col("p_type") == "PROMO"})


@query("a05_value_pivot", """
SELECT l_orderkey, max(CASE WHEN l_returnflag IN ('A') THEN l_quantity::INT::VARCHAR END) AS a,
 max(CASE WHEN l_returnflag IN ('N', 'R') THEN l_quantity::INT::VARCHAR END) AS nr FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("v", F.col("l_quantity").cast("int").cast("string"))
    return R.value_pivot(rows, ["l_orderkey"], "l_returnflag", "v", {"a": ["A"], "nr": ["N", "R"]})


@query("a07_pct", """
SELECT l_linestatus, round(100.0::DOUBLE * sum((l_returnflag = 'R')::INT) / nullif(count(*), 0), 6) AS pct_returned
FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").agg(r6(R.pct((F.col("l_returnflag") == "R").cast("int"))).alias("pct_returned"))


@query("a08_turnaround", """
SELECT year(o_orderdate)::INT AS yr, l_returnflag, count(*) AS n,
 round(quantile_cont(date_diff('hour', o_orderdate, l_shipdate)::DOUBLE, 0.5), 6) AS med_hours,
 round(quantile_cont(date_diff('hour', o_orderdate, l_shipdate)::DOUBLE, 0.95), 6) AS p95_hours
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").join(
        t.lineitem.select("l_orderkey", "l_returnflag", "l_shipdate"), "l_orderkey")
    rows = rows.select(F.year("o_orderdate").alias("yr"), "l_returnflag",
                       boundaries("hour", F.col("o_orderdate"), F.col("l_shipdate")).alias("hours"))
    return rounded(R.turnaround(rows, ["yr", "l_returnflag"], ["hours"]), "med_hours", "p95_hours")


@query("a10_pivot_count", """
SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS click, count(CASE WHEN event_type = 'view' THEN 1 END) AS view,
 count(CASE WHEN event_type = 'error' THEN 1 END) AS error FROM events GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return R.pivot_count(t.events, "user_id", "event_type", ["click", "view", "error"])


@query("a11_pivot_share", f"""
WITH s AS (SELECT user_id, {UNIT_SQL} AS u FROM events WHERE {UNIT_SQL} IN ('ED', 'OR'))
SELECT user_id, round(count(CASE WHEN u = 'ED' THEN 1 END) / count(*)::DOUBLE, 6) AS "ED",
 round(count(CASE WHEN u = 'OR' THEN 1 END) / count(*)::DOUBLE, 6) AS "OR" FROM s GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = moves(t).where(F.col("UnitType").isin("ED", "OR"))
    return rounded(R.pivot_share(rows, "user_id", "UnitType", ["ED", "OR"]), "ED", "OR")


@query("a12_stay_summary", f"""
WITH {STAYS_SQL} SELECT user_id, count(CASE WHEN UnitType = 'Acute' THEN 1 END) AS acute_count,
 round(sum(CASE WHEN UnitType = 'Acute' THEN Hours ELSE 0 END), 6) AS acute_hours,
 count(CASE WHEN UnitType = 'Intensive' THEN 1 END) AS intensive_count,
 round(sum(CASE WHEN UnitType = 'Intensive' THEN Hours ELSE 0 END), 6) AS intensive_hours,
 count(CASE WHEN UnitType = 'Other' THEN 1 END) AS intermediate_count,
 round(sum(CASE WHEN UnitType = 'Other' THEN Hours ELSE 0 END), 6) AS intermediate_hours,
 count(*) AS total_count, round(sum(Hours), 6) AS total_hours FROM stays WHERE OutTime IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    got = R.stay_summary(stays(t).where(F.col("OutTime").isNotNull()), "user_id")
    return rounded(got, "acute_hours", "intensive_hours", "intermediate_hours", "total_hours")


@query("a13_los", f"""
WITH {STAYS_SQL} SELECT user_id, round((epoch_us(max(OutTime)) - epoch_us(min(InTime))) / 1000000.0 / 86400, 6) AS los_days
FROM stays GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(R.length_of_stay(stays(t), "user_id"), "los_days")


@query("a14_prolonged_stay", """
WITH l AS (SELECT o_custkey, date_diff('day', min(o_orderdate), max(o_orderdate))::DOUBLE AS los_days FROM orders GROUP BY 1)
SELECT o_custkey, los_days, (los_days > (SELECT quantile_cont(los_days, 0.75) FROM l))::INT AS plos FROM l""")
def _(t: Tables) -> DataFrame:
    span = t.orders.groupBy("o_custkey").agg((seconds_between(F.min("o_orderdate"), F.max("o_orderdate")) / 86400.0).alias(
        "los_days"))
    return R.prolonged_stay(span)


def team_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges order-supplier, supplier attributes, orders with their first line's supplier (some unknown)."""
    edges = t.lineitem.select(F.col("l_orderkey").alias("LogID"), F.col("l_suppkey").alias("ProvID"))
    k = F.col("s_suppkey")
    people = t.supplier.select(
        k.alias("ProvID"), F.when(k % 5 == 0, "Y").otherwise("N").alias("IsResident"),
        F.when(k % 7 == 0, "1").otherwise("0").alias("EmployedCRNA"), F.when(k % 3 == 0, "yes").alias("IsHospitalist"),
        (k % 50).alias("CaseVolume2yr"), (k % 90).alias("CaseVolume5yr"))
    cases = t.orders.select(F.col("o_orderkey").alias("LogID"), (F.col("o_custkey") % 120).alias("PrimarySurgID"))
    return edges, people, cases


@query("a15_team_features", """
WITH p AS (SELECT s_suppkey, (s_suppkey % 5 = 0)::INT AS r, (s_suppkey % 7 = 0)::INT AS c, (s_suppkey % 3 = 0)::INT AS h,
  s_suppkey % 50 AS v2, s_suppkey % 90 AS v5 FROM supplier),
e AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
m AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS ts, sum(r)::BIGINT AS nr, sum(c)::BIGINT AS nc, sum(h)::BIGINT AS nh
  FROM e LEFT JOIN p ON s_suppkey = l_suppkey GROUP BY 1)
SELECT o.o_orderkey::VARCHAR AS "LogID", coalesce(ts, 0) AS team_size, coalesce(nr, 0) AS n_residents, coalesce(nc, 0) AS n_crna,
 coalesce(nh, 0) AS n_hospitalists, coalesce((nr > 0)::INT, 0) AS has_resident, coalesce((nc > 0)::INT, 0) AS has_crna,
 coalesce((nh > 0)::INT, 0) AS has_hospitalist, coalesce(v2, 0)::DOUBLE AS surg_casevol_2yr,
 coalesce(v5, 0)::DOUBLE AS surg_casevol_5yr, (s_suppkey IS NULL)::INT AS surg_vol_unmatched
FROM orders o LEFT JOIN m ON m.l_orderkey = o.o_orderkey LEFT JOIN p ON s_suppkey = o.o_custkey % 120""")
def _(t: Tables) -> DataFrame:
    return R.team_features(*team_tables(t))


@query("a16_case_volume", """
SELECT l_suppkey AS "ProvID", count(DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 2 YEAR
 THEN o_orderkey END) AS "CaseVolume2yr", count(DISTINCT o_orderkey) AS "CaseVolume5yr"
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("LOG_ID"), F.col("o_orderdate").alias("SURGERY_DATE"))
    team = t.lineitem.select(F.col("l_orderkey").alias("LOG_ID"), F.col("l_suppkey").alias("ProvID"))
    return R.case_volume(cases, team, F.lit("2001-08-01").cast("timestamp"))


@query("a17_entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS p FROM c)
SELECT user_id, round(-sum(p * ln(p + 1e-9)), 6) AS entropy FROM s GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(R.entropy(t.events, "user_id", "event_type"), "entropy")


@query("a18_keyword_fraction", """
SELECT l_orderkey, round(count(DISTINCT CASE WHEN regexp_matches(lower(p_name), 'ring|pt|ot') THEN p_name END)
 / greatest(count(DISTINCT p_name), 1)::DOUBLE, 6) AS fraction FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.part, "p_partkey")
    hit = contains_any(F.col("p_name"), ["ring", "PT", "OT"], ignore_case=True)
    return rounded(R.keyword_fraction(rows, "l_orderkey", "p_name", hit), "fraction")


@query("a19_cluster_profile", """
SELECT o_orderpriority, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 6) AS pct,
 round(quantile_cont(o_totalprice, 0.5), 6) AS med_o_totalprice, round(100.0::DOUBLE * avg((o_orderstatus = 'F')::INT), 6) AS filled,
 round(100.0::DOUBLE * avg((o_totalprice >= 250000)::INT), 6) AS large FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    got = R.cluster_profile(t.orders, "o_orderpriority", ["o_totalprice"], {
        "filled": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") >= 250000})
    return rounded(got, "pct", "med_o_totalprice", "filled", "large")


@query("a20_weighted_vector_mean", """
WITH v AS (SELECT vec_id % 40 AS k, 1 + vec_id % 3 AS w, embedding AS e FROM embeddings)
SELECT k, """ + ", ".join(f"round(sum(e[{i + 1}]::DOUBLE * w) / sum(w), 6) AS emb_{i}" for i in range(64)) + " FROM v GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.graph import pool_embeddings, vector_columns
    vectors = vector_columns(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    links = t.embeddings.select("vec_id", (F.col("vec_id") % 40).alias("k"), (1 + F.col("vec_id") % 3).alias("w"))
    return rounded(pool_embeddings(links, vectors, "k", "vec_id", [f"emb_{i}" for i in range(64)], "w"), *[f"emb_{i}" for i in range(64)])


# ---- set operations ----
def edge_sources(t: Tables) -> DataFrame:
    line = t.lineitem.select(F.col("l_orderkey").cast("string").alias("LogID"), "l_suppkey", "l_linenumber")
    surgical = line.where("l_linenumber % 4 IN (1, 2)").select("LogID", F.col("l_suppkey").alias("ProvID"),
                                                      F.col("l_linenumber").alias("RoleCode"))
    leads = line.where("l_linenumber % 4 = 3").select("LogID", F.col("l_suppkey").alias("ProvID"))
    staff = line.where("l_linenumber % 4 = 0").select("LogID", F.concat(
        F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(";; "), (F.col("l_suppkey") + 1).cast("string"), F.lit(";")).alias(
        "ProvList"))
    people = provider_flags(t).withColumn("ProvID", F.col("s_suppkey").cast("string"))
    return R.provider_edges(surgical, leads, staff, people)


@query("u01_provider_edges", f"""
WITH {FLAGS_SQL}, s AS (SELECT l_orderkey::VARCHAR AS log, l_suppkey AS k, l_linenumber AS role, 'surgical_team' AS src FROM lineitem
  WHERE l_linenumber % 4 IN (1, 2) UNION ALL SELECT l_orderkey::VARCHAR, l_suppkey, NULL, 'anesthesia_lead' FROM lineitem WHERE l_linenumber % 4 = 3
  UNION ALL SELECT l_orderkey::VARCHAR, l_suppkey, NULL, 'anesthesia_staff' FROM lineitem WHERE l_linenumber % 4 = 0
  UNION ALL SELECT l_orderkey::VARCHAR, l_suppkey + 1, NULL, 'anesthesia_staff' FROM lineitem WHERE l_linenumber % 4 = 0)
SELECT log AS "LogID", k::VARCHAR AS "ProvID", role AS "RoleCode", src AS "RoleSource", CASE WHEN src = 'surgical_team' THEN
 {SURGICAL_SQL} WHEN src = 'anesthesia_lead' THEN 'OtherClinician' ELSE {STAFF_SQL} END AS "ProviderType"
FROM s LEFT JOIN f ON f.s_suppkey = s.k""")
def _(t: Tables) -> DataFrame:
    return edge_sources(t)


@query("u02_union_distinct", """
SELECT o_custkey AS k, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F' UNION
SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 400000""")
def _(t: Tables) -> DataFrame:
    cols = [F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("code")]
    return R.union_distinct(t.orders.where("o_orderstatus = 'F'").select(*cols),
                            t.orders.where("o_totalprice > 400000").select(*cols))


@query("u03_order_stream", """
WITH s AS (SELECT user_id, min(ts) AS a, min(ts) + INTERVAL 10 DAY AS b FROM events GROUP BY 1)
SELECT e.user_id, CASE WHEN event_type IN ('click', 'view') THEN 'MED' ELSE 'PROC' END AS src,
 CASE WHEN event_type IN ('click', 'view') THEN 'MED:' ELSE 'PROC:' END || CASE WHEN event_type = 'error' THEN 'Other' ELSE event_type END AS grp,
 count(*) AS n FROM events e JOIN s ON s.user_id = e.user_id AND e.ts BETWEEN s.a AND s.b GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("PAT_ID"), F.col("ts").alias("OrderTime"), "event_type", F.when(
        F.col("event_type") != "error", F.col("event_type")).alias("GroupName"))
    scope = t.events.groupBy(F.col("user_id").alias("PAT_ID")).agg(F.min("ts").alias("EpiStart")).withColumn(
        "EpiEnd", shift(F.col("EpiStart"), "day", 10)).withColumn("LogID", F.col("PAT_ID"))
    med = F.col("event_type").isin("click", "view")
    got = R.order_stream(scope, e.where(~med).drop("event_type"), e.where(med).drop("event_type"))
    return got.groupBy(F.col("LogID").alias("user_id"), F.col("OrderSource").alias("src"), F.col("OrderGroup").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"))


@query("u04_timeline", """
WITH m AS (SELECT o_orderkey AS k, o_orderdate AS ordered, o_orderdate + INTERVAL 2 DAY AS received,
 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 5 DAY END AS signed FROM orders)
SELECT k, 'Case' AS source, ev, strftime(tm, '%Y-%m-%d') AS tm FROM (SELECT k, 'Ordered' AS ev, ordered AS tm FROM m UNION ALL
 SELECT k, 'Received', received FROM m UNION ALL SELECT k, 'Sign-out', signed FROM m) WHERE tm IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    m = t.orders.select(F.col("o_orderkey").alias("k"), at.alias("ordered"), shift(at, "day", 2).alias("received"),
                        F.when(F.col("o_orderstatus") == "F", shift(at, "day", 5)).alias("signed"))
    got = R.timeline(m, "k", "Case", {"Ordered": "ordered", "Received": "received", "Sign-out": "signed"})
    return got.select("k", F.col("Source").alias("source"), F.col("EventName").alias("ev"), day("EventTime").alias("tm"))


@query("u05_dedupe", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
 ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return R.dedupe(t.orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@query("u06_set_difference", """
SELECT 'both' AS side, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT
 SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'only' AS side, k FROM
 (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_custkey").alias("k")
    a, b = (t.orders.where(F.col("o_orderstatus") == s).select(k).distinct() for s in "FP")
    both = a.join(b, "k", "left_semi").select(F.lit("both").alias("side"), "k")
    return both.unionByName(a.join(b, "k", "left_anti").select(F.lit("only").alias("side"), "k"))


@query("u05_split_list", """
SELECT trim(x) AS v, count(*) AS n FROM (SELECT unnest(string_split(replace(p_name, ' ', '; ;'), ';')) AS x FROM part)
WHERE length(trim(x)) > 0 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.part.select(F.replace("p_name", F.lit(" "), F.lit("; ;")).alias("l"))
    return R.split_list(rows, "l", "v").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("a08_quantiles_of_values", """
SELECT o_orderstatus, count(*) AS n, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.75), 6) AS p75
FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    got = grouped_quantiles(t.orders, ["o_orderstatus"], "o_totalprice", {"p10": 0.1, "p75": 0.75}, "n")
    return rounded(got, "p10", "p75")


