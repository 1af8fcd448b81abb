"""Notes and file round trips: text operators on documents and conversations, sources on files written from tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.registry import Tables, query, r6, rounded
from casetrail.functions import fixed
from casetrail.operators import text as X
from casetrail.operators.graph import vector_columns
from casetrail.operators.relational import assemble_text
from casetrail.session import checkpoint_folder
from casetrail.sources import readers, sinks


def scratch(t: Tables, name: str) -> str:
    """New folder for files a query writes, in the shared storage of the cluster."""
    return f"{checkpoint_folder(t.spark)}/casetrail-{uuid.uuid4().hex}/{name}"


# ---- text ----
@query("a09_assemble_text", """
SELECT conv_id, md5(string_agg(text, chr(13) || chr(10) ORDER BY turn)) AS h, count(*) AS n FROM conversations GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    sizes = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    text = assemble_text(t.conversations, ["conv_id"], "turn", "text")
    return text.select("conv_id", F.md5("NoteText").alias("h")).join(sizes, "conv_id")


@query("x01_notes", """
WITH sc AS (SELECT DISTINCT conv_id % 20 AS log, TIMESTAMP '2024-01-05' AS surg, TIMESTAMP '2024-01-02' AS adm, TIMESTAMP '2024-01-20' AS dis FROM conversations),
h AS (SELECT conv_id AS note, conv_id % 20 AS log, CASE conv_id % 5 WHEN 0 THEN '4' WHEN 1 THEN '27' WHEN 2 THEN '1000004' WHEN 3 THEN '3041290019' ELSE 'x' END AS typ,
  TIMESTAMP '2024-01-01' + to_hours((conv_id * 7)::INT) AS created, CASE WHEN conv_id % 7 = 0 THEN 'Y' WHEN conv_id % 7 = 1 THEN 'N' END AS uns FROM (SELECT DISTINCT conv_id FROM conversations)),
ln AS (SELECT conv_id AS note, turn % 2 AS ver, turn AS line, text FROM conversations), mx AS (SELECT note, max(ver) AS ver FROM ln GROUP BY 1),
tx AS (SELECT note, string_agg(text, chr(13) || chr(10) ORDER BY line) AS txt FROM ln JOIN mx USING (note, ver) GROUP BY 1)
SELECT h.note, h.log, typ, date_diff('minute', surg, created) AS after_min, round(date_diff('minute', created, dis) / 60::DOUBLE, 6) AS before_h, md5(txt) AS h
FROM h JOIN sc ON sc.log = h.log AND created BETWEEN adm AND dis LEFT JOIN tx ON tx.note = h.note WHERE TRY_CAST(typ AS BIGINT) IN (1000004, 1000000, 1000012, 3, 4, 27, 26) AND (uns IS NULL OR uns = 'N')""")
def _(t: Tables) -> DataFrame:
    k = F.col("conv_id")

    def at(text: str):
        return F.lit(text).cast("timestamp")
    ids = t.conversations.select("conv_id").distinct()
    scope = ids.select((k % 20).alias("EncounterCSN")).distinct().select(
        F.col("EncounterCSN").alias("LogID"), "EncounterCSN", at("2024-01-05").alias("SurgeryStart"), at("2024-01-02").alias("AdmitTime"),
        at("2024-01-20").alias("DischargeTime"))
    m = k % 5
    headers = ids.select(
        k.alias("NOTE_ID"), (k % 20).alias("EncounterCSN"), F.when(m == 0, "4").when(m == 1, "27").when(m == 2, "1000004").when(
            m == 3, "3041290019").otherwise("x").alias("NoteTypeCode"), F.timestamp_micros(F.unix_micros(at("2024-01-01")) + k * 7 * 3_600_000_000).alias(
            "NoteCreated"), F.when(k % 7 == 0, "Y").when(k % 7 == 1, "N").alias("UNSIGNED_YN"))
    lines = t.conversations.select(k.alias("NOTE_ID"), (F.col("turn") % 2).alias("NOTE_CSN_ID"), F.col("turn").alias("Line"), F.col("text").alias(
        "NOTE_TEXT"))
    got = X.notes(scope, headers, lines)
    return got.select(F.col("NOTE_ID").alias("note"), F.col("LogID").alias("log"), F.col("NoteTypeCode").alias("typ"), F.col(
        "MinutesAfterSurgeryStart").alias("after_min"), r6("HoursBeforeDischarge").alias("before_h"), F.md5("NoteText").alias("h"))


_PLAIN = {"sdoh_a": r"\b(license|licence)\b", "sdoh_b": r"copyright", "med_a": r"\b[a-z]+@[a-z]+", "med_b": r"\b\d{3}\b"}
_PLAIN_SQL = ", ".join(f"max(regexp_matches(text, '{p}', 'i')::INT)::INT AS {n}" for n, p in _PLAIN.items())


@query("x02_regex_flags", f"""
WITH j AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS text FROM documents GROUP BY 1), f AS (SELECT source, {_PLAIN_SQL} FROM j GROUP BY 1) SELECT *, (sdoh_a + sdoh_b)::INT AS sdoh_total, (med_a + med_b)::INT AS med_total, 1 AS has_notes FROM f""")
def _(t: Tables) -> DataFrame:
    return X.regex_flags(t.documents, "source", "text", _PLAIN, order=["doc_id"])


@query("x02_all_patterns", f"""
WITH f AS (SELECT doc_id, {", ".join(f"regexp_matches(text, '{p}', 'i')::INT AS {n}" for n, p in fixed.TEXT_PATTERNS.items())} FROM documents)
SELECT doc_id, {", ".join(fixed.TEXT_PATTERNS)}, ({" + ".join(n for n in fixed.TEXT_PATTERNS if n.startswith("sdoh"))})::INT AS sdoh_total,
 ({" + ".join(n for n in fixed.TEXT_PATTERNS if n.startswith("med"))})::INT AS med_total, 1 AS has_notes FROM f""")
def _(t: Tables) -> DataFrame:
    return X.regex_flags(t.documents, "doc_id", "text")


@query("x02_joined", """
WITH d AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id AS k, regexp_matches(t, '[.?!] [a-z]+ [a-z]+ [a-z]+', 'i')::INT AS med_a, regexp_matches(t, '^.{200,}[.?!] \\w+.{50,}$', 'is')::INT AS sdoh_a,
 regexp_matches(t, '^.{200,}[.?!] \\w+.{50,}$', 'is')::INT AS sdoh_total, regexp_matches(t, '[.?!] [a-z]+ [a-z]+ [a-z]+', 'i')::INT AS med_total, 1 AS has_notes FROM d""")
def _(t: Tables) -> DataFrame:
    """Patterns that span two or more turns of a conversation, some of them hundreds of characters long."""
    patterns = {"sdoh_a": r"(?s)^.{200,}[.?!] \w+.{50,}$", "med_a": r"[.?!] [a-z]+ [a-z]+ [a-z]+"}
    return X.regex_flags(t.conversations.select(F.col("conv_id").alias("k"), "turn", "text"), "k", "text", patterns, order=["turn"])


@query("x03_last_numeric", """
WITH d AS (SELECT doc_id % 50 AS k, string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents GROUP BY 1)
SELECT k, (regexp_extract_all(t, '(?:page|nr|no|id)\\D{0,3}(\\d{1,3})', 1, 'i')[-1])::DOUBLE AS x FROM d""")
def _(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("k", F.col("doc_id") % 50)
    return X.last_numeric(docs, "k", "text", ["doc_id"], {"x": r"(?:page|nr|no|id)\D{0,3}(\d{1,3})"})


@query("x03_joined", """
WITH d AS (SELECT conv_id AS k, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY 1)
SELECT k, (regexp_extract_all(t, '[.?!] \\w+\\D{0,400}(\\d{1,3})', 1, 'i')[-1])::DOUBLE AS x FROM d""")
def _(t: Tables) -> DataFrame:
    """A number and the word before it that may stand in an earlier turn."""
    turns = t.conversations.select(F.col("conv_id").alias("k"), "turn", "text")
    return X.last_numeric(turns, "k", "text", ["turn"], {"x": r"[.?!] \w+\D{0,400}(\d{1,3})"})


@query("x03_median_fill", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS x FROM documents) SELECT doc_id, coalesce(x, (SELECT quantile_cont(x::DOUBLE, 0.5) FROM d)) AS x FROM d""")
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("x"))
    return X.fill_with_median(d, ["x"])


_POOLED = [f"{k}_emb_{i}" for k in range(3) for i in range(64)]


@query("x04_pool_notes", """
WITH v AS (SELECT vec_id % 900 AS k, (label % 3)::VARCHAR AS t, embedding AS e FROM embeddings) SELECT c_custkey AS k, """ + ", ".join(
    f"round(coalesce(avg(CASE WHEN t = '{k}' THEN e[{i + 1}]::DOUBLE END), 0), 6) AS \"{k}_emb_{i}\"" for k in range(3) for i in range(64)) + """
FROM customer LEFT JOIN v ON v.k = c_custkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    v = vector_columns(t.embeddings.select((F.col("vec_id") % 900).alias("k"), (F.col("label") % 3).cast("string").alias("t"), "embedding"),
                       "embedding", 64)
    cases = t.customer.select(F.col("c_custkey").alias("k"))
    return rounded(X.pool_notes(v, cases, "k", [f"emb_{i}" for i in range(64)], "t", ["0", "1", "2"]), *_POOLED)


@query("x05_note_timing", """
SELECT event_id, date_diff('minute', TIMESTAMP '2024-01-10', ts) AS after_min, round(date_diff('minute', ts, TIMESTAMP '2024-02-01') / 60::DOUBLE, 6) AS before_h FROM events""")
def _(t: Tables) -> DataFrame:
    after, before = X.note_timing(F.lit("2024-01-10").cast("timestamp"), F.col("ts"), F.lit("2024-02-01").cast("timestamp"))
    return t.events.select("event_id", after.alias("after_min"), r6(before).alias("before_h"))


# ---- sources ----
def cohort_rows(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.cast("string").alias("LogID"), (k * 10).alias("EncounterCSN"), F.col("o_custkey").cast("string").alias("PAT_ID"),
                           F.date_format("o_orderdate", "yyyy-MM-dd").alias("SurgeryDate"), F.year("o_orderdate").alias("SurgeryYear"),
                           F.col("o_orderpriority").alias("PrimaryCPT"), ((k % 9000) / 100).cast("decimal(5,2)").alias("AgeYears"))


_COHORT_SQL = """SELECT o_orderkey::VARCHAR AS "LogID", o_orderkey * 10 AS "EncounterCSN", o_custkey::VARCHAR AS "PAT_ID", strftime(o_orderdate, '%Y-%m-%d') AS "SurgeryDate",
 year(o_orderdate)::INT AS "SurgeryYear", o_orderpriority AS "PrimaryCPT", round((o_orderkey % 9000) / 100::DOUBLE, 2) AS "AgeYears" FROM orders"""


@query("s01_read_positional", _COHORT_SQL)
def _(t: Tables) -> DataFrame:
    path = scratch(t, "cohort.csv")
    rows = cohort_rows(t).withColumn("LogID", F.concat("LogID", F.lit(".0")))
    rows.write.csv(path, header=False)
    got = readers.read_positional(t.spark, path, fixed.COHORT_COLUMNS)
    return got.withColumns({"EncounterCSN": F.col("EncounterCSN").cast("long"), "SurgeryYear": F.col("SurgeryYear").cast("int"),
                            "AgeYears": F.col("AgeYears").cast("double")})


@query("s03_read_optional", 'SELECT 0::BIGINT AS n_missing, count(*) AS n_present FROM customer')
def _(t: Tables) -> DataFrame:
    path = scratch(t, "present.parquet")
    sinks.save_results(t.customer.select("c_custkey", "c_name"), path)
    missing = readers.read_optional(t.spark, scratch(t, "missing.parquet"), ["a", "b"]).agg(F.count(F.lit(1))).scalar()
    present = readers.read_optional(t.spark, path, ["LogID", "Name"])
    return present.agg(F.count(F.lit(1)).alias("n_present")).select(missing.alias("n_missing"), "n_present")


@query("s04_convert_all", _COHORT_SQL)
def _(t: Tables) -> DataFrame:
    source, target = scratch(t, "in"), scratch(t, "out")
    cohort_rows(t).write.csv(f"{source}/cohort.csv", header=True)
    sinks.convert_all(t.spark, source, target, {"cohort": fixed.COHORT_COLUMNS, "absent": fixed.UNIT_COLUMNS})
    got = t.spark.read.parquet(f"{target}/cohort.parquet")
    return got.withColumns({"EncounterCSN": F.col("EncounterCSN").cast("long"), "SurgeryYear": F.col("SurgeryYear").cast("int"),
                            "AgeYears": F.col("AgeYears").cast("double")})


@query("s05_load_cohort", _COHORT_SQL)
def _(t: Tables) -> DataFrame:
    path = scratch(t, "cohort.csv")
    cohort_rows(t).write.csv(path, header=False, lineSep="\r\n")
    got = readers.load_cohort(t.spark, path)
    return got.withColumns({"EncounterCSN": F.col("EncounterCSN").cast("long"), "SurgeryDate": F.date_format("SurgeryDate", "yyyy-MM-dd"),
                            "AgeYears": F.col("AgeYears").cast("double")})


@query("s06_read_comorbidities", """
SELECT o_orderkey::VARCHAR AS "LogID", (o_orderkey % 2)::INT AS mi, (o_orderkey % 3)::INT AS aids, (o_orderkey % 7)::INT AS n_ed_visits_180d, 0 AS n_admits_365d FROM orders""")
def _(t: Tables) -> DataFrame:
    path, k = scratch(t, "side.csv"), F.col("o_orderkey")
    values = {"LogID": k, "mi": k % 2, "aids": k % 3, "n_ed_visits_180d": k % 7}
    t.orders.select(*[values.get(c, F.lit(0)).alias(c) for c in fixed.COMORBIDITY_COLUMNS[:19]]).write.csv(path, header=False)
    return readers.read_comorbidities(t.spark, path).select("LogID", "mi", "aids", "n_ed_visits_180d", "n_admits_365d")


@query("s09_save_results", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    counts = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(t, "result")
    sinks.save_results(counts, path, "json")
    return t.spark.read.schema("p_brand string, n long").json(path)


@query("s11_discover", 'SELECT o_orderkey::VARCHAR AS "LogID", o_orderpriority AS "PrimaryCPT" FROM orders')
def _(t: Tables) -> DataFrame:
    folder = scratch(t, "candidates")
    t.nation.write.csv(f"{folder}/a.csv", header=True)
    cohort_rows(t).write.csv(f"{folder}/b.csv", header=True)
    return readers.discover(t.spark, folder, fixed.COHORT_COLUMNS, ["LogID", "PrimaryCPT"])


@query("q11_stream_bundles", """
SELECT event_type, epoch_us(ts) // 600000000 AS bucket, count(*) AS bundle_size FROM events GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(t: Tables) -> DataFrame:
    # The streaming form of the bundle count; on a batch frame the watermark has no effect.
    from casetrail.streaming.bundles import stream_bundles
    got = stream_bundles(t.events, ["event_type"], "ts", minutes=10)
    return got.select("event_type", (F.unix_micros("bucket_start") / 600_000_000).cast("long").alias("bucket"), "bundle_size")
