"""Event sequences and process mining on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.frames import (DAY_RUNS_SQL, RUNS_SQL, STAYS_SQL, UNIT_SQL, collapsed, day_collapsed, moves, scores,
                                      stays)
from casetrail.catalog.registry import Tables, query, r6, rounded
from casetrail.catalog.windows import minutes_us
from casetrail.operators import sequences as Q


def day_labels(t: Tables) -> DataFrame:
    """Label of a user-day: does the user's next day (any) hold an error?"""
    e = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type")
    return e.where(F.pmod("user_id", F.lit(5)) != 0).groupBy("user_id", "day").agg(
        F.max((F.col("event_type") == "error").cast("int")).alias("y"))


_DAY_LABEL_SQL = """lab AS (SELECT user_id, CAST(ts AS DATE) AS day, max((event_type = 'error')::INT) AS y FROM events
  WHERE user_id % 5 <> 0 GROUP BY 1, 2)"""
_PATH_SQL = "paths AS (SELECT user_id, day, string_agg(tok, ' -> ' ORDER BY seq) AS variant, count(*) AS n_stops FROM runs GROUP BY 1, 2)"


@query("q01_sequences", f"""
SELECT user_id, string_agg({UNIT_SQL}, ',' ORDER BY ts, event_id) AS seq FROM events GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return Q.sequences(moves(t), ["user_id"], ["ts", "event_id"], "UnitType").select("user_id", F.array_join("seq", ",").alias("seq"))


@query("q02_collapse", f"WITH {RUNS_SQL} SELECT user_id, string_agg(tok, ',' ORDER BY seq) AS seq FROM runs GROUP BY 1")
def _(t: Tables) -> DataFrame:
    s = Q.sequences(moves(t), ["user_id"], ["ts", "event_id"], "UnitType")
    return s.select("user_id", F.array_join(Q.collapse(F.col("seq")), ",").alias("seq"))


@query("q03_variants", f"""
WITH {DAY_RUNS_SQL}, {_PATH_SQL}, {_DAY_LABEL_SQL}
SELECT variant, count(*) AS n, count(y) AS n_labelled, round(avg(y), 6) AS rate, round(count(*) / (SELECT count(*) FROM paths)::DOUBLE, 6) AS share
FROM paths LEFT JOIN lab USING (user_id, day) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    paths = Q.traces(day_collapsed(t), ["user_id", "day"], "SeqInEncounter", "UnitType")
    return rounded(Q.variants(paths, ["user_id", "day"], day_labels(t)), "rate", "share")


@query("q04_directly_follows", f"""
WITH {RUNS_SQL} SELECT tok AS from_token, nxt AS to_token, count(*) AS n FROM (SELECT tok, lead(tok) OVER (PARTITION BY user_id ORDER BY seq) AS nxt
 FROM runs) WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return Q.directly_follows(collapsed(t), ["user_id"], "SeqInEncounter", "UnitType")


@query("q05_endpoints", f"""
WITH {DAY_RUNS_SQL}, e AS (SELECT arg_min(tok, seq) AS s, arg_max(tok, seq) AS e FROM runs GROUP BY user_id, day)
SELECT 'start' AS kind, s AS token, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'end', e, count(*) FROM e GROUP BY 2""")
def _(t: Tables) -> DataFrame:
    return Q.endpoints(day_collapsed(t), ["user_id", "day"], "SeqInEncounter", "UnitType")


@query("q05_trace_lengths", f"""
WITH {DAY_RUNS_SQL}, c AS (SELECT user_id, day, count(*) AS len FROM runs GROUP BY 1, 2)
SELECT count(*) AS n_cases, round(avg(len), 6) AS mean_len, min(len) AS min_len, max(len) AS max_len, quantile_cont(len::DOUBLE, 0.5) AS median_len FROM c""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.trace_lengths(day_collapsed(t), ["user_id", "day"]), "mean_len", "median_len")


def day_stays(t: Tables) -> DataFrame:
    return stays(t).withColumn("day", F.to_date("InTime"))


_FIRST_PATH_SQL = f"""{STAYS_SQL}, sub AS (SELECT user_id, InTime::DATE AS day, min(CASE WHEN UnitType = 'ED' THEN SeqInEncounter END) AS pa,
  min(CASE WHEN UnitType = 'OR' THEN SeqInEncounter END) AS pb, min(CASE WHEN UnitType = 'ED' THEN InTime END) AS a_in,
  arg_min(CASE WHEN UnitType = 'ED' THEN OutTime END, CASE WHEN UnitType = 'ED' THEN SeqInEncounter END) AS a_out,
  min(CASE WHEN UnitType = 'OR' THEN InTime END) AS b_in FROM stays GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a_in, day) AS rn FROM sub WHERE pa < pb)"""


@query("q06_first_path", f"""
WITH {_FIRST_PATH_SQL} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, epoch_us(a_in) AS a_us, epoch_us(b_in) AS b_us FROM best WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    got = Q.first_path(day_stays(t), "user_id", "day", "SeqInEncounter", "UnitType", "InTime", "OutTime", "ED", "OR")
    return got.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.unix_micros("a_in").alias("a_us"),
                      F.unix_micros("b_in").alias("b_us"))


@query("q07_elapsed", f"""
WITH {_FIRST_PATH_SQL}, h AS (SELECT user_id % 3 AS site, (epoch_us(b_in) - epoch_us(a_in)) / 3600000000::DOUBLE AS arr,
 (epoch_us(b_in) - epoch_us(a_out)) / 3600000000::DOUBLE AS dep FROM best WHERE rn = 1)
SELECT site, count(arr) AS n, round(avg(arr), 6) AS mean, round(quantile_cont(arr, 0.25), 6) AS q25, round(quantile_cont(arr, 0.5), 6) AS median,
 round(quantile_cont(arr, 0.75), 6) AS q75, round(max(dep), 6) AS max_departure FROM h GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    paths = Q.first_path(day_stays(t), "user_id", "day", "SeqInEncounter", "UnitType", "InTime", "OutTime", "ED", "OR").withColumn(
        "site", F.col("user_id") % 3)
    got = Q.elapsed_summary(paths, ["site"], "hrs_arrival").join(
        paths.groupBy("site").agg(F.max("hrs_departure").alias("max_departure")), "site")
    return rounded(got, "mean", "q25", "median", "q75", "max_departure")


def day_features(t: Tables, large: bool = False) -> DataFrame:
    case = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd"))
    return Q.sequence_features(moves(t).withColumn("case", case), day_collapsed(t).withColumn("case", case), "case",
                               "SeqInEncounter", "UnitType", large=large)


_FEATURE_SQL = f"""{DAY_RUNS_SQL}, k AS (SELECT user_id::VARCHAR || ':' || strftime(day, '%Y-%m-%d') AS ck, tok, seq FROM runs),
per AS (SELECT ck, count(*) AS stops, count(CASE WHEN tok = 'OR' THEN 1 END) AS ors, min(CASE WHEN tok = 'Intensive' THEN seq END) AS icu,
  min(CASE WHEN tok = 'OR' THEN seq END) AS op, arg_max(tok, seq) AS last FROM k GROUP BY 1),
feats AS (SELECT user_id::VARCHAR || ':' || strftime(day, '%Y-%m-%d') AS ck, 'cnt_' || tok AS feature, count(*)::DOUBLE AS value FROM ev GROUP BY 1, 2
  UNION ALL SELECT ck, 'n_stops', stops FROM per UNION ALL SELECT ck, 'n_or', ors FROM per WHERE ors > 0
  UNION ALL SELECT ck, 'has_ICU', 1 FROM per WHERE icu IS NOT NULL UNION ALL SELECT ck, 'ICU_after_OR', 1 FROM per WHERE icu > op
  UNION ALL SELECT ck, 'end_' || last, 1 FROM per
  UNION ALL SELECT ck, 'bg_' || tok || '>' || nxt, count(*) FROM (SELECT ck, tok, lead(tok) OVER (PARTITION BY ck ORDER BY seq) AS nxt FROM k)
    WHERE nxt IS NOT NULL GROUP BY 1, 2)"""


@query("q08_sequence_features", f'WITH {_FEATURE_SQL} SELECT ck AS "case", feature, value FROM feats')
def _(t: Tables) -> DataFrame:
    return day_features(t)


@query("q08_sequence_features_wide", f"""
WITH {_FEATURE_SQL} SELECT ck AS "case", coalesce(max(CASE WHEN feature = 'n_stops' THEN value END), 0) AS n_stops,
 coalesce(max(CASE WHEN feature = 'ICU_after_OR' THEN value END), 0) AS "ICU_after_OR", coalesce(max(CASE WHEN feature = 'bg_ED>OR' THEN value END), 0) AS "bg_ED>OR"
FROM feats GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return Q.to_wide(day_features(t), "case", ["n_stops", "ICU_after_OR", "bg_ED>OR"])


@query("q09_truncate_at", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN seq END) AS stop FROM s GROUP BY 1)
SELECT event_id FROM s JOIN f USING (user_id) WHERE stop IS NULL OR seq <= stop""")
def _(t: Tables) -> DataFrame:
    s = Q.sequence(t.events, ["user_id"], "ts", ["event_id"], seq="seq", gap=None)
    return Q.truncate_at(s, ["user_id"], "seq", "event_type", "purchase").select("event_id")


@query("q10_support_filter", f"""
WITH {_FEATURE_SQL}, s AS (SELECT feature FROM feats WHERE value > 0 AND length(ck) % 2 = 0 GROUP BY 1 HAVING count(DISTINCT ck) >= 50)
SELECT feature, count(*) AS n, round(sum(value), 6) AS total FROM feats JOIN s USING (feature) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    f = day_features(t)
    kept = Q.support_filter(f, f.where(F.length("case") % 2 == 0), "case", 50)
    return kept.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("q11_bundles", """
WITH b AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type, epoch_us(ts) // 600000000) AS n FROM events)
SELECT event_id, n AS bundle_size, round(1.0 / n, 6) AS penalty, (n >= 3)::INT AS is_bundled FROM b""")
def _(t: Tables) -> DataFrame:
    got = Q.bundles(t.events, ["event_type"], "ts", minutes=10)
    return got.select("event_id", "bundle_size", r6("bundle_penalty").alias("penalty"), "is_bundled")


@query("q11_bundle_fraction", """
WITH b AS (SELECT CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY CAST(ts AS DATE), epoch_us(ts) // 600000000) AS n FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, round(avg((n >= 3)::INT), 6) AS bundle_frac FROM b GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(Q.bundle_fraction(e, ["day"], "ts", minutes=10), "bundle_frac")


@query("q12_bundle_signatures", """
WITH b AS (SELECT epoch_us(ts) // 600000000 AS bucket, event_type FROM events), g AS (SELECT bucket, count(*) AS n,
 string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS signature FROM b GROUP BY 1 HAVING count(*) >= 3)
SELECT signature, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, signature LIMIT 200""")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.sampling import top_values
    return top_values(Q.bundle_signatures(t.events, [], "ts", "event_type", minutes=10), "signature", 200)


_VOCAB_SQL = """v AS (SELECT l_partkey AS tok, row_number() OVER (ORDER BY count(*) DESC, l_partkey) - 1 AS i FROM lineitem GROUP BY 1)"""


@query("q13_vocabulary", f"WITH {_VOCAB_SQL} SELECT tok, i::INT AS idx FROM v")
def _(t: Tables) -> DataFrame:
    # Zero-padded text sorts like the number, so ties fall the same way.
    tokens = t.lineitem.select(F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("tok"))
    return Q.vocabulary(tokens, "tok").select(F.col("tok").cast("long").alias("tok"), F.col("index").alias("idx"))


@query("q13_encode_sequences", f"""
WITH {RUNS_SQL}, v AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 AS i FROM runs GROUP BY 1),
k AS (SELECT user_id, seq, i, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM runs JOIN v USING (tok)),
l AS (SELECT user_id, list(i ORDER BY seq) AS x, (SELECT count(*) FROM v) AS pad FROM k WHERE rn <= 64 GROUP BY 1)
SELECT user_id, array_to_string(list_concat(x, list_transform(range(64 - len(x)), lambda z: pad)), ',') AS toks, len(x)::INT AS length FROM l""")
def _(t: Tables) -> DataFrame:
    c = collapsed(t)
    got = Q.encode_sequences(c, ["user_id"], ["SeqInEncounter"], "UnitType", Q.vocabulary(c, "UnitType"), 64)
    return got.select("user_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("toks"), "length")


@query("q13_step_numbers", f"""
WITH {RUNS_SQL}, g AS (SELECT *, lag(run_start) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM runs), n AS (SELECT user_id, ln(1 + reps::DOUBLE) AS a,
 ln(1 + coalesce((epoch_us(run_start) - epoch_us(prev)) / 60000000::DOUBLE, 0)) AS b, seq / 64::DOUBLE AS c,
 2 * pi() * (hour(run_start) + minute(run_start) / 60::DOUBLE) / 24 AS t FROM g WHERE seq <= 64)
SELECT user_id, count(*)::INT AS length, round(sum(a), 6) AS sum_0, round(sum(b), 6) AS sum_1, round(sum(c), 6) AS sum_2, round(sum(sin(t)), 6) AS sum_3, round(sum(cos(t)), 6) AS sum_4
FROM n GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    c = collapsed(t)
    numbers = Q.step_numbers(F.col("RepeatCount"), F.col("MinutesFromPrev"), F.col("RunStart"), F.col("SeqInEncounter"), 64)
    got = Q.encode_sequences(c, ["user_id"], ["SeqInEncounter"], "UnitType", Q.vocabulary(c, "UnitType"), 64, "first", numbers)
    return got.select("user_id", "length", *[r6(F.aggregate(f"num_{i}", F.lit(0.0), lambda a, x: a + x)).alias(f"sum_{i}")
                                             for i in range(len(numbers))])


@query("q14_temporal_edges", """
WITH s AS (SELECT user_id, event_type || (event_id % 9)::VARCHAR AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  1.0 / count(*) OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000)::DOUBLE AS pen FROM events),
n AS (SELECT user_id, tok, seq / max(seq) OVER (PARTITION BY user_id)::DOUBLE AS pos, pen FROM s),
g AS (SELECT user_id, tok, count(*) AS n, avg(pos) AS mp, avg(pen) AS me, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, tok) AS rk
  FROM n GROUP BY 1, 2)
SELECT user_id, tok, n, round(mp * me + 1e-9, 6) AS weight FROM g WHERE rk <= 10""")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("tok", F.concat("event_type", (F.col("event_id") % 9).cast("string")))
    s = Q.norm_pos_seq(Q.sequence(e, ["user_id"], "ts", ["event_id"], seq="seq", gap=None), ["user_id"], "seq")
    got = Q.temporal_edges(Q.bundles(s, ["user_id"], "ts", minutes=60), "user_id", "tok", F.col("norm_pos"), 10, F.col("bundle_penalty"))
    return got.select("user_id", "tok", "n", r6(F.col("weight") + 1e-9).alias("weight"))


_GROUP_SQL = "grp AS (SELECT o_orderkey AS k, o_orderpriority AS g FROM orders), tk AS (SELECT DISTINCT l_orderkey AS k, p_type || p_size::VARCHAR AS tok FROM lineitem JOIN part ON p_partkey = l_partkey)"


def part_tokens(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", F.concat("p_type", F.col("p_size").cast("string")).alias("tok"))
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey").select("k", "tok")


def priority_groups(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"))


@query("q15_token_lift", f"""
WITH {_GROUP_SQL}, m AS (SELECT g, tok, k FROM tk JOIN grp USING (k)), sz AS (SELECT g, count(*) AS s FROM grp GROUP BY 1),
al AS (SELECT tok, count(*) AS a FROM m GROUP BY 1), w AS (SELECT g, tok, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) >= 30),
x AS (SELECT g, tok, n, n / s::DOUBLE AS share, (n / s::DOUBLE) / (a / (SELECT count(*) FROM grp)::DOUBLE) AS lift FROM w JOIN sz USING (g) JOIN al USING (tok))
SELECT g, tok, n, round(share, 6) AS share, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY lift DESC, tok) AS rk FROM x) WHERE rk <= 5""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.token_lift(part_tokens(t), priority_groups(t), "k", "tok", "g", 30, 5), "share", "lift")


@query("q16_prevalence", f"""
WITH {_GROUP_SQL}, m AS (SELECT g, tok, k FROM tk JOIN grp USING (k)), sz AS (SELECT g, count(DISTINCT k) AS s FROM m GROUP BY 1),
x AS (SELECT g, tok, count(*) AS n FROM m GROUP BY 1, 2)
SELECT g, tok, n, round(n / s::DOUBLE, 6) AS share FROM (SELECT x.*, s, row_number() OVER (PARTITION BY g ORDER BY n DESC, tok) AS rk FROM x JOIN sz USING (g))
WHERE rk <= 8""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.prevalence(part_tokens(t), priority_groups(t), "k", "tok", "g", 8), "share")


@query("q17_two_proportions", """
WITH s AS (SELECT o_orderstatus AS st, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT AS y, (o_custkey % 3 = 0)::INT AS f FROM orders),
c AS (SELECT st, count(CASE WHEN f = 1 THEN 1 END) AS n1, sum(CASE WHEN f = 1 THEN y ELSE 0 END)::BIGINT AS x1, count(CASE WHEN f = 0 THEN 1 END) AS n0,
 sum(CASE WHEN f = 0 THEN y ELSE 0 END)::BIGINT AS x0 FROM s GROUP BY 1),
r AS (SELECT *, x1 / n1::DOUBLE AS p1, x0 / n0::DOUBLE AS p0, (x1 + x0) / (n1 + n0)::DOUBLE AS p FROM c)
SELECT st, n1, x1, n0, x0, round(p1, 6) AS rate1, round(p0, 6) AS rate0, round(p1 / p0, 6) AS risk_ratio,
 round((p1 - p0) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n0)), 6) AS z FROM r""")
def _(t: Tables) -> DataFrame:
    s = scores(t).withColumn("f", (F.col("patient") % 3 == 0).cast("int"))
    got = Q.two_proportions(s, "f", "y", ["status"]).withColumnRenamed("status", "st").drop("p_value")
    return rounded(got, "rate1", "rate0", "risk_ratio", "z")


@query("q17_run_gaps", f"""
WITH {DAY_RUNS_SQL} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, seq::BIGINT AS seq,
 epoch_us(run_start) - epoch_us(lag(run_start) OVER (PARTITION BY user_id, day ORDER BY seq)) AS gap_us FROM runs""")
def _(t: Tables) -> DataFrame:
    return day_collapsed(t).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("SeqInEncounter").alias("seq"),
                                   minutes_us("MinutesFromPrev").alias("gap_us"))


@query("a10_care_structure", f"""
SELECT user_id, max(({UNIT_SQL} = 'ED')::INT) AS "has_ED", min(({UNIT_SQL} = 'OR')::INT) AS "OR_only", count(DISTINCT {UNIT_SQL}) AS n_units,
 max((event_type = 'error')::INT) AS touched_icu FROM events GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return Q.care_structure(moves(t), "user_id", categories={"touched_icu": "error"}, institution="event_type")
