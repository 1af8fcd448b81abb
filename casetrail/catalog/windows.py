"""Window operators, sampling and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casetrail.catalog.frames import RUNS_SQL, STAYS_SQL, collapsed, moves, stays
from casetrail.catalog.registry import Tables, day, query, r6, rounded
from casetrail.functions import clock, scalars
from casetrail.operators import sampling as S
from casetrail.operators import sequences as Q
from casetrail.operators.ordering import ordered, time_chunk, with_key_totals
from casetrail.operators.ranks import hashed_rank, top_k
from casetrail.operators.temporal import to_intervals


def minutes_us(c: str):
    """Minutes as whole microseconds, exact in both engines."""
    return F.round(F.col(c) * 60_000_000).cast("long")


# ---- windows ----
@query("w01_top1", """
SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return top_k(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), ["l_orderkey"],
                 [F.desc("l_extendedprice"), F.asc("l_partkey")], 1)


@query("w02_latest_ties", """
SELECT l_suppkey, l_orderkey, l_partkey FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey
 ORDER BY l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    # dense_rank() = 1 lets Spark drop rows below the top before the shuffle.
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"))
    ranked = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_shipdate", F.dense_rank().over(w).alias("rn"))
    return ranked.where("rn = 1").select("l_suppkey", "l_orderkey", "l_partkey")


@query("w03_to_intervals", f"""
WITH {STAYS_SQL} SELECT user_id, event_id, round(Hours, 6) AS hours, SeqInEncounter AS seq FROM stays WHERE event_type <> 'purchase'""")
def _(t: Tables) -> DataFrame:
    got = to_intervals(t.events, ["user_id"], "ts", ["ts", "event_id"], F.col("event_type") == "purchase")
    return got.select("user_id", "event_id", r6("Hours").alias("hours"), F.col("SeqInEncounter").alias("seq"))


@query("w04_gaps", """
SELECT event_id, date_diff('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events""")
def _(t: Tables) -> DataFrame:
    return Q.sequence(t.events, ["user_id"], "ts", ["event_id"], gap="gap").select("event_id", "gap")


@query("w05_sequence", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id) AS seq FROM events""")
def _(t: Tables) -> DataFrame:
    return Q.sequence(t.events, ["user_id"], "ts", ["event_type", "event_id"], seq="seq", gap=None).select("event_id", "seq")


@query("w06_first_last", """
SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_o_orderkey,
 arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return Q.first_last(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@query("w07_partition_totals", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total
FROM orders""")
def _(t: Tables) -> DataFrame:
    got = with_key_totals(t.orders, ["o_custkey"], F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return got.select("o_orderkey", "n", "total")


@query("w08_runs", f"WITH {RUNS_SQL} SELECT event_id, run::BIGINT AS run FROM numbered")
def _(t: Tables) -> DataFrame:
    got = Q.runs(moves(t), ["user_id"], ["ts", "event_id"], "UnitType", time_chunk("ts"))
    return got.select("event_id", F.col("run").cast("long"))


@query("w09_collapse_runs", f"""
WITH {RUNS_SQL} SELECT user_id, seq::BIGINT AS seq, tok, reps, epoch_us(run_start) AS start_us, epoch_us(run_end) AS end_us,
 epoch_us(run_start) - epoch_us(lag(run_start) OVER (PARTITION BY user_id ORDER BY seq)) AS gap_us FROM runs""")
def _(t: Tables) -> DataFrame:
    return collapsed(t).select("user_id", F.col("SeqInEncounter").alias("seq"), F.col("UnitType").alias("tok"),
                               F.col("RepeatCount").alias("reps"), F.unix_micros("RunStart").alias("start_us"),
                               F.unix_micros("RunEnd").alias("end_us"), minutes_us("MinutesFromPrev").alias("gap_us"))


@query("w10_norm_pos_seq", """
WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
SELECT event_id, round(seq / max(seq) OVER (PARTITION BY user_id)::DOUBLE, 6) AS norm_pos FROM s""")
def _(t: Tables) -> DataFrame:
    s = Q.sequence(t.events, ["user_id"], "ts", ["event_id"], seq="seq", gap=None)
    return rounded(Q.norm_pos_seq(s, ["user_id"], "seq").select("event_id", "norm_pos"), "norm_pos")


@query("w11_norm_pos_clock", """
SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER w)) / greatest(epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w),
 1000000)::DOUBLE, 6) AS norm_pos FROM events WINDOW w AS (PARTITION BY user_id)""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.norm_pos_clock(t.events, ["user_id"], "ts").select("event_id", "norm_pos"), "norm_pos")


@query("w12_mins_from_start", """
SELECT event_id, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS mins_us FROM events""")
def _(t: Tables) -> DataFrame:
    return Q.mins_from_start(t.events, ["user_id"], "ts", "mins").select("event_id", minutes_us("mins").alias("mins_us"))


@query("w13_topk_per_key", """
SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey
 ORDER BY count(*) DESC, l_partkey) AS rk FROM lineitem GROUP BY 1, 2) WHERE rk <= 5""")
def _(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["l_suppkey"], [F.desc("n"), F.asc("l_partkey")], 5)


@query("w14_tail_n", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 12""")
def _(t: Tables) -> DataFrame:
    return S.take_per_key(t.events, ["user_id"], ["ts", "event_id"], 12, last=True).select("user_id", "event_id")


@query("w14_head_n", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn <= 7""")
def _(t: Tables) -> DataFrame:
    return S.take_per_key(t.events, ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id")


@query("w15_quantile_bins", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0]))) AS q FROM orders)
SELECT o_orderkey, len(list_filter(q[2:-2], lambda x: x < o_totalprice))::INT AS bin FROM orders, e""")
def _(t: Tables) -> DataFrame:
    return S.quantile_bins(t.orders, "o_totalprice", 10).select("o_orderkey", "bin")


@query("w15_rank_bins", """
SELECT o_orderkey, least(floor((row_number() OVER (ORDER BY floor(o_totalprice / 100000), md5('42:' || o_orderkey::VARCHAR), o_orderkey) * 6 - 1)
 / count(*) OVER ()::DOUBLE), 5)::INT AS bin FROM orders""")
def _(t: Tables) -> DataFrame:
    coarse = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("v"))
    return S.rank_bins(coarse, "v", ["o_orderkey"], 6).select("o_orderkey", "bin")


@query("w16_interval_gaps", """
WITH s AS (SELECT user_id, event_id, ts AS a, ts + to_minutes((event_id % 400)::BIGINT) AS b FROM events)
SELECT event_id, coalesce(greatest(epoch_us(a) - epoch_us(lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id)), 0), 0) AS gap_us FROM s""")
def _(t: Tables) -> DataFrame:
    ends = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 400) * 60_000_000)
    s = t.events.select("user_id", "event_id", F.col("ts").alias("a"), ends.alias("b"))
    return Q.interval_gaps(s, ["user_id"], "a", "b", ["event_id"], "gap").select("event_id", minutes_us("gap").alias("gap_us"))


@query("w08_running_total", """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS total,
 last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_signup
FROM events""")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    got = ordered(e, ["user_id"], ["ts", "event_id"], time_chunk("ts"), running={"total": "value"}, carry={"last_signup": "s"})
    return got.select("event_id", F.round("total", 4).alias("total"), "last_signup")


# ---- sorts and sampling ----
@query("o01_sort", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def _(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("o02_top_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8")
def _(t: Tables) -> DataFrame:
    return S.top_values(t.part, "p_brand", 8)


@query("o03_stratified_sample", """
SELECT yr, o_orderkey FROM (SELECT year(o_orderdate)::INT AS yr, o_orderkey, row_number() OVER (PARTITION BY year(o_orderdate)
 ORDER BY md5('42:' || o_orderkey::VARCHAR)) AS rn FROM orders) WHERE rn <= 300""")
def _(t: Tables) -> DataFrame:
    return S.stratified_sample(t.orders.select(F.year("o_orderdate").alias("yr"), "o_orderkey"), "yr", ["o_orderkey"], 300)


@query("o04_stratified_split", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey::VARCHAR)) AS rk,
 count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, CASE WHEN rk <= round_even(0.8 * n, 0) THEN 'train' WHEN rk <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val'
 ELSE 'test' END AS split FROM r""")
def _(t: Tables) -> DataFrame:
    return S.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"]).select(
        "o_orderkey", "split")


@query("o05_kfold", """
SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey::VARCHAR)) - 1) % 5)::INT AS fold
FROM orders""")
def _(t: Tables) -> DataFrame:
    return S.kfold(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


_CLASS_SQL = """c AS (SELECT o_orderkey AS id, (o_orderpriority = '1-URGENT')::INT AS y FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id::VARCHAR)) AS rk, count(*) OVER (PARTITION BY y) AS n FROM c)"""


def urgent(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


@query("o06_undersample", f"WITH {_CLASS_SQL} SELECT id, y, 0 AS copy FROM r WHERE rk <= (SELECT min(n) FROM r)")
def _(t: Tables) -> DataFrame:
    return S.rebalance(urgent(t), "y", ["id"], "undersample")


@query("o06_oversample", f"""
WITH {_CLASS_SQL}, w AS (SELECT *, greatest((SELECT max(n) FROM r), n) AS want FROM r),
k AS (SELECT *, want // n + (rk <= want % n)::INT AS reps FROM w)
SELECT id, y, unnest(range(reps::INT))::INT AS copy FROM k""")
def _(t: Tables) -> DataFrame:
    return S.rebalance(urgent(t), "y", ["id"], "oversample")


@query("o07_class_weights", f"""
WITH {_CLASS_SQL} SELECT id, y, round((SELECT count(*) FROM c) / (2.0 * n)::DOUBLE, 6) AS weight FROM r""")
def _(t: Tables) -> DataFrame:
    return rounded(S.class_weights(urgent(t), "y"), "weight")


@query("o08_topk_vocab", """
WITH v AS (SELECT l_partkey, row_number() OVER (ORDER BY count(*) DESC, l_partkey) - 1 AS i FROM lineitem
 WHERE l_orderkey % 5 <> 0 GROUP BY 1 QUALIFY i < 40)
SELECT l_orderkey, coalesce(i, 40)::INT AS idx, count(*) AS n FROM lineitem LEFT JOIN v USING (l_partkey) GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    train = t.lineitem.where("l_orderkey % 5 <> 0")
    return S.topk_vocab(train, t.lineitem, "l_partkey", 40, "idx").groupBy("l_orderkey", "idx").agg(F.count(F.lit(1)).alias("n"))


@query("o03_hashed_rank", """
SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey::VARCHAR)) AS rank, count(*) OVER () AS n FROM orders""")
def _(t: Tables) -> DataFrame:
    return hashed_rank(t.orders.select("o_orderkey"), [], ["o_orderkey"], 7, "rank", "n")


# ---- scalar functions ----
@query("f01_datediff", """
SELECT event_id, date_diff('minute', ts, ts + INTERVAL 95 SECOND) AS mi, date_diff('hour', ts, ts + INTERVAL 95 MINUTE) AS h,
 date_diff('day', ts, ts + INTERVAL 30 HOUR) AS d, date_diff('year', ts, ts + INTERVAL 340 DAY) AS y FROM events""")
def _(t: Tables) -> DataFrame:
    ts = F.col("ts")

    def later(seconds: int):
        return F.timestamp_micros(F.unix_micros(ts) + seconds * 1_000_000)
    return t.events.select("event_id", clock.boundaries("minute", ts, later(95)).alias("mi"),
                           clock.boundaries("hour", ts, later(95 * 60)).alias("h"),
                           clock.boundaries("day", ts, later(30 * 3600)).alias("d"),
                           clock.boundaries("year", ts, later(340 * 86400)).alias("y"))


@query("f02_dateadd", """
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 24 MONTH, '%Y-%m-%d') AS m24, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m1,
 strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m-%d') AS y1, strftime(o_orderdate - INTERVAL 72 HOUR, '%Y-%m-%d') AS h72,
 strftime(o_orderdate + INTERVAL 31 DAY, '%Y-%m-%d') AS d31 FROM orders""")
def _(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *[day(clock.shift(at, u, n)).alias(name) for name, u, n in (
        ("m24", "month", -24), ("m1", "month", 1), ("y1", "year", -1), ("h72", "hour", -72), ("d31", "day", 31))])


@query("f03_age", """
SELECT o_orderkey, round(date_diff('day', DATE '1960-03-01', o_orderdate::DATE) / 365.25, 2)::DOUBLE AS age FROM orders""")
def _(t: Tables) -> DataFrame:
    age = clock.age_years(F.to_date(F.lit("1960-03-01")), F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", age.cast("double").alias("age"))


@query("f04_units_bmi", """
WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE (40 + l_quantity)::INT::VARCHAR END AS hi,
  (1000 + l_quantity * 50)::INT::VARCHAR AS wo FROM lineitem), n AS (SELECT *, TRY_CAST(hi AS DOUBLE) AS h, TRY_CAST(wo AS DOUBLE) AS w FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(h * 2.54, 1) AS cm, round(w * 0.0283495, 1) AS kg,
 round(w * 0.0283495 / pow(h * 2.54 / 100, 2), 6) AS bmi FROM n""")
def _(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    hi = F.when(F.col("l_linenumber") == 7, "n/a").otherwise((40 + q).cast("int").cast("string"))
    wo = (1000 + q * 50).cast("int").cast("string")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                             scalars.inches_to_cm(hi).alias("cm"), scalars.ounces_to_kg(wo).alias("kg"),
                             r6(scalars.bmi(hi, wo)).alias("bmi"))


@query("f05_calendar", """
SELECT event_id, year(ts)::INT AS y, dayname(ts) AS dow, (isodow(ts) >= 6)::INT AS weekend FROM events""")
def _(t: Tables) -> DataFrame:
    y, name, weekend = clock.calendar(F.col("ts"))
    return t.events.select("event_id", y.alias("y"), name.alias("dow"), weekend.alias("weekend"))


@query("f06_day_cycle", """
WITH h AS (SELECT event_id, hour(ts) + minute(ts) / 60::DOUBLE AS h, value FROM events)
SELECT event_id, round(sin(2 * pi() * h / 24), 6) AS s, round(cos(2 * pi() * h / 24), 6) AS c, round(ln(1 + value), 6) AS lg FROM h""")
def _(t: Tables) -> DataFrame:
    s, c = clock.day_cycle(clock.hour_of_day(F.col("ts")))
    return t.events.select("event_id", r6(s).alias("s"), r6(c).alias("c"), r6(F.log1p("value")).alias("lg"))


@query("f07_elapsed_bucket", """
WITH m AS (SELECT event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 60000000::DOUBLE AS m FROM events)
SELECT event_id, CASE WHEN m < 60 THEN 1 WHEN m < 240 THEN 2 WHEN m < 720 THEN 3 WHEN m < 1440 THEN 4 WHEN m < 2880 THEN 5 ELSE 6 END AS b FROM m""")
def _(t: Tables) -> DataFrame:
    return Q.time_tokens(t.events, ["user_id"], "ts", "b").select("event_id", "b")


@query("f08_floor_bucket", "SELECT epoch_us(ts) // 120000000 AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(clock.floor_units(F.col("ts"), 120).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_GEO_SQL = """g AS (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN 40.5 + (c_custkey % 97) / 200::DOUBLE END AS lat,
  -74.2 + (c_custkey % 89) / 150::DOUBLE AS lon FROM customer)"""


def _hav(lat: float, lon: float) -> str:
    return (f"3958.8 * 2 * asin(sqrt(pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) "
            f"* pow(sin(radians({lon} - lon) / 2), 2)))")


@query("f09_nearest_miles", f"""
WITH {_GEO_SQL}, d AS (SELECT c_custkey, least({_hav(40.7651, -73.9638)}, {_hav(40.7095, -74.0135)}) AS mi, lat FROM g)
SELECT c_custkey, CASE WHEN lat IS NOT NULL THEN round(mi, 6) END AS mi, CASE WHEN lat IS NOT NULL THEN (mi > 5)::INT END AS far,
 CASE WHEN lat IS NOT NULL THEN (mi > 5 AND mi <= 25)::INT END AS band FROM d""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = F.when(k % 13 != 0, 40.5 + (k % 97) / 200.0), -74.2 + (k % 89) / 150.0
    miles = scalars.nearest_miles(lat, lon)
    far, band = scalars.distance_flags(miles)
    return t.customer.select("c_custkey", r6(miles).alias("mi"), far.alias("far"), band.alias("band"))


@query("f10_zip_features", """
WITH z AS (SELECT c_custkey, (10000 + c_custkey % 1500)::VARCHAR || CASE WHEN c_custkey % 2 = 0 THEN '-0001' ELSE '' END AS z FROM customer)
SELECT c_custkey, substr(regexp_replace(z, '[^0-9]', '', 'g'), 1, 5) AS zip5,
 (substr(z, 1, 3) IN ('100','101','102','103','104','112','113','114','116'))::INT AS is_nyc, (substr(z, 1, 3) IN ('100','101','102'))::INT AS is_manhattan,
 CASE WHEN substr(z, 1, 5) IN ('10029','10035','10037','10039','10451','10452','10453','10454','10455','10456','10457','10458','10459','10460','10467','10473','10474','11207','11208','11212','11213','11221','11224','11225','11226','11233','11239') THEN -1
  WHEN substr(z, 1, 5) IN ('10007','10021','10022','10023','10028','10036','10065','10075','10128','11201','10011','10014','10019','10024','10025') THEN 1 ELSE 0 END AS zip_inc_band,
 CASE WHEN c_custkey % 40 >= 25 THEN 4 WHEN c_custkey % 40 >= 10 THEN 3 WHEN c_custkey % 40 >= 5 THEN 2 WHEN c_custkey % 40 >= 2 THEN 1 ELSE 0 END AS bin FROM z""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    z = F.concat((10000 + k % 1500).cast("string"), F.when(k % 2 == 0, "-0001").otherwise(""))
    return t.customer.select("c_custkey", *[c.alias(n) for n, c in scalars.zip_features(z).items()],
                             scalars.distance_bin(k % 40).alias("bin"))


@query("f11_experience", """
SELECT o_orderkey, round(least(greatest(date_diff('day', o_orderdate::DATE, DATE '1999-01-01') / 365.25::DOUBLE, 0), 60), 6) AS years FROM orders""")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", r6(clock.years_of_experience(F.col("o_orderdate"), "1999-01-01")).alias("years"))


@query("f12_strings", """
SELECT p_partkey, upper(p_name) AS up, left(p_name, 4) AS l4, length(p_name)::INT AS n, trim('  ' || p_brand || ' ') AS tr FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.left("p_name", F.lit(4)).alias("l4"),
                         F.length("p_name").alias("n"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("tr"))


@query("f13_split", """
SELECT x AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS x FROM part) WHERE x <> '' GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.relational import split_list
    return split_list(t.part, "p_name", "word", " ").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("f14_asa_class", """
WITH a AS (SELECT o_orderkey, 'ASA ' || CASE o_orderkey % 6 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'IV' WHEN 4 THEN 'V' ELSE 'none' END
  || ' - text' AS s FROM orders)
SELECT CASE regexp_extract(s, 'ASA\\s+(VI|IV|V|III|II|I)\\b', 1) WHEN 'I' THEN '1.0' WHEN 'II' THEN '2.0' WHEN 'III' THEN '3.0' WHEN 'IV' THEN '4.0'
 WHEN 'V' THEN '5.0' END AS asa, count(*) AS n FROM a GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    s = F.concat(F.lit("ASA "), F.when(k == 0, "I").when(k == 1, "II").when(k == 2, "III").when(k == 3, "IV").when(
        k == 4, "V").otherwise("none"), F.lit(" - text"))
    return t.orders.groupBy(scalars.asa_class(s).alias("asa")).agg(F.count(F.lit(1)).alias("n"))


_DISPO = ["Home or Self Care", "Home-Health Care Svc", "Skilled Nursing Facility", "Expired", "Left Against Medical Advice",
          "Psychiatric Hospital", "Somewhere", "Hospice/Home"]
_DISPO_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(_DISPO)) + " END"


@query("f15_disposition", f"""
WITH d AS (SELECT {_DISPO_SQL} AS d FROM orders), l AS (SELECT d, lower(d) AS s FROM d)
SELECT d, count(*) AS n, max(CASE WHEN s LIKE '%ama%' OR s LIKE '%against medical%' THEN 'AMA' WHEN s LIKE '%expired%' THEN 'Expired'
 WHEN s LIKE '%home%' OR s LIKE '%self care%' THEN 'Home' WHEN regexp_matches(s, 'facility|hospital|nursing|rehab|custodial|skilled') THEN 'Facility'
 ELSE 'Other' END) AS bucket, max(CASE d WHEN 'Home or Self Care' THEN 'home' WHEN 'Home-Health Care Svc' THEN 'home_health'
 WHEN 'Skilled Nursing Facility' THEN 'snf' WHEN 'Expired' THEN 'hospice_exp' WHEN 'Hospice/Home' THEN 'hospice_exp'
 WHEN 'Left Against Medical Advice' THEN 'ama' WHEN 'Psychiatric Hospital' THEN 'acute_transfer' ELSE 'other' END) AS grp,
 max((d IN ('Home or Self Care', 'Home-Health Care Svc'))::INT) AS home FROM l GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 8, F.when(F.lit(False), "")
    for i, label in enumerate(_DISPO):
        d = d.when(k == i, label)
    c = F.col("d")
    return t.orders.select(d.alias("d")).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.max(scalars.disposition_bucket(c)).alias("bucket"),
        F.max(scalars.disposition_group(c)).alias("grp"), F.max(scalars.is_home(c)).alias("home"))


_GROUPS = ["MED:Opioids", "PROC:Lab", "PROC:Point of Care Testing", "PROC:Imaging", "PROC:EKG", "PROC:Consult", "PROC:Diet", "PROC:Blood Bank"]


@query("f16_order_category", f"""
WITH g AS (SELECT CASE l_partkey % 8 {' '.join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(_GROUPS))} END AS g FROM lineitem)
SELECT g, count(*) AS n, max(CASE WHEN g LIKE 'MED:%' THEN 'med' WHEN regexp_matches(lower(g), 'lab|point of care|microbiology|pathology|blood bank') THEN 'lab'
 WHEN regexp_matches(lower(g), 'imaging|ekg') THEN 'imaging' WHEN lower(g) LIKE '%consult%' THEN 'consult' ELSE 'care' END) AS cat FROM g GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    g = F.when(F.lit(False), "")
    for i, label in enumerate(_GROUPS):
        g = g.when(F.col("l_partkey") % 8 == i, label)
    return t.lineitem.select(g.alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"),
                                                           F.max(scalars.order_category(F.col("g"))).alias("cat"))


@query("f17_provider_role", """
WITH r AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Attending' WHEN 1 THEN 'Fellow' WHEN 2 THEN 'Nurse Anesthetist' WHEN 3 THEN 'Anesthesiologist'
  END AS p FROM supplier)
SELECT s_suppkey, CASE p WHEN 'Attending' THEN 'attending' WHEN 'Fellow' THEN 'resident' WHEN 'Nurse Anesthetist' THEN 'crna'
 WHEN 'Anesthesiologist' THEN 'anesth' ELSE 'other' END AS role FROM r""")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 5
    p = F.when(k == 0, "Attending").when(k == 1, "Fellow").when(k == 2, "Nurse Anesthetist").when(k == 3, "Anesthesiologist")
    return t.supplier.select("s_suppkey", scalars.provider_role(p).alias("role"))


@query("f18_null_handling", """
SELECT p_partkey, coalesce(nullif(p_type, 'PROMO'), '(none)') AS k, TRY_CAST(replace(p_brand, 'Brand#', '') AS INT) AS b,
 TRY_CAST(p_name AS INT) AS bad FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("(none)")).alias("k"),
                         scalars.number(F.replace("p_brand", F.lit("Brand#"), F.lit("")), "int").alias("b"),
                         scalars.number(F.col("p_name"), "int").alias("bad"))


@query("f19_missing_flags", """
WITH w AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS a, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS b FROM part)
SELECT p_partkey, (TRY_CAST(a AS DOUBLE) IS NOT NULL)::INT AS a__present, (b IS NOT NULL)::INT AS b__present,
 (TRY_CAST(a AS DOUBLE) IS NOT NULL)::INT + (b IS NOT NULL)::INT AS lab_count FROM w""")
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    w = t.part.select("p_partkey", F.when(size % 3 == 0, "n/a").otherwise(size.cast("string")).alias("a"),
                      F.when(size % 4 != 0, F.col("p_retailprice")).alias("b"))
    return scalars.missing_flags(w, ["a", "b"]).drop("a", "b")


@query("f20_derived", """
WITH u AS (SELECT p_partkey, p_size % 5 AS ed, p_size % 4 AS ad, CASE WHEN p_size % 7 <> 0 THEN 40::DOUBLE + p_size END AS age FROM part)
SELECT p_partkey, round(ln(1 + ed), 6) AS log_ed180, round(ln(1 + ad), 6) AS log_admits365, (ed >= 2)::INT AS ed180_ge2, (ad >= 2)::INT AS admits365_ge2,
 (coalesce(age, 60) > 75 AND ad >= 2)::INT AS elderly_x_admits FROM u""")
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    age = F.when(size % 7 != 0, 40.0 + size)
    got = t.part.select("p_partkey", *[c.alias(n) for n, c in scalars.utilisation_features(size % 5, size % 4, age).items()])
    return rounded(got, "log_ed180", "log_admits365")


@query("f22_signature", """
SELECT coalesce((o_orderkey % 3)::VARCHAR, 'nan') || '|' || coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'nan') AS sig, count(*) AS n
FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    sig = scalars.signature(F.col("o_orderkey") % 3, F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return t.orders.groupBy(sig.alias("sig")).agg(F.count(F.lit(1)).alias("n"))


@query("q18_token", """
SELECT coalesce(left(p_type, 3), 'Unk') || ':' || coalesce(left(CASE WHEN p_size > 25 THEN p_brand END, 3), 'Unk') AS tok, count(*) AS n FROM part GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    tok = scalars.token(F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_brand")), width=3)
    return t.part.groupBy(tok.alias("tok")).agg(F.count(F.lit(1)).alias("n"))


@query("c19_preop_trajectory", f"""
WITH {STAYS_SQL}, a AS (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'purchase' GROUP BY 1),
w AS (SELECT s.*, greatest((epoch_us(least(OutTime, anchor)) - epoch_us(InTime)) / 3600000000::DOUBLE, 0) AS h FROM stays s JOIN a USING (user_id)
  WHERE InTime < anchor AND UnitType IN ('Acute', 'Intensive', 'Intermediate')),
g AS (SELECT user_id, sum(CASE WHEN UnitType = 'Acute' THEN h END) AS ac, sum(CASE WHEN UnitType = 'Intensive' THEN h END) AS ic, count(*) AS n,
  count(DISTINCT value) AS u FROM w GROUP BY 1)
SELECT user_id, round(coalesce(ac, 0), 6) AS preop_los_acute_hr, round(coalesce(ic, 0), 6) AS preop_los_intensive_hr, 0::DOUBLE AS preop_los_intermediate_hr,
 coalesce(n, 0) AS preop_transfer_count, coalesce(u, 0) AS preop_n_units FROM a LEFT JOIN g USING (user_id)""")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.temporal import preop_trajectory
    anchors = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("anchor"))
    got = preop_trajectory(stays(t), anchors, "user_id", "anchor", department="value")
    return rounded(got, "preop_los_acute_hr", "preop_los_intensive_hr", "preop_los_intermediate_hr")
