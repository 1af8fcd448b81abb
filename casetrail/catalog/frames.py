"""Analogue tables: the shipped test tables read as cases, events, stays, visits and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.registry import Tables, hash_int

# Event type -> care unit of the analogue.
UNITS = {"signup": "ED", "purchase": "OR", "error": "Intensive", "click": "Acute", "view": "Other"}
UNIT_SQL = ("CASE event_type WHEN 'signup' THEN 'ED' WHEN 'purchase' THEN 'OR' WHEN 'error' THEN 'Intensive' "
            "WHEN 'click' THEN 'Acute' ELSE 'Other' END")


def unit(c: str = "event_type"):
    result = F.when(F.lit(False), "")
    for k, v in UNITS.items():
        result = result.when(F.col(c) == k, v)
    return result


def moves(t: Tables) -> DataFrame:
    """Events as unit changes: user, day as the case's sub-encounter, unit."""
    return t.events.select("event_id", "user_id", "ts", "event_type", "value", unit().alias("UnitType"),
                           F.to_date("ts").alias("day"))


# Stays per user: each event opens a stay that lasts until the user's next event.
STAYS_SQL = f"""stays AS (
  SELECT user_id, event_id, event_type, {UNIT_SQL} AS UnitType, value, ts AS InTime,
         lead(ts) OVER w AS OutTime,
         date_diff('minute', ts, lead(ts) OVER w) / 60.0::DOUBLE AS Hours,
         row_number() OVER w AS SeqInEncounter
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def stays(t: Tables) -> DataFrame:
    from casetrail.operators.temporal import to_intervals
    return to_intervals(moves(t).drop("day"), ["user_id"], "ts", ["ts", "event_id"]).drop("ts")


# Runs of equal units per user.
RUNS_SQL = f"""ev AS (SELECT user_id, event_id, ts, {UNIT_SQL} AS tok FROM events),
chg AS (SELECT *, CASE WHEN tok = lag(tok) OVER w THEN 0 ELSE 1 END AS c FROM ev
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM chg),
runs AS (SELECT user_id, run AS seq, min(tok) AS tok, count(*) AS reps, min(ts) AS run_start, max(ts) AS run_end
         FROM numbered GROUP BY user_id, run)"""


def collapsed(t: Tables) -> DataFrame:
    from casetrail.operators.sequences import collapse_runs
    return collapse_runs(moves(t), ["user_id"], ["ts", "event_id"], "ts", "UnitType")


# Runs per user and day: short paths that repeat.
DAY_RUNS_SQL = f"""ev AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, {UNIT_SQL} AS tok FROM events),
chg AS (SELECT *, CASE WHEN tok = lag(tok) OVER w THEN 0 ELSE 1 END AS c FROM ev
        WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS run FROM chg),
runs AS (SELECT user_id, day, run AS seq, min(tok) AS tok, count(*) AS reps, min(ts) AS run_start
         FROM numbered GROUP BY user_id, day, run)"""


def day_collapsed(t: Tables) -> DataFrame:
    from casetrail.operators.sequences import collapse_runs
    return collapse_runs(moves(t), ["user_id", "day"], ["ts", "event_id"], "ts", "UnitType", chunk_seconds=6 * 3600)


# Order scores: label 1 for urgent orders, two scores of 1000 steps that lean towards it, 5 folds.
SCORES_SQL = """scores AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y,
         (('0x' || substr(md5('a' || o_orderkey::VARCHAR), 1, 7))::BIGINT % 800
          + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 150 ELSE 0 END) / 1000::DOUBLE AS p,
         (('0x' || substr(md5('b' || o_orderkey::VARCHAR), 1, 7))::BIGINT % 900
          + CASE WHEN o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END) / 1000::DOUBLE AS q,
         o_orderkey % 5 AS fold, o_orderstatus AS status, o_custkey AS patient
  FROM orders)"""


def scores(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    key = F.col("o_orderkey")
    a = F.pmod(hash_int(F.concat(F.lit("a"), key.cast("string"))), F.lit(800)) + F.when(urgent, 150).otherwise(0)
    b = F.pmod(hash_int(F.concat(F.lit("b"), key.cast("string"))), F.lit(900)) + F.when(
        F.col("o_orderpriority") == "1-URGENT", 100).otherwise(0)
    return t.orders.select(key.alias("id"), F.when(urgent, 1).otherwise(0).alias("y"), (a / F.lit(1000.0)).alias("p"),
                           (b / F.lit(1000.0)).alias("q"), F.pmod(key, F.lit(5)).alias("fold"),
                           F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("patient"))


# Both scores as one long table.
LONG_SQL = SCORES_SQL + """, long AS (SELECT id, y, fold, 'p' AS model, p AS s FROM scores
  UNION ALL SELECT id, y, fold, 'q' AS model, q AS s FROM scores)"""


def long_scores(t: Tables) -> DataFrame:
    return scores(t).unpivot(["id", "y", "fold"], ["p", "q"], "model", "s")


# Order-part links of the incidence queries; label as above, train = not fold 0.
LINKS_SQL = "links AS (SELECT l_orderkey AS c, l_partkey AS n, count(*) AS m FROM lineitem GROUP BY 1, 2)"


def links(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("n"))


def train_labels(t: Tables) -> DataFrame:
    return scores(t).select(F.col("id").alias("c"), "y", (F.col("fold") != 0).cast("int").alias("train"))
