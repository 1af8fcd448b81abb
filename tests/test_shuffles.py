"""What queries shuffle: rows meet with few columns and few times."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from casetrail.plans import clinical as C


@pytest.fixture(autouse=True)
def no_broadcasts(spark):
    """Joins as large tables get them."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def shuffled(df) -> list[str]:
    """Columns that each exchange of a plan takes in."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", text)


def test_transfusion_lines_are_shuffled_as_digests(spark, tmp_path):
    start = datetime(2020, 1, 10)
    orders = [(k, k % 3, "F", 1.0, start + timedelta(days=20 * k), "5-LOW") for k in range(6)] + [(None, 1, "F", 1.0, start, "5-LOW")]
    # Quantity 12 starts a day after the order; line 2 of order 3 comes twice, order 9 and the null key are not among the orders.
    lines = [(k, 1, 1, n, 12.0, 5.0, 0.0, 0.0, "A", "F", start + timedelta(days=20 * k - 2 * n)) for k in range(6) for n in (1, 2)]
    lines += [lines[7], (9, 1, 1, 1, 12.0, 5.0, 0.0, 0.0, "A", "F", start), (None, 1, 1, 1, 12.0, 5.0, 0.0, 0.0, "A", "F", start)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                          "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(
                              f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["c11_transfusion_flag"](spark, str(tmp_path))
    by_key = {r["LogID"]: r["RBC_Yes"] for r in got.collect()}
    # The null order of patient 1 is on the day of order 0 of patient 0, 20 days before order 1: no line of patient 1 is near.
    assert by_key == dict.fromkeys(range(6), 1)
    inputs = shuffled(got)
    assert inputs and not any("l_extendedprice" in i or "l_returnflag" in i for i in inputs)


def test_medication_use_is_read_from_the_last_anchor(spark):
    rng, day = random.Random(5), datetime(2021, 1, 1)
    pats, names = (1, 2, None), ("insulin", "warfarin", "prednisone 5", "metoprolol", None)
    at = lambda: day + timedelta(days=rng.randrange(200))
    meds = [(rng.choice(pats), rng.choice(names), rng.choice((at(), at(), at(), None)), rng.choice((at(), None)), rng.choice((at(), None)))
            for _ in range(24)]
    cases = [(rng.choice(pats), at()) for _ in range(6)]
    want = {}
    for pat, name, a, b, c in meds:
        b = min([x for x in (b, c) if x] or [datetime(9999, 12, 31)])
        hits = [x for p, x in cases if p == pat and a is not None and a <= x <= b]
        if not hits:
            continue
        long_use = any(x >= a + timedelta(days=30) for x in hits)
        flags = want.setdefault(pat, [0, 0, 0, 0])
        for i, (word, chronic) in enumerate((("insulin", False), ("metoprolol", False), ("prednisone", True), ("warfarin", True))):
            flags[i] |= int(word in (name or "") and (long_use or not chronic))
    got = C.medication_flags(
        spark.createDataFrame(cases, "PAT_ID int, __at timestamp"),
        spark.createDataFrame(meds, "PAT_ID int, GENERIC string, START_DATE timestamp, END_DATE timestamp, DISCON_TIME timestamp"))
    columns = ("Insulin_Rx", "Antihypertensive_Rx", "Immunosuppressant_Rx", "Anticoagulant_Rx")
    assert {r["PAT_ID"]: [r[c] for c in columns] for r in got.collect()} == want
    # One pass for both kinds of use: the anchors are read once.
    assert sum("__an" in i or "__p" in i for i in shuffled(got.select("*"))) <= 5


def test_history_is_met_in_one_pass(spark):
    rng, day = random.Random(6), datetime(2021, 1, 1)
    pats = (1, 2, None)
    at = lambda: day + timedelta(days=rng.randrange(1500))
    problems = [(rng.choice(pats), f"I{rng.randrange(9)}", at(), rng.choice((at(), None))) for _ in range(20)]
    visits = [(rng.choice(pats), f"E{rng.randrange(9)}", at()) for _ in range(20)]
    cases = [(rng.choice(pats), at()) for _ in range(4)]
    want = {(p, c) for p, c, a, b in problems for q, x in cases if p == q and a <= x and (b is None or x <= b)}
    want |= {(p, c) for p, c, a in visits for q, x in cases if p == q and a <= x and a >= x.replace(year=x.year - 2)}
    history = C.dx_history(
        spark.createDataFrame(cases, "PAT_ID int, __at timestamp"),
        spark.createDataFrame(problems, "PAT_ID int, code string, noted timestamp, resolved timestamp"),
        spark.createDataFrame(visits, "PAT_ID int, code string, at timestamp"), pattern=None)
    rows = [(r["PAT_ID"], r["code"]) for r in history.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sum("__an" in i or "__p" in i for i in shuffled(history.select("*"))) <= 5


def test_wide_row_is_shuffled_once_per_key(spark):
    cases = spark.sql("SELECT 1L AS LogID, 1L AS PAT_ID, 1L AS EncounterCSN, DATE'2020-01-01' AS SurgeryDate, 'm' AS PAT_MRN_ID, DATE'1980-01-01' AS BirthDate, "
                      "1 AS SEX_C, 1 AS PAT_TYPE_C, 1 AS ACCT_BASECLS_HA_C, 1 AS ASA_RATE_C, 1L AS HSP_ACCOUNT_ID, 'c' AS PrimaryCPT FROM range(3)")

    def block(key, column):
        return spark.range(3).selectExpr(f"id AS {key}", f"1 AS {column}")
    wide = C.bulk_features(cases.unionByName(cases), {
        "procedures": block("LogID", "OtherProcedures"), "dx": block("PAT_ID", "HF_Dx"), "transfusion": block("LogID", "RBC_Yes"),
        "demographics": block("PAT_ID", "Race"), "social": block("HSP_ACCOUNT_ID", "SDOH_Any_Z"), "label": block("LogID", "DaysToReadmission")})
    row = wide.where("LogID = 1").first()
    assert (row["# of Other Procedures"], row["Heart Failure"], row["SDOH_Any_Z"], row["DaysToReadmission"]) == (1, "Yes", 1, 1)
    assert sum("PAT_MRN_ID" in i or "PrimaryCPT" in i for i in shuffled(wide.select("*"))) <= 3


def test_support_filter_meets_names_at_the_rows(spark, monkeypatch):
    from casetrail.operators import sequences as Q
    rows = [(c, f"f{c % k}", float(v)) for c in range(30) for k, v in ((1, 1), (2, 1), (3, c % 2))] + [(None, "f0", 1.0), (3, None, 1.0)]
    parts = [spark.createDataFrame(rows[i::3], "case int, feature string, value double") for i in range(3)]
    features = parts[0].unionByName(parts[1]).unionByName(parts[2])
    train = features.where("case % 2 = 0")
    shown = {}
    for c, f, v in rows:
        if c is not None and c % 2 == 0 and v > 0:
            shown.setdefault(f, set()).add(c)
    want = sorted((str(r) for r in rows if len(shown.get(r[1], ())) >= 10))
    few = Q.support_filter(features, train, "case", 10)
    assert sorted(str(tuple(r)) for r in few.select("case", "feature", "value").collect()) == want
    # Rows of a frequent feature would all meet in one task.
    assert not shuffled(few.select("*"))
    monkeypatch.setattr(Q, "bounded", lambda df: False)
    many = Q.support_filter(features, train, "case", 10)
    assert sorted(str(tuple(r)) for r in many.select("case", "feature", "value").collect()) == want
    assert any("__salt" in i for i in shuffled(many.select("*")))
