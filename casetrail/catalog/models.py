"""Feature preparation, models and cluster work on order cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.frames import SCORES_SQL, scores
from casetrail.catalog.registry import Tables, query, r6, rounded
from casetrail.catalog.statistics import _AREA_SQL
from casetrail.operators import models as M
from casetrail.operators import prep
from casetrail.operators import stats as E
from casetrail.operators.graph import vector_columns
from casetrail.operators.sampling import kfold
from casetrail.session import cut_lineage

# Order cases with gaps: numbers with outliers, a small whole-number column, two text columns.
_CASES_SQL = """cases AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice * CASE WHEN o_orderkey % 50 = 0 THEN 10 ELSE 1 END END AS price,
  c_acctbal AS bal, (o_orderkey % 4)::INT AS asa, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS status, c_mktsegment AS seg,
  o_orderkey % 5 <> 0 AS train FROM orders JOIN customer ON c_custkey = o_custkey)"""


def cases(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    price = F.when(k % 17 != 0, F.col("o_totalprice") * F.when(k % 50 == 0, 10).otherwise(1))
    return t.orders.join(c, "o_custkey").select(
        k.alias("id"), price.alias("price"), "bal", (k % 4).cast("int").alias("asa"), F.when(k % 9 != 0, F.col("o_orderstatus")).alias(
            "status"), "seg", (k % 5 != 0).alias("train"))


@query("m01_column_types", """
SELECT * FROM (VALUES ('price', 'continuous'), ('bal', 'continuous'), ('asa', 'categorical'), ('status', 'categorical'), ('seg', 'categorical')) v("column", kind)
WHERE (SELECT count(DISTINCT o_totalprice) FROM orders) > 6""")
def _(t: Tables) -> DataFrame:
    return prep.column_types(cases(t), ["id", "train"])


_IQR_SQL = """b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM cases WHERE train),
cl AS (SELECT id, train, CASE WHEN price IS NOT NULL THEN least(greatest(price, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) END AS price, bal, asa, status, seg FROM cases, b)"""


@query("m02_iqr_clip", f"WITH {_CASES_SQL}, {_IQR_SQL} SELECT id, round(price, 4) AS price FROM cl")
def _(t: Tables) -> DataFrame:
    c = cases(t)
    return prep.iqr_clip(c.where("train"), c, ["price"]).select("id", F.round("price", 4).alias("price"))


@query("m03_impute", f"""
WITH {_CASES_SQL} SELECT id, round(coalesce(price, (SELECT avg(price) FROM cases WHERE train)), 4) AS price, coalesce(status, 'Unknown') AS status FROM cases""")
def _(t: Tables) -> DataFrame:
    c = cases(t)
    return prep.impute(c.where("train"), c, ["price"], ["status"]).select("id", F.round("price", 4).alias("price"), "status")


@query("m04_one_hot", f"""
WITH {_CASES_SQL} SELECT id, (coalesce(status, 'Unknown') = 'F')::INT::DOUBLE AS "status_F", (coalesce(status, 'Unknown') = 'O')::INT::DOUBLE AS "status_O",
 (coalesce(status, 'Unknown') = 'Unknown')::INT::DOUBLE AS "status_Unknown" FROM cases""")
def _(t: Tables) -> DataFrame:
    # The train part never shows status P, so P rows get all zeros.
    c = cases(t).select("id", "status", "train")
    return prep.one_hot(c.where("train AND (status IS NULL OR status <> 'P')"), c, "status").drop("train")


@query("m05_standardize", f"""
WITH {_CASES_SQL}, s AS (SELECT avg(bal) AS m, stddev_pop(bal) AS d FROM cases WHERE train) SELECT id, round((bal - m) / d, 6) AS bal FROM cases, s""")
def _(t: Tables) -> DataFrame:
    c = cases(t)
    return rounded(prep.standardise(c.where("train"), c, ["bal"]).select("id", "bal"), "bal")


@query("m06_mask", f"""
WITH {_CASES_SQL} SELECT id, CASE WHEN ('0x' || substr(md5('0:bal:' || id::VARCHAR), 1, 12))::BIGINT / 281474976710656::DOUBLE >= 0.3 THEN bal END AS bal FROM cases""")
def _(t: Tables) -> DataFrame:
    return prep.mask(cases(t), ["id"], {"bal": 0.3}).select("id", "bal")


@query("m07_preprocess", f"""
WITH {_CASES_SQL}, {_IQR_SQL}, m AS (SELECT avg(price) AS mu FROM cl WHERE train), f AS (SELECT cl.*, coalesce(price, mu) AS pf FROM cl, m),
z AS (SELECT avg(pf) AS c, stddev_pop(pf) AS s FROM f WHERE train)
SELECT id, round((pf - c) / s, 6) AS price, (asa = 0)::INT::DOUBLE AS asa_0, (asa = 3)::INT::DOUBLE AS asa_3, (status IS NULL)::INT::DOUBLE AS "status_Unknown",
 (seg = 'BUILDING')::INT::DOUBLE AS "seg_BUILDING" FROM f, z""")
def _(t: Tables) -> DataFrame:
    c = cases(t)
    state = prep.fit_preprocess(c.where("train"), ["id", "train"])
    out = prep.apply_preprocess(c, state, ["id"])
    return rounded(out.select("id", "price", "asa_0", "asa_3", "status_Unknown", "seg_BUILDING"), "price")


@query("m08_node_features", """
WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier), b AS (SELECT quantile_cont(s_acctbal, 0.25) AS q1, quantile_cont(s_acctbal, 0.75) AS q3 FROM s),
c AS (SELECT s_suppkey, least(greatest(s_acctbal, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS a FROM s, b)
SELECT s_suppkey AS "ProvID", round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS bal, (s_suppkey % 3 = 0)::INT::DOUBLE AS "IsResident_N",
 (s_suppkey % 3 <> 0)::INT::DOUBLE AS "IsResident_Y" FROM c""")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    people = t.supplier.select(k.alias("ProvID"), F.col("s_name").alias("ProvName"), F.col("s_acctbal").alias("bal"), F.when(
        k % 3 == 0, "N").otherwise("Y").alias("IsResident"))
    return rounded(prep.provider_features(people)[0], "bal")


def model_frame(t: Tables) -> DataFrame:
    price = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("price"))
    return scores(t).drop("fold").join(price, "id").withColumn("late", (F.col("status") == "F").cast("int"))


_X = ["p", "q", "price", "late"]


@query("m09_forest")
def _(t: Tables) -> DataFrame:
    f = M.dealt(cut_lineage(model_frame(t)))
    model = M.train_model(f, _X, "forest")
    return M.score(model, f, "p_hat").select("id", "y", "p_hat")


@query("m09_boosted")
def _(t: Tables) -> DataFrame:
    f = M.dealt(cut_lineage(model_frame(t)))
    model = M.train_model(f, _X, "boosted")
    return M.score(model, f, "p_hat").select("id", "y", "p_hat")


@query("m09_logistic")
def _(t: Tables) -> DataFrame:
    f = cut_lineage(model_frame(t))
    return M.score(M.train_model(f, _X, "logistic"), f, "p_hat").select("id", "y", "p_hat")


@query("m10_oof_scores")
def _(t: Tables) -> DataFrame:
    return M.oof_scores(model_frame(t), _X, ["id"], maxIter=20)


@query("m11_ensemble", f"""
WITH {SCORES_SQL} SELECT id, round((p + q) / 2, 6) AS p FROM scores""")
def _(t: Tables) -> DataFrame:
    from casetrail.catalog.frames import long_scores
    return rounded(M.ensemble(long_scores(t).withColumnRenamed("s", "p"), ["id"]), "p")


@query("m12_search")
def _(t: Tables) -> DataFrame:
    f = cut_lineage(model_frame(t))
    return M.search(f, _X, "logistic", {"regParam": [0.0, 0.01, 0.1, 1.0]}, folds=3, maxIter=20)[1]


@query("m13_select_vars")
def _(t: Tables) -> DataFrame:
    f = cut_lineage(model_frame(t))
    rows = [("l1", ",".join(M.select_vars(f, _X, "l1"))), ("importance", ",".join(M.select_vars(f, _X, "importance", k=2))),
            ("forward", ",".join(M.select_vars(f, _X, "forward", ids=["id"])))]
    return t.spark.createDataFrame(rows, "method string, columns string")


@query("m14_permutation_importance")
def _(t: Tables) -> DataFrame:
    f = cut_lineage(model_frame(t))
    model = M.train_model(f, _X, "logistic")
    return M.permutation_importance(model, f, {"scores": ["p", "q"], "price": ["price"]}, ["id"])


@query("m15_perturb_median", f"""
WITH {_CASES_SQL} SELECT id, round((SELECT quantile_cont(price, 0.5) FROM cases WHERE train), 4) AS price, 0::DOUBLE AS bal FROM cases""")
def _(t: Tables) -> DataFrame:
    c = cases(t)
    damaged = prep.perturb(prep.perturb(c, ["price"], "median", c.where("train")), ["bal"], "zero")
    return damaged.select("id", F.round("price", 4).alias("price"), "bal")


@query("m15_perturb_shuffle", f"""
WITH {_CASES_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY md5('42:to:' || id::VARCHAR), id) AS r FROM cases),
b AS (SELECT bal, seg, row_number() OVER (ORDER BY md5('42:from:' || id::VARCHAR), id) AS r FROM cases) SELECT id, bal, seg FROM a JOIN b USING (r)""")
def _(t: Tables) -> DataFrame:
    return prep.perturb(cases(t), ["bal", "seg"], "shuffle", ids=["id"]).select("id", "bal", "seg")


@query("m15_keep_only", f"""
WITH {_CASES_SQL} SELECT id, round((SELECT quantile_cont(price, 0.5) FROM cases), 4) AS price, bal, (SELECT quantile_cont(asa::DOUBLE, 0.5) FROM cases) AS asa FROM cases""")
def _(t: Tables) -> DataFrame:
    c = cases(t).drop("train")
    return prep.perturb(c, ["bal"], "keep_only", c, ["id"]).select("id", F.round("price", 4).alias("price"), "bal", "asa")


@query("m15_perturb_mean", f"""
WITH {_CASES_SQL} SELECT id, round((SELECT avg(price) FROM cases WHERE train), 4) AS price, round((SELECT avg(bal) FROM cases WHERE train), 4) AS bal FROM cases""")
def _(t: Tables) -> DataFrame:
    c = cases(t)
    return prep.perturb(c, ["price", "bal"], "mean", c.where("train")).select("id", F.round("price", 4).alias("price"), F.round("bal", 4).alias("bal"))


@query("m15_scenarios", f"""
WITH {SCORES_SQL}, f AS (SELECT id, y, p, q, o_totalprice / 100000 AS price, (status = 'F')::INT::DOUBLE AS late FROM scores JOIN orders ON o_orderkey = id),
md AS (SELECT quantile_cont(p, 0.5) AS p, quantile_cont(q, 0.5) AS q, quantile_cont(price, 0.5) AS price, quantile_cont(late, 0.5) AS late FROM f WHERE id % 5 <> 0),
a AS (SELECT *, row_number() OVER (ORDER BY md5('42:to:' || id::VARCHAR), id) AS r FROM f), b AS (SELECT p, q, price, late, row_number() OVER (ORDER BY md5('42:from:' || id::VARCHAR), id) AS r FROM f),
sc(scenario, p, q, price, late) AS (VALUES ('baseline_clean', 'n', 'n', 'n', 'n'), ('missing_charlson', 'n', 'n', 'n', 'z'), ('missing_utilization', 'n', 'n', 'm', 'n'), ('missing_geocode_sdoh', 'n', 'm', 'n', 'n'),
 ('missing_cpt', 'n', 'n', 'n', 'z'), ('missing_dispo', 'n', 'z', 'n', 'n'), ('missing_order_sequence', 'z', 'n', 'n', 'n'), ('missing_provider_roles', 'n', 'n', 'z', 'z'), ('missing_seq_scalars', 'm', 'n', 'n', 'n'),
 ('wrong_demographics', 's', 'n', 'n', 'n'), ('wrong_sdoh', 'n', 's', 'n', 'n'), ('wrong_cpt', 'n', 'n', 'n', 's'), ('wrong_order_sequence', 's', 'n', 'n', 'n'), ('wrong_provider_roles', 'n', 'n', 's', 's'),
 ('wrong_charlson', 'n', 'n', 'n', 's'), ('wrong_utilization', 'n', 'n', 's', 'n'), ('bare_bones_demog_only', 'n', 'n', 'm', 'm')),
v AS (SELECT scenario, y, {", ".join(f"CASE sc.{c} WHEN 'n' THEN a.{c} WHEN 'z' THEN 0 WHEN 'm' THEN md.{c} ELSE b.{c} END AS {c}" for c in _X)} FROM a JOIN b USING (r), md, sc),
pts AS (SELECT scenario AS g, y, round(p + 0.5 * q + 0.2 * price + 0.3 * late, 6) AS s, count(*) AS w FROM v GROUP BY ALL), {_AREA_SQL}
SELECT g AS scenario, round(auroc, 6) AS auroc FROM area""")
def _(t: Tables) -> DataFrame:
    """Areas of a fixed score under all 17 scenarios, with medians of the rows that are not in fold 0."""
    frame = model_frame(t)
    blocks = {"charlson": ["late"], "utilization": ["price"], "geocode": ["q"], "cpt": ["late"], "dispo": ["q"], "sequence": ["p"],
              "role": ["price", "late"], "seq_scalars": ["p"], "demographics": ["p"]}
    damaged = prep.scenarios(frame, blocks, frame.where("id % 5 <> 0"), ["id"])
    score = F.round(F.col("p") + 0.5 * F.col("q") + 0.2 * F.col("price") + 0.3 * F.col("late"), 6)
    return rounded(E.auroc(damaged.select("scenario", "y", score.alias("s")), ["scenario"], p="s"), "auroc")


@query("m16_within_group_kmeans")
def _(t: Tables) -> DataFrame:
    v = vector_columns(t.embeddings.select("vec_id", (F.col("label") % 2).alias("tier"), "embedding"), "embedding", 64)
    return M.within_group_kmeans(v, "tier", [f"emb_{i}" for i in range(64)], ["vec_id"], (1, 2, 3), 20)


@query("m17_smd_tiers", f"""
WITH {SCORES_SQL}, b AS (SELECT id, y, least(floor((row_number() OVER (ORDER BY p, md5('42:' || id::VARCHAR)) * 6 - 1) / count(*) OVER ()::DOUBLE), 5)::INT AS bin FROM scores)
SELECT bin, count(*) AS n, sum(y)::BIGINT AS events FROM b GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    # The bins under the tiers; merging is checked on hand-made rows in the tests.
    from casetrail.operators.sampling import rank_bins
    return rank_bins(scores(t).select("id", "p", "y"), "p", ["id"], 6).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))


@query("m17_smd_tier_rows")
def _(t: Tables) -> DataFrame:
    return M.smd_tiers(scores(t).select("id", "p", "y"), ["id"], closest=True)[0].select("id", "tier")


@query("m18_rank_clusters", f"""
WITH {SCORES_SQL}, c AS (SELECT status AS k, avg(CASE WHEN fold <> 0 THEN y END) AS r FROM scores GROUP BY 1), o AS (SELECT k, row_number() OVER (ORDER BY r, k) - 1 AS tier FROM c)
SELECT id, tier::INT AS tier FROM scores JOIN o ON o.k = status""")
def _(t: Tables) -> DataFrame:
    s = scores(t).withColumn("train", (F.col("fold") != 0).cast("int"))
    return M.rank_clusters(s, "status", "y", "train").select("id", "tier")


@query("m19_consensus", f"""
WITH {SCORES_SQL}, l AS (SELECT id, (id % 3)::INT AS k FROM scores UNION ALL SELECT id, (id % 2)::INT FROM scores UNION ALL SELECT id, y FROM scores),
v AS (SELECT id, k, count(*) AS votes, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, k) AS rn FROM l GROUP BY 1, 2) SELECT id, k, votes FROM v WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    s = scores(t)
    rows = s.select("id", (F.col("id") % 3).cast("int").alias("k")).unionByName(s.select("id", (F.col("id") % 2).cast("int").alias("k"))).unionByName(
        s.select("id", F.col("y").alias("k")))
    return M.consensus(rows, ["id"], "k")


@query("m21_group_deviation", f"""
WITH {SCORES_SQL}, m AS (SELECT avg(p) AS a, stddev_pop(p) AS b, avg(q) AS c, stddev_pop(q) AS d FROM scores),
g AS (SELECT y, avg((p - a) / (b + 1e-8)) AS p, avg((q - c) / (d + 1e-8)) AS q FROM scores, m GROUP BY 1), u AS (SELECT y, 'p' AS feature, p AS v FROM g UNION ALL SELECT y, 'q', q FROM g)
SELECT y, feature, round(v, 6) AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(v) DESC, feature) AS rn FROM u) WHERE rn <= 1""")
def _(t: Tables) -> DataFrame:
    return rounded(M.group_deviation(scores(t), "y", ["p", "q"], 1), "deviation")


@query("m22_batch_score")
def _(t: Tables) -> DataFrame:
    from casetrail.catalog.texts import scratch
    f = cut_lineage(model_frame(t))
    path = scratch(t, "model")
    M.save_model(M.train_model(f, _X, "logistic"), path)
    return M.batch_score(path, f.drop("y")).select("id", "p", "flag")


@query("m22_scores_after_reload", f"WITH {SCORES_SQL} SELECT id, true AS same FROM scores")
def _(t: Tables) -> DataFrame:
    """A model scores the same before it is saved and after it is read back."""
    from casetrail.catalog.texts import scratch
    f = cut_lineage(model_frame(t))
    path, model = scratch(t, "model"), M.train_model(f, _X, "logistic")
    M.save_model(model, path)
    again = M.batch_score(path, f).select("id", F.col("p").alias("after"))
    return M.score(model, f, "before").select("id", "before").join(again, "id").select("id", (F.col("before") == F.col("after")).alias("same"))


@query("m10_oof_rows", f"""
WITH {SCORES_SQL}, r AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id::VARCHAR), id) - 1) % 5 AS fold FROM scores)
SELECT id, y, fold::INT AS fold, true AS is_probability FROM r""")
def _(t: Tables) -> DataFrame:
    """Every row is scored once, in its own fold."""
    found = M.oof_scores(model_frame(t), _X, ["id"], calibrate=False, maxIter=20)
    return found.select("id", "y", "fold", F.col("p").between(0.0, 1.0).alias("is_probability"))


@query("m26_pca_variance", "WITH v AS (" + " UNION ALL ".join(f"SELECT var_pop(embedding[{i + 1}]::DOUBLE) AS x FROM embeddings" for i in range(64)) + ") SELECT round(sum(x), 4) AS variance, 0::BIGINT AS unordered FROM v")
def _(t: Tables) -> DataFrame:
    """All components together hold the variance of the columns, and none holds more than the one before."""
    v = vector_columns(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    parts = M.pca(v, [f"emb_{i}" for i in range(64)], 64, ["vec_id"]).agg(*[F.var_pop(f"pc_{i}").alias(f"v{i}") for i in range(64)])
    rising = sum(((F.col(f"v{i}") > F.col(f"v{i - 1}") * (1 + 1e-9)).cast("long") for i in range(1, 64)), F.lit(0).cast("long"))
    return parts.select(F.round(sum((F.col(f"v{i}") for i in range(64)), F.lit(0.0)), 4).alias("variance"), rising.alias("unordered"))


@query("m04_sparse_one_hot", """
SELECT o_orderkey AS id, 'prio_' || o_orderpriority AS feature FROM orders UNION ALL SELECT o_orderkey, 'cust_' || o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0)""")
def _(t: Tables) -> DataFrame:
    """A column of many levels next to one of few, in long form."""
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prio"), F.col("o_custkey").alias("cust"))
    return prep.sparse_one_hot(o.where("id % 5 <> 0"), o, ["prio", "cust"], ["id"])


@query("m20_agreement", f"""
WITH {SCORES_SQL}, x AS (SELECT floor(p * 3)::INT AS a, floor(q * 3)::INT AS b FROM scores), n AS (SELECT count(*)::DOUBLE AS n, sum((a = b)::INT) AS same, max(a) AS ma, max(b) AS mb FROM x),
e AS (SELECT sum(ca.c::DOUBLE * cb.c) AS e FROM (SELECT a AS k, count(*) AS c FROM x GROUP BY 1) ca JOIN (SELECT b AS k, count(*) AS c FROM x GROUP BY 1) cb USING (k)),
h AS (SELECT sum((a = ma AND b = mb)::INT)::BIGINT AS high_both, sum((a = ma OR b = mb)::INT)::BIGINT AS high_any, sum((a = ma AND b = 0)::INT)::BIGINT AS a_high_b_low, sum((b = mb AND a = 0)::INT)::BIGINT AS b_high_a_low FROM x, n)
SELECT round((same / n - e / n / n) / (1 - e / n / n), 6) AS kappa, high_both, high_any, round(high_both / greatest(high_any, 1)::DOUBLE, 6) AS jaccard, a_high_b_low, b_high_a_low FROM n, e, h""")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.stats import agreement
    tiers = scores(t).select(F.floor(F.col("p") * 3).cast("int").alias("a"), F.floor(F.col("q") * 3).cast("int").alias("b"))
    return rounded(agreement(tiers, "a", "b"), "kappa", "jaccard")


@query("m23_lead_units", f"""
WITH {SCORES_SQL}, k AS (SELECT id, status FROM scores), s AS (SELECT DISTINCT l_orderkey AS id, l_returnflag || (l_suppkey % 7)::VARCHAR AS unit FROM lineitem), j AS (SELECT status, unit, id FROM s JOIN k USING (id)),
z AS (SELECT status, count(*) AS size FROM k GROUP BY 1), w AS (SELECT unit, count(*) AS whole FROM j GROUP BY 1), c AS (SELECT status, unit, count(*) AS n FROM j GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT status, unit AS lead_unit FROM (SELECT status, unit, row_number() OVER (PARTITION BY status ORDER BY n::DOUBLE / size / whole DESC, unit) AS rn FROM c JOIN z USING (status) JOIN w USING (unit)) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.relational import lead_units
    stays = t.lineitem.select(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", (F.col("l_suppkey") % 7).cast("string")).alias("unit"))
    return lead_units(stays, scores(t).select("id", "status"), "id", "status", "unit")


@query("m23_name_clusters", f"""
WITH {SCORES_SQL}, g AS (SELECT status, 100.0::DOUBLE * avg((p >= 0.6)::INT) AS icu, 100.0::DOUBLE * avg((q >= 0.5)::INT) AS o, 100.0::DOUBLE * avg((patient % 2 = 0)::INT) AS inp,
 100.0::DOUBLE * avg((patient % 3 = 0)::INT) AS asa FROM scores GROUP BY 1)
SELECT status, CASE WHEN icu >= 25 THEN 'ICU/critical-care' WHEN o >= 40 THEN 'ambulatory/procedural' ELSE 'inpatient-ward' END || ', ' || CASE WHEN inp >= 55 THEN 'inpatient'
 WHEN inp <= 35 THEN 'outpatient' ELSE 'mixed' END || ', ' || CASE WHEN asa >= 55 THEN 'high-acuity' WHEN asa <= 35 THEN 'low-acuity' ELSE 'mixed-acuity' END AS name FROM g""")
def _(t: Tables) -> DataFrame:
    from casetrail.operators.relational import cluster_profile, name_clusters
    none = F.lit(False)
    profile = cluster_profile(scores(t), "status", [], {
        "pct_icu": F.col("p") >= 0.6, "pct_or_only": F.col("q") >= 0.5, "pct_ed": none, "asa_ge3": F.col("patient") % 3 == 0,
        "inpatient": F.col("patient") % 2 == 0, "pct_highvol": none, "pct_resident": none})
    return profile.select("status", name_clusters(profile).alias("name"))


@query("m24_likelihood_ratio")
def _(t: Tables) -> DataFrame:
    f = cut_lineage(model_frame(t))
    found = M.likelihood_ratio(f, ["price", "late"], ["p", "q"])
    return t.spark.createDataFrame([tuple(float(v) for v in found.values())], [*found])


@query("m25_ablate")
def _(t: Tables) -> DataFrame:
    blocks = {"base": ["price", "late"], "p": ["p"], "q": ["q"]}
    return M.ablate(model_frame(t), blocks, [("base",), ("base", "p"), ("base", "p", "q")], ["id"], maxIter=20)


@query("m26_pca")
def _(t: Tables) -> DataFrame:
    v = vector_columns(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    got = M.pca(v, [f"emb_{i}" for i in range(64)], 32, ["vec_id"])
    return got.select("vec_id", *[r6(F.abs(f"pc_{i}")).alias(f"pc_{i}") for i in range(32)])


@query("m27_outcome_panel", f"""
WITH {SCORES_SQL}, o AS (SELECT fold, 'a' AS outcome, y FROM scores UNION ALL SELECT fold, 'b', (p >= 0.93)::INT FROM scores)
SELECT outcome, fold, count(y) AS n, sum(y)::BIGINT AS events, (sum(y) < 60)::INT AS low_count FROM o GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    s = scores(t).select("fold", F.col("y").alias("a"), (F.col("p") >= 0.93).cast("int").alias("b"))
    return M.outcome_panel(s, ["a", "b"], low=60)


@query("m28_confounders", """
WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN 20 + o_orderkey % 60 END AS age, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, o_orderkey % 5 <> 0 AS train FROM orders),
m AS (SELECT quantile_cont(age::DOUBLE, 0.5) AS md FROM c WHERE train), f AS (SELECT c.*, coalesce(age, md) AS a FROM c, m), z AS (SELECT avg(a) AS mu, stddev_pop(a) AS sd FROM f WHERE train)
SELECT id, round((a - mu) / (sd + 1e-8), 6) AS age_z, (sex = 'F')::INT::DOUBLE AS "Gender_F", (sex = 'M')::INT::DOUBLE AS "Gender_M" FROM f, z""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    c = t.orders.select(k.alias("id"), F.when(k % 17 != 0, 20 + k % 60).alias("AgeYears"), F.when(k % 2 == 0, "F").otherwise("M").alias(
        "Gender"), (k % 5 != 0).alias("train"))
    return rounded(prep.confounders(c, c.where("train"), ["id"]), "age_z")


@query("m10_fold_sizes", f"""
WITH {SCORES_SQL}, r AS (SELECT y, (row_number() OVER (PARTITION BY y ORDER BY md5('42:' || id::VARCHAR)) - 1) % 5 AS fold FROM scores)
SELECT y, fold::INT AS fold, count(*) AS n FROM r GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return kfold(scores(t).drop("fold"), "y", ["id"]).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))
