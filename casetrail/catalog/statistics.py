"""Evaluation statistics on order scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.frames import LONG_SQL, SCORES_SQL, long_scores, scores
from casetrail.catalog.registry import Tables, query, r6, rounded
from casetrail.operators import stats as E

# AUROC and average precision per group g over rows (g, y, s), with weights w.
_AREA_SQL = """cells AS (SELECT g, s, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM pts GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER a - pos AS pb, sum(neg) OVER a - neg AS nb, sum(pos) OVER (PARTITION BY g) AS pt, sum(neg) OVER (PARTITION BY g) AS nt
  FROM cells WINDOW a AS (PARTITION BY g ORDER BY s)),
area AS (SELECT g, sum(pos * (nb + neg / 2::DOUBLE)) / (max(pt)::DOUBLE * max(nt)) AS auroc,
  sum((pos / pt::DOUBLE) * ((pt - pb) / ((pt - pb) + (nt - nb))::DOUBLE)) AS auprc FROM cum WHERE pt > 0 AND nt > 0 GROUP BY 1)"""


@query("e01_op_metrics", f"""
WITH {SCORES_SQL}, c AS (SELECT status, count(CASE WHEN p >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.5 AND y = 0 THEN 1 END) AS fp,
 count(CASE WHEN p < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p < 0.5 AND y = 0 THEN 1 END) AS tn FROM scores GROUP BY 1)
SELECT status, tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(tn / (tn + fp)::DOUBLE, 6) AS specificity,
 round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS flag_rate FROM c""")
def _(t: Tables) -> DataFrame:
    return rounded(E.op_metrics(scores(t), 0.5, ["status"]), "precision", "recall", "specificity", "f1", "flag_rate")


@query("e02_auroc", f"""
WITH {LONG_SQL}, r AS (SELECT model, y, (rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2::DOUBLE) AS rk FROM long)
SELECT model, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)), 6) AS auroc FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.auroc(long_scores(t), ["model"], p="s"), "auroc")


@query("e03_average_precision", f"""
WITH {LONG_SQL}, pts AS (SELECT model AS g, y, s, 1 AS w FROM long), {_AREA_SQL} SELECT g AS model, round(auprc, 6) AS auprc FROM area""")
def _(t: Tables) -> DataFrame:
    return rounded(E.average_precision(long_scores(t), ["model"], p="s"), "auprc")


@query("e04_brier", f"WITH {LONG_SQL} SELECT model, round(avg((s - y) * (s - y)), 6) AS brier FROM long GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rounded(E.brier(long_scores(t), ["model"], p="s"), "brier")


_GRID = [round(0.05 * i, 2) for i in range(1, 19)]
_GRID_SQL = "grid(t) AS (VALUES " + ", ".join(f"({g}::DOUBLE)" for g in _GRID) + ")"
_CONF_SQL = """conf AS (SELECT t, count(CASE WHEN p >= t AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= t AND y = 0 THEN 1 END) AS fp,
  count(CASE WHEN p < t AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p < t AND y = 0 THEN 1 END) AS tn, count(*) AS n FROM scores, grid GROUP BY 1)"""


@query("e05_best_threshold_grid", f"""
WITH {SCORES_SQL}, {_GRID_SQL}, {_CONF_SQL}, f AS (SELECT t, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 12) AS f1 FROM conf WHERE tp + fp >= 5)
SELECT t AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.best_threshold(scores(t), _GRID, minimum_flagged=5), "f1")


@query("e05_best_threshold_scores", f"""
WITH {SCORES_SQL}, c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY 1), d AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp,
 sum(n) OVER (ORDER BY p DESC) AS flagged, sum(pos) OVER () AS pt FROM c), f AS (SELECT p, round(2 * tp / (flagged + pt)::DOUBLE, 12) AS f1 FROM d)
SELECT p AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, p LIMIT 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.best_threshold(scores(t)), "f1")


# Bootstrap: copies of a row in replicate b by a Poisson law of its hash; rows are summed to distinct scores per replicate.
_COPIES_SQL = " + ".join(f"(u >= '{c}')::INT" for c in E.poisson_limits())
_DRAW_SQL = SCORES_SQL + f""", shares AS (SELECT b, y, p, q, substr(md5('0:' || (b // 4)::VARCHAR || ':' || id::VARCHAR), (8 * (b % 4) + 1)::INT, 8) AS u FROM scores, range({{0}}) r(b)),
picked AS (SELECT b, y, p, q, {_COPIES_SQL} AS w FROM shares WHERE u >= '{E.poisson_limits(1)[0]}')"""
REPLICATES = 1000


@query("e06_bootstrap_ci", f"""
WITH {_DRAW_SQL.format(REPLICATES)}, pts AS (SELECT b AS g, y, p AS s, sum(w) AS w FROM picked GROUP BY ALL), {_AREA_SQL}, m AS (SELECT 'auroc' AS metric, auroc AS v FROM area UNION ALL SELECT 'auprc', auprc FROM area)
SELECT metric, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi, count(*) AS n_replicates FROM m GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.bootstrap_ci(scores(t), ["id"], replicates=REPLICATES), "lo", "hi")


@query("e07_paired_bootstrap", f"""
WITH {_DRAW_SQL.format(REPLICATES)}, pts AS (SELECT b::VARCHAR || 'p' AS g, y, p AS s, sum(w) AS w FROM picked GROUP BY ALL UNION ALL SELECT b::VARCHAR || 'q', y, q, sum(w) FROM picked GROUP BY ALL), {_AREA_SQL},
gap AS (SELECT a.g AS b, c.auroc - a.auroc AS au, c.auprc - a.auprc AS ap FROM area a JOIN area c ON c.g = replace(a.g, 'p', 'q') WHERE a.g LIKE '%p'),
m AS (SELECT 'auroc' AS metric, au AS v FROM gap UNION ALL SELECT 'auprc', ap FROM gap)
SELECT metric, round(avg(v), 6) AS mean_gap, avg((v > 0)::INT) AS p_gt0, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.paired_bootstrap(scores(t), ["id"], "p", "q", replicates=REPLICATES), "mean_gap", "p_gt0", "lo", "hi")


@query("e08_decision_curve", f"""
WITH {SCORES_SQL}, {_GRID_SQL}, {_CONF_SQL} SELECT t AS threshold, round(tp / n::DOUBLE - (fp / n::DOUBLE) * (t / (1 - t)), 6) AS net_benefit,
 round((tp + fn) / n::DOUBLE - (1 - (tp + fn) / n::DOUBLE) * (t / (1 - t)), 6) AS treat_all, 0::DOUBLE AS treat_none FROM conf""")
def _(t: Tables) -> DataFrame:
    return rounded(E.decision_curve(scores(t), _GRID), "net_benefit", "treat_all")


def flagged(t: Tables) -> DataFrame:
    return scores(t).withColumn("any_flag", (F.col("patient") % 7 == 0).cast("int"))


@query("e09_alert_table", f"""
WITH {SCORES_SQL}, {_GRID_SQL}, x AS (SELECT t, y, p >= t AS r, patient % 7 = 0 AS f FROM scores, grid),
c AS (SELECT t, count(*)::DOUBLE AS n, sum(r::INT) AS rn, sum((r OR f)::INT) AS un, sum((f AND NOT r)::INT) AS fo, sum(CASE WHEN f AND NOT r THEN y ELSE 0 END) AS foy,
 sum(CASE WHEN r THEN y ELSE 0 END) AS tp, sum(CASE WHEN r THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN r OR f THEN y ELSE 0 END) AS utp, sum(CASE WHEN r OR f THEN 1 - y ELSE 0 END) AS ufp FROM x GROUP BY 1)
SELECT t AS threshold, rn::BIGINT AS risk_n, un::BIGINT AS union_n, fo::BIGINT AS feat_only_n, round(CASE WHEN fo > 0 THEN 100.0 * foy / fo::DOUBLE ELSE 0 END, 6) AS feat_only_pct,
 round(tp / n - fp / n * (t / (1 - t)), 6) AS nb_risk, round(utp / n - ufp / n * (t / (1 - t)), 6) AS nb_union,
 round((utp / n - ufp / n * (t / (1 - t))) - (tp / n - fp / n * (t / (1 - t))), 6) AS dnb FROM c""")
def _(t: Tables) -> DataFrame:
    return rounded(E.alert_table(flagged(t), _GRID), "feat_only_pct", "nb_risk", "nb_union", "dnb")


@query("e09_flag_table", f"""
WITH {SCORES_SQL}, l AS (SELECT 'a' AS flag, y, p FROM scores WHERE patient % 7 = 0 UNION ALL SELECT 'b', y, p FROM scores WHERE patient % 5 = 0)
SELECT flag, count(*) AS n, round(100.0::DOUBLE * avg(y), 6) AS event_pct, count(CASE WHEN p < 0.4 THEN 1 END) AS missed_n,
 round(100.0::DOUBLE * avg(CASE WHEN p < 0.4 THEN y END), 6) AS missed_event_pct, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM scores), 6) AS pct_cohort FROM l GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    s = scores(t).withColumns({"a": (F.col("patient") % 7 == 0).cast("int"), "b": (F.col("patient") % 5 == 0).cast("int")})
    return rounded(E.flag_table(s, ["a", "b"], 0.4), "event_pct", "missed_event_pct", "pct_cohort")


@query("e10_delong", f"""
WITH {LONG_SQL}, z AS (SELECT id, y, model, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2::DOUBLE AS tz,
  rank() OVER (PARTITION BY model, y ORDER BY s) + (count(*) OVER (PARTITION BY model, y, s) - 1) / 2::DOUBLE AS tx, sum(y) OVER (PARTITION BY model) AS m,
  sum(1 - y) OVER (PARTITION BY model) AS n FROM long),
v AS (SELECT id, y, any_value(m) AS m, any_value(n) AS n, max(CASE WHEN model = 'p' THEN CASE WHEN y = 1 THEN (tz - tx) / n ELSE 1 - (tz - tx) / m END END) AS va,
  max(CASE WHEN model = 'q' THEN CASE WHEN y = 1 THEN (tz - tx) / n ELSE 1 - (tz - tx) / m END END) AS vb FROM z GROUP BY 1, 2),
a AS (SELECT avg(CASE WHEN y = 1 THEN va END) AS auroc_a, avg(CASE WHEN y = 1 THEN vb END) AS auroc_b,
 var_samp(CASE WHEN y = 1 THEN va END) / max(m) + var_samp(CASE WHEN y = 0 THEN va END) / max(n) AS va,
 var_samp(CASE WHEN y = 1 THEN vb END) / max(m) + var_samp(CASE WHEN y = 0 THEN vb END) / max(n) AS vb,
 covar_samp(CASE WHEN y = 1 THEN va END, CASE WHEN y = 1 THEN vb END) / max(m) + covar_samp(CASE WHEN y = 0 THEN va END, CASE WHEN y = 0 THEN vb END) / max(n) AS cab FROM v)
SELECT round(auroc_a, 6) AS auroc_a, round(auroc_b, 6) AS auroc_b, round(va * 1e4, 6) AS var_a, round(vb * 1e4, 6) AS var_b, round(cab * 1e4, 6) AS cov_ab,
 round((auroc_a - auroc_b) / sqrt(va + vb - 2 * cab), 4) AS z FROM a""")
def _(t: Tables) -> DataFrame:
    d = E.delong(scores(t), ["id"], "p", "q")
    return d.select(r6("auroc_a").alias("auroc_a"), r6("auroc_b").alias("auroc_b"), *[
        r6(F.col(c) * 1e4).alias(c) for c in ("var_a", "var_b", "cov_ab")], F.round("z", 4).alias("z"))


_FOLD_AREA = f"""WITH {LONG_SQL}, pts AS (SELECT model || fold::VARCHAR AS g, y, s, 1 AS w FROM long), {_AREA_SQL},
f AS (SELECT left(g, 1) AS model, substr(g, 2) AS fold, auroc, auprc FROM area)"""


@query("e11_fold_deltas", f"""
{_FOLD_AREA} SELECT a.model, round(avg(a.auroc - b.auroc), 6) AS d_auroc, count(CASE WHEN a.auroc > b.auroc THEN 1 END) AS auroc_folds_gt0,
 round(avg(a.auprc - b.auprc), 6) AS d_auprc, count(CASE WHEN a.auprc > b.auprc THEN 1 END) AS auprc_folds_gt0, count(*) AS folds
FROM f a JOIN f b ON a.fold = b.fold AND b.model = 'p' WHERE a.model = 'q' GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.fold_deltas(long_scores(t), "p", p="s"), "d_auroc", "d_auprc")


@query("e12_pairwise_smd", f"""
WITH {SCORES_SQL}, r AS (SELECT status AS g, avg(y) AS p FROM scores GROUP BY 1)
SELECT a.g AS group_a, b.g AS group_b, round(abs(a.p - b.p) / (sqrt((a.p * (1 - a.p) + b.p * (1 - b.p)) / 2) + 1e-6), 6) AS smd FROM r a JOIN r b ON a.g < b.g""")
def _(t: Tables) -> DataFrame:
    rates = scores(t).groupBy("status").agg(F.avg("y").alias("rate"))
    return rounded(E.pairwise_smd(rates, "status", "rate"), "smd")


@query("e13_tier_table", f"""
WITH {SCORES_SQL}, x AS (SELECT floor(p * 4)::INT AS tier, fold, count(*) AS n, sum(y) AS y FROM scores GROUP BY 1, 2)
SELECT tier, sum(n)::BIGINT AS n, round(avg(y / n::DOUBLE), 6) AS mean_rate, round(stddev_samp(y / n::DOUBLE), 6) AS sd_rate, round(sum(y) / sum(n)::DOUBLE, 6) AS pooled_rate FROM x GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.tier_table(tiers(t), "tier", "fold"), "mean_rate", "sd_rate", "pooled_rate")


def tiers(t: Tables) -> DataFrame:
    return scores(t).withColumn("tier", F.floor(F.col("p") * 4).cast("int"))


@query("e13_tier_ratio", f"""
WITH {SCORES_SQL}, x AS (SELECT fold, floor(p * 4)::INT AS tier, avg(y) AS r FROM scores GROUP BY 1, 2)
SELECT fold, round(arg_max(r, tier), 6) AS high, round(arg_min(r, tier), 6) AS low, round(arg_max(r, tier) / nullif(arg_min(r, tier), 0), 6) AS ratio FROM x GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.tier_ratio(tiers(t), "tier", "fold"), "high", "low", "ratio")


@query("e14_subgroup_by_tier", f"""
WITH {SCORES_SQL}, s AS (SELECT floor(p * 4)::INT AS tier, y, patient % 7 = 0 AS f FROM scores), r AS (SELECT tier, avg(y) AS rate FROM s GROUP BY 1)
SELECT tier, count(*) AS n, round(avg(y), 6) AS rate, round(avg(f::INT), 6) AS flag_share,
 round((SELECT avg(CASE WHEN f THEN y END) / avg(CASE WHEN NOT f THEN y END) FROM s), 6) AS flag_risk_ratio, round((SELECT max(rate) / min(rate) FROM r WHERE rate > 0), 6) AS tier_ratio
FROM s GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    s = tiers(t).withColumn("f", (F.col("patient") % 7 == 0).cast("int"))
    return rounded(E.subgroup_by_tier(s, "tier", "f"), "rate", "flag_share", "flag_risk_ratio", "tier_ratio")


@query("e15_cv_summary", f"""
{_FOLD_AREA} SELECT model, round(avg(auroc), 6) AS auroc_mean, round(stddev_pop(auroc), 6) AS auroc_sd, round(avg(auprc), 6) AS auprc_mean, round(stddev_pop(auprc), 6) AS auprc_sd
FROM f GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(E.cv_summary(long_scores(t), p="s"), "auroc_mean", "auroc_sd", "auprc_mean", "auprc_sd")


@query("m20_adjusted_rand", f"""
WITH {SCORES_SQL}, s AS (SELECT floor(p * 4)::INT AS a, status || (y * 2)::VARCHAR AS b FROM scores), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2),
i AS (SELECT sum(n * (n - 1) / 2) AS v FROM c), ra AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)),
rb AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b)), t AS (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS v FROM s)
SELECT round((i.v - ra.v * rb.v / t.v) / ((ra.v + rb.v) / 2 - ra.v * rb.v / t.v), 6) AS ari FROM i, ra, rb, t""")
def _(t: Tables) -> DataFrame:
    s = tiers(t).withColumn("b", F.concat("status", (F.col("y") * 2).cast("string")))
    return rounded(E.adjusted_rand(s, "tier", "b"), "ari")


@query("m20_high_overlap", f"""
WITH {SCORES_SQL} SELECT sum((p >= 0.7)::INT)::BIGINT AS a, sum((q >= 0.7)::INT)::BIGINT AS b, sum((p >= 0.7 OR q >= 0.7)::INT)::BIGINT AS union_n,
 sum((p >= 0.7 AND q >= 0.7)::INT)::BIGINT AS common_n FROM scores""")
def _(t: Tables) -> DataFrame:
    return E.high_overlap(scores(t), {"a": F.col("p") >= 0.7, "b": F.col("q") >= 0.7})
