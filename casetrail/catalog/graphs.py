"""Graph queries on order-part and event-user links and on the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.catalog.frames import LINKS_SQL, SCORES_SQL, links, train_labels
from casetrail.catalog.registry import Tables, query, r6, rounded
from casetrail.catalog.relational import signup_stays
from casetrail.operators import graph as G
from casetrail.operators import temporal as J

_Y_SQL = SCORES_SQL + ", lab AS (SELECT id AS c, y, (fold <> 0)::INT AS t FROM scores)"


@query("g01_build_graph", """
WITH k AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT 'case' AS src_type, count(*) AS n, count(DISTINCT l_orderkey) AS srcs, count(DISTINCT l_partkey) AS dsts, sum(l_quantity) AS weight FROM k
UNION ALL SELECT 'node', count(*), count(DISTINCT l_partkey), count(DISTINCT l_orderkey), sum(l_quantity) FROM k""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    _, edges = G.build_graph(t.lineitem, cases, "l_orderkey", "l_partkey", "l_quantity")
    return edges.groupBy("src_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("srcs"),
                                         F.count_distinct("dst").alias("dsts"), F.sum("weight").alias("weight"))


@query("g01_node_ids", """
SELECT 'node' AS type, l_partkey::VARCHAR AS name, row_number() OVER (ORDER BY md5('42:' || l_partkey::VARCHAR)) - 1 AS id FROM (SELECT DISTINCT l_partkey FROM lineitem)
UNION ALL SELECT 'case', o_orderkey::VARCHAR, row_number() OVER (ORDER BY md5('42:' || o_orderkey::VARCHAR)) - 1 FROM orders""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return G.build_graph(t.lineitem, cases, "l_orderkey", "l_partkey")[0]


@query("g02_concept_edges", """
SELECT l_orderkey AS c, 'part' AS dst_type, l_partkey::VARCHAR AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 3
UNION ALL SELECT l_orderkey, 'supplier', l_suppkey::VARCHAR, count(*) FROM lineitem GROUP BY 1, 3
UNION ALL SELECT o_orderkey, 'flag', 'urgent', 1 FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT o_orderkey, 'flag', 'filled', 1 FROM orders WHERE o_orderstatus = 'F'""")
def _(t: Tables) -> DataFrame:
    line = t.lineitem.withColumnRenamed("l_orderkey", "c")
    flags = t.orders.select(F.col("o_orderkey").alias("c"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
                            (F.col("o_orderstatus") == "F").alias("filled"))
    return G.concept_edges("c", {"part": (line, "l_partkey"), "supplier": (line, "l_suppkey")}, flags, ["urgent", "filled"], "flag")


@query("g03_token_unit_edges", """
WITH st AS (SELECT user_id, event_id AS stay, ts AS a, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - INTERVAL 1 HOUR, ts + INTERVAL 2 DAY) AS b
  FROM events WHERE event_type = 'signup')
SELECT DISTINCT e.event_type || (e.event_id % 5)::VARCHAR AS token, st.stay % 10 AS unit FROM events e JOIN st ON st.user_id = e.user_id
 AND st.a = (SELECT max(x.a) FROM st x WHERE x.user_id = e.user_id AND x.a <= e.ts) WHERE e.ts <= st.b""")
def _(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "ts", F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("token"))
    found = J.asof_containing(events, signup_stays(t), ["user_id"], "ts", "a", "b", ["stay"])
    return found.select("token", (F.col("stay") % 10).alias("unit")).distinct()


@query("g04_graph_stats", f"""
WITH {LINKS_SQL}, d AS (SELECT n, count(*) AS deg FROM links GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS n_cases, count(*) AS n_nodes, (SELECT sum(m)::BIGINT FROM links) AS n_rows, (SELECT count(*) FROM links) AS n_pairs,
 quantile_cont(deg::DOUBLE, 0.5) AS median_degree, max(deg) AS max_degree, round((SELECT count(DISTINCT c) FROM links) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS linked_share FROM d""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select(F.col("o_orderkey").alias("c"))
    return rounded(G.graph_stats(links(t), cases, "c", "n"), "linked_share")


@query("g05_degree_features", """
SELECT l_orderkey AS c, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS "A", count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS "N",
 count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS "R" FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return G.degree_features(t.lineitem.select(F.col("l_orderkey").alias("c"), "l_returnflag"), "c", "l_returnflag", ["A", "N", "R"])


@query("g06_shared_counts", f"""
WITH {LINKS_SQL} SELECT a.c AS c_a, b.c AS c_b, count(*) AS shared FROM links a JOIN links b ON a.n = b.n AND a.c < b.c GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(t: Tables) -> DataFrame:
    return G.shared_counts(links(t), "c", "n", 2)


@query("g07_neighbour_rate", f"""
WITH {_Y_SQL}, {LINKS_SQL}, s AS (SELECT n, sum(m * y * t) AS sy, sum(m * t) AS st FROM links JOIN lab USING (c) GROUP BY 1),
r AS (SELECT c, sum(m * sy) AS num, sum(m * st) AS den FROM links JOIN s USING (n) GROUP BY 1)
SELECT c, round(coalesce(num / greatest(den, 1)::DOUBLE, 0), 6) AS rate FROM lab LEFT JOIN r USING (c)""")
def _(t: Tables) -> DataFrame:
    return rounded(G.neighbour_rate(links(t), train_labels(t), "c", "n", "y", "train"), "rate")


@query("g08_neighbour_rate_threshold", f"""
WITH {_Y_SQL}, {LINKS_SQL}, p AS (SELECT a.c, b.c AS o FROM links a JOIN links b ON a.n = b.n GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT p.c, sum(y * t) AS num, sum(t) AS den FROM p JOIN lab ON lab.c = p.o GROUP BY 1)
SELECT c, round(coalesce(num / greatest(den, 1)::DOUBLE, 0), 6) AS rate FROM lab LEFT JOIN r USING (c)""")
def _(t: Tables) -> DataFrame:
    return rounded(G.neighbour_rate_thr(links(t), train_labels(t), "c", "n", "y", "train", 2), "rate")


@query("g09_cooccurrence_knn", f"""
WITH {LINKS_SQL}, p AS (SELECT a.c, b.c AS o, count(*) AS s FROM links a JOIN links b ON a.n = b.n AND a.c <> b.c GROUP BY 1, 2),
k AS (SELECT c AS src, o AS dst, s AS shared FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s DESC, o) AS rk FROM p) WHERE rk <= 8)
SELECT * FROM k UNION SELECT dst, src, shared FROM k""")
def _(t: Tables) -> DataFrame:
    return G.cooccurrence_knn(links(t), "c", "n", 8)


@query("g10_knn_edges", """
WITH d AS (SELECT a.vec_id::VARCHAR AS src, b.vec_id::VARCHAR AS dst, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT src, dst, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rk FROM d) WHERE rk <= 10)
SELECT src, dst, distance FROM k""")
def _(t: Tables) -> DataFrame:
    return rounded(G.knn_edges(t.embeddings, "vec_id", "embedding", 10, symmetric=False), "distance")


_NBR_SQL = """e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1),
v AS (SELECT s_suppkey AS b, s_acctbal AS x, s_nationkey < 10 AS f FROM supplier)"""


@query("g11_neighbour_agg", f"""
WITH {_NBR_SQL}, g AS (SELECT a, avg(x) AS m, max(x) AS h FROM e JOIN v USING (b) GROUP BY 1), o AS (SELECT o_orderkey AS a, o_totalprice AS x FROM orders)
SELECT a AS k, round(coalesce(m, x), 6) AS nbr_mean, round(coalesce(h, x), 6) AS nbr_max FROM o LEFT JOIN g USING (a)""")
def _(t: Tables) -> DataFrame:
    # Orders point to suppliers; an order without a first line keeps its own value.
    edges = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias(
        "dst")).distinct().withColumn("src", F.concat(F.lit("o"), F.col("src")))
    values = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("k"), F.col("o_totalprice").alias("x")).unionByName(
        t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("k"), F.col("s_acctbal").alias("x")))
    got = G.neighbour_agg(edges, values, "src", "dst", "k", "x").where(F.col("k").startswith("o"))
    return rounded(got.withColumn("k", F.substring("k", 2, 20).cast("long")), "nbr_mean", "nbr_max")


@query("g12_neighbour_share", f"""
WITH {_NBR_SQL}, g AS (SELECT a, avg(f::INT) AS s FROM e JOIN v USING (b) GROUP BY 1)
SELECT o_orderkey AS k, round(coalesce(s, 0), 6) AS share FROM orders LEFT JOIN g ON a = o_orderkey""")
def _(t: Tables) -> DataFrame:
    edges = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()
    nodes = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("f")).unionByName(
        t.supplier.select((-F.col("s_suppkey") - 1).alias("k"), (F.col("s_nationkey") < 10).cast("int").alias("f")))
    got = G.neighbour_share(edges, nodes, "src", "dst", "k", "f").where("k >= 0")
    return rounded(got, "share")


_EMB = [f"emb_{i}" for i in range(64)]
_EMB_SQL = "em AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(64)) + " FROM embeddings)"


@query("g13_pool_embeddings", f"""
WITH {_EMB_SQL}, lk AS (SELECT l_orderkey AS c, l_partkey % 700 AS v, l_partkey % 13 AS typ, (l_quantity - 5) AS w FROM lineitem),
ty AS (SELECT label, {", ".join(f"avg(e{i}) AS e{i}" for i in range(64))} FROM em GROUP BY 1),
j AS (SELECT c, w, {", ".join(f"coalesce(em.e{i}, ty.e{i}) AS e{i}" for i in range(64))} FROM lk LEFT JOIN em ON em.vec_id = lk.v LEFT JOIN ty ON ty.label = lk.typ)
SELECT c, {", ".join(f"round(coalesce(sum(CASE WHEN w > 0 THEN w * e{i} END) / nullif(sum(CASE WHEN w > 0 AND e0 IS NOT NULL THEN w END), 0), 0), 6) AS emb_{i}" for i in range(64))} FROM j GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    vectors = G.vector_columns(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    averages = G.type_average(vectors, t.embeddings.select("vec_id", F.col("label").alias("typ")), "vec_id", "typ", _EMB)
    lk = t.lineitem.select(F.col("l_orderkey").alias("c"), (F.col("l_partkey") % 700).alias("vec_id"), (F.col("l_partkey") % 13).cast(
        "int").alias("typ"), (F.col("l_quantity") - 5).alias("w"))
    return rounded(G.pool_embeddings(lk, vectors, "c", "vec_id", _EMB, "w", "typ", averages), *_EMB)


@query("g14_type_average", f"""
WITH {_EMB_SQL} SELECT label AS typ, {", ".join(f"round(avg(e{i}), 6) AS emb_{i}" for i in range(64))} FROM em GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    vectors = G.vector_columns(t.embeddings.select("vec_id", "embedding"), "embedding", 64)
    types = t.embeddings.select("vec_id", F.col("label").alias("typ"))
    return rounded(G.type_average(vectors, types, "vec_id", "typ", _EMB), *_EMB)


_HYPER_SQL = """hm AS (SELECT DISTINCT c.c_nationkey::VARCHAR || '|' || o.o_orderpriority AS e, o.o_orderkey AS k FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
hz AS (SELECT e FROM hm GROUP BY 1 HAVING count(*) > 1 AND count(*) <= 130)"""


def hyper_rows(t: Tables) -> DataFrame:
    nations = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return t.orders.join(nations, "o_custkey").select(F.col("o_orderkey").alias("k"), "c_nationkey", "o_orderpriority")


@query("g15_hyperedges", f"""
WITH {_HYPER_SQL} SELECT 'c_nationkey+o_orderpriority|' || e AS edge, k FROM hm JOIN hz USING (e) UNION ALL SELECT 'self|' || o_orderkey, o_orderkey FROM orders""")
def _(t: Tables) -> DataFrame:
    loops = t.orders.select(F.col("o_orderkey").alias("k"))
    return G.hyperedges(hyper_rows(t), "k", ["c_nationkey", "o_orderpriority"], 130, loops)


@query("g16_hyper_propagate", """
WITH h AS (SELECT DISTINCT 's' || l_suppkey AS e, l_orderkey AS k FROM lineitem UNION ALL SELECT 'o' || o_orderkey, o_orderkey FROM orders),
dv AS (SELECT k, count(*)::DOUBLE AS d FROM h GROUP BY 1), de AS (SELECT e, count(*)::DOUBLE AS d FROM h GROUP BY 1),
x0 AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS x FROM orders),
m AS (SELECT e, sum(x / sqrt(dv.d)) / any_value(de.d) AS z FROM h JOIN x0 USING (k) JOIN dv USING (k) JOIN de USING (e) GROUP BY 1)
SELECT k, round(sum(z) / sqrt(any_value(dv.d)) + 1e-7, 4) AS x FROM h JOIN m USING (e) JOIN dv USING (k) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    loops = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("edge"), F.col("o_orderkey").alias("k"))
    inc = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("edge"), F.col("l_orderkey").alias("k")).distinct().unionByName(loops)
    values = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x"))
    return G.hyper_propagate(inc, values, "k", ["x"]).select("k", F.round(F.col("x") + 1e-7, 4).alias("x"))


_LAZY_SQL = """h AS (SELECT e, k FROM hm JOIN (SELECT e FROM hm GROUP BY 1 HAVING count(*) > 1) USING (e) UNION ALL SELECT 'self|' || o_orderkey, o_orderkey FROM orders),
dv AS (SELECT k, count(*)::DOUBLE AS d FROM h GROUP BY 1), de AS (SELECT e, count(*)::DOUBLE AS d FROM h GROUP BY 1),
x0 AS (SELECT o_orderkey AS k, o_totalprice / 1000 AS x FROM orders)"""


def _lazy_step(source: str, target: str) -> str:
    return (f", m{target} AS (SELECT e, sum(x) / any_value(de.d) AS z FROM h JOIN {source} USING (k) JOIN de USING (e) GROUP BY 1), "
            f"n{target} AS (SELECT k, sum(z) / any_value(dv.d) AS z FROM h JOIN m{target} USING (e) JOIN dv USING (k) GROUP BY 1), "
            f"{target} AS (SELECT k, 0.5::DOUBLE * x + 0.5::DOUBLE * z AS x FROM {source} JOIN n{target} USING (k))")


@query("g16_hyper_propagate_lazy", f"""
WITH {_HYPER_SQL}, {_LAZY_SQL}{_lazy_step("x0", "x1")}{_lazy_step("x1", "x2")} SELECT k, round(x + 1e-7, 4) AS x FROM x2""")
def _(t: Tables) -> DataFrame:
    inc = G.hyperedges(hyper_rows(t), "k", ["c_nationkey", "o_orderpriority"], None, t.orders.select(F.col("o_orderkey").alias("k")))
    values = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("x"))
    return G.hyper_propagate(inc, values, "k", ["x"], 2, lazy=True).select("k", F.round(F.col("x") + 1e-7, 4).alias("x"))


def walk_edges(t: Tables) -> DataFrame:
    pairs = t.events.select(F.concat(F.lit("u"), F.col("user_id")).alias("src"), F.concat(F.lit("t"), F.floor(F.col("value"))).alias("dst"))
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("g17_random_walks", """
WITH RECURSIVE e AS (SELECT 'u' || user_id AS src, 't' || floor(value)::BIGINT AS dst FROM events), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
c AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst) AS copy FROM b),
nb AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5('42:' || src || ':' || dst || ':' || copy)) - 1 AS idx, count(*) OVER (PARTITION BY src) AS deg FROM c),
dg AS (SELECT DISTINCT src AS node, deg FROM nb),
w AS (SELECT node || '#' || rep AS walk, node AS start, 0 AS step, node, deg FROM dg, range(5) r(rep)
  UNION ALL SELECT w.walk, w.start, w.step + 1, nb.dst, d.deg FROM w JOIN nb ON nb.src = w.node
  AND nb.idx = ('0x' || substr(md5('42:' || w.walk || ':' || (w.step + 1)), 1, 15))::BIGINT % w.deg JOIN dg d ON d.node = nb.dst WHERE w.step < 9)
SELECT walk, start, step, node FROM w""")
def _(t: Tables) -> DataFrame:
    return G.random_walks(walk_edges(t), "src", "dst", length=10, per_node=5)


@query("g18_biased_walks")
def _(t: Tables) -> DataFrame:
    return G.biased_walks(walk_edges(t), "src", "dst", p=2.0, q=0.5, length=10, per_node=5)


@query("g19_walk_embeddings")
def _(t: Tables) -> DataFrame:
    walks = G.random_walks(walk_edges(t), "src", "dst", length=10, per_node=5)
    return G.walk_embeddings(walks)


@query("g20_inductive_embed")
def _(t: Tables) -> DataFrame:
    inc = t.events.select(F.col("user_id").alias("c"), F.floor(F.col("value")).alias("n"))
    train = t.events.select(F.col("user_id").alias("c")).distinct().where(F.pmod(F.col("c"), F.lit(5)) != 0)
    return G.inductive_embed(inc, train, "c", "n", dim=64, length=10, per_node=5)


@query("g21_svd_embed")
def _(t: Tables) -> DataFrame:
    inc = t.events.select(F.col("user_id").alias("c"), F.floor(F.col("value")).alias("n"))
    got = G.svd_embed(inc, "c", "n", F.count(F.lit(1)), 4, iterations=6, oversample=4)
    # Singular vectors are defined up to sign.
    return got.select("c", *[r6(F.abs(f"svd_{i}")).alias(f"svd_{i}") for i in range(4)])


@query("g22_token_edges", """
SELECT user_id, tok, n AS weight FROM (SELECT user_id, event_type || (event_id % 11)::VARCHAR AS tok, count(*) AS n, row_number() OVER (PARTITION BY user_id
 ORDER BY count(*) DESC, event_type || (event_id % 11)::VARCHAR) AS rk FROM events GROUP BY 1, 2) WHERE rk <= 30""")
def _(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.concat("event_type", (F.col("event_id") % 11).cast("string")).alias("tok"))
    return G.token_edges(e, "user_id", "tok", 30)
