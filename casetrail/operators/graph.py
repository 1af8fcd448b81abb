"""Graph queries over edge lists and case-node incidence tables.

An incidence table has one row per case-node link. Hubs (nodes of very high degree) never enter a pair join: cases are
grouped by the set of hubs they touch, and hub contributions are computed between those groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.operators import skipgram
from casetrail.operators.ranks import hashed_order, hashed_rank, top_k
from casetrail.operators.temporal import bounded
from casetrail.session import cut_lineage, stored


# ---- building ----
def build_graph(edges: DataFrame, cases: DataFrame, case: str, node: str,
                weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with contiguous ids per type, and both directions of the edges whose ends are known.

    Ids come from the hash order, so numbering needs no global sort.
    """
    known = edges.where(F.col(node).isNotNull()).join(cases.select(case).distinct(), case, "left_semi")
    names = cases.select(F.lit("case").alias("type"), F.col(case).cast("string").alias("name")).distinct().unionByName(
        known.select(F.lit("node").alias("type"), F.col(node).cast("string").alias("name")).distinct())
    nodes = hashed_rank(names, ["type"], ["name"], rank_as="id").withColumn("id", F.col("id") - 1)
    ends = known.select(F.col(case).cast("string").alias("__c"), F.col(node).cast("string").alias("__n"),
                        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("weight"))
    ids = {t: nodes.where(F.col("type") == t).select(F.col("name").alias(f"__{t}"), F.col("id").alias(f"{t}_id"))
           for t in ("case", "node")}
    placed = (ends.join(ids["case"], F.col("__c") == F.col("__case")).join(ids["node"], F.col("__n") == F.col("__node")))
    forward = placed.select(F.lit("case").alias("src_type"), F.col("case_id").alias("src"),
                            F.lit("node").alias("dst_type"), F.col("node_id").alias("dst"), "weight")
    backward = placed.select(F.lit("node").alias("src_type"), F.col("node_id").alias("src"),
                             F.lit("case").alias("dst_type"), F.col("case_id").alias("dst"), "weight")
    return nodes, forward.unionByName(backward)


def concept_edges(case: str, tables: Mapping[str, tuple[DataFrame, str]], flags: DataFrame | None = None,
                  flag_columns: Sequence[str] = (), flag_type: str = "diagnosis") -> DataFrame:
    """One typed edge list (case, dst_type, dst, weight) from several link tables and unpivoted 0/1 flags.

    A pair that repeats keeps its multiplicity as weight.
    """
    parts = [t.where(F.col(c).isNotNull()).select(case, F.lit(kind).alias("dst_type"), F.col(c).cast("string").alias("dst"))
             for kind, (t, c) in tables.items()]
    if flags is not None:
        long = flags.select(case, *[F.col(c).cast("int").alias(c) for c in flag_columns]).unpivot(
            [case], list(flag_columns), "dst", "__v")
        parts.append(long.where(F.col("__v") == 1).select(case, F.lit(flag_type).alias("dst_type"), "dst"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(case, "dst_type", "dst").agg(F.count(F.lit(1)).alias("weight"))


def graph_stats(edges: DataFrame, cases: DataFrame, case: str, node: str) -> DataFrame:
    """Cases, nodes, edge rows, distinct pairs, node degree (median, maximum) and the share of cases with a link.

    Links and cases are read once. Each case becomes one row that knows its links' rows; all figures then follow from
    the number of nodes per degree, which has few rows whatever the size of the graph.
    """
    slim = edges.where(F.col(node).isNotNull()).groupBy(F.col(case).alias("c"), F.col(node).alias("n")).agg(
        F.count(F.lit(1)).alias("m"))
    listed = cases.where(F.col(case).isNotNull()).select(F.col(case).alias("c")).distinct()
    # One row per pair of a listed case, and one row without a node per case that has no link.
    rows = listed.join(slim, "c", "left")
    # Nodes and cases are counted side by side.
    items = rows.select(F.inline(F.array(
        F.struct(F.lit("node").alias("kind"), F.when(F.col("n").isNotNull(), F.col("n").cast("string")).alias("id"), F.col("m").alias("m")),
        F.struct(F.lit("case").alias("kind"), F.col("c").cast("string").alias("id"), F.col("m")))))
    items = items.where(F.col("id").isNotNull())
    degree = items.groupBy("kind", "id").agg(F.count("m").alias("degree"), F.sum("m").alias("m"))
    # Nodes per degree; a case only tells whether it has a link.
    node_kind = F.col("kind") == "node"
    sizes = degree.groupBy("kind", F.when(node_kind, F.col("degree")).otherwise((F.col("degree") > 0).cast("long")).alias("degree")).agg(
        F.count(F.lit(1)).alias("items"), F.sum("m").alias("m"))
    total = F.sum(F.when(node_kind, F.col("items"))).over(Window.partitionBy(F.lit(1)))
    upto = F.sum(F.when(node_kind, F.col("items"))).over(Window.partitionBy(F.lit(1)).orderBy("kind", "degree"))
    placed = sizes.select("*", total.alias("nodes"), upto.alias("upto"))

    def at(place: Column) -> Column:
        """Degree at a place, counted from 1, of the nodes in order of degree."""
        return F.min(F.when(node_kind & (F.col("upto") >= place), F.col("degree")))

    median = (at(F.floor((F.col("nodes") + 1) / 2)) + at(F.floor((F.col("nodes") + 2) / 2))) / F.lit(2.0)
    n_cases = F.coalesce(F.sum(F.when(~node_kind, F.col("items"))), F.lit(0))
    linked = F.coalesce(F.sum(F.when(~node_kind & (F.col("degree") > 0), F.col("items"))), F.lit(0))
    return placed.agg(
        n_cases.alias("n_cases"), F.coalesce(F.sum(F.when(node_kind, F.col("items"))), F.lit(0)).alias("n_nodes"),
        F.sum(F.when(node_kind, F.col("m"))).alias("n_rows"), F.sum(F.when(node_kind, F.col("items") * F.col("degree"))).alias("n_pairs"),
        median.alias("median_degree"), F.max(F.when(node_kind, F.col("degree"))).alias("max_degree"),
        F.try_divide(linked, n_cases).alias("linked_share"))


def degree_features(edges: DataFrame, case: str, kind: str, kinds: Sequence[str], distinct: str | None = None) -> DataFrame:
    """Links per case and kind, as rows or as distinct nodes when ``distinct`` names the node column."""
    base = edges if distinct is None else edges.select(case, kind, distinct).distinct()
    return base.groupBy(case).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def token_edges(edges: DataFrame, case: str, token: str, k: int = 30) -> DataFrame:
    """Case-token edges with their count, the ``k`` most frequent tokens per case."""
    counts = edges.groupBy(case, token).agg(F.count(F.lit(1)).alias("weight"))
    return top_k(counts, [case], [F.desc("weight"), F.asc(token)], k)


# ---- shared neighbours ----
def _links(incidence: DataFrame, case: str, node: str, dedupe: bool) -> DataFrame:
    """(c, n, m): distinct links with multiplicity, or 1 when repeats do not count."""
    m = F.lit(1).cast("long") if dedupe else F.count(F.lit(1))
    return (incidence.where(F.col(node).isNotNull())
            .groupBy(F.col(case).alias("c"), F.col(node).cast("string").alias("n")).agg(m.alias("m")))


def _salted_pairs(left: DataFrame, right: DataFrame, node: str, salts: int = 8) -> DataFrame:
    """Equi-join on a node with the left side dealt over ``salts`` and the right side repeated that often."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64("c"), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [node, "__salt"]).drop("__salt")


#: Most links of a case that travel with each of them; longer lists would be repeated too often.
_LISTED = 64


def _listed(links: DataFrame, order: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """A row per case with its links (``n``, ``m`` and ``extra``) in order, and whether they are few enough to travel (``few``)."""
    names = list(dict.fromkeys([*order, "n", "m", *extra]))  # a struct sorts by its first fields
    lists = links.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("all"))
    return lists.withColumn("few", F.size("all") <= _LISTED)


def _met(short: DataFrame, dedupe: bool, on: Sequence[str], carried: Sequence[str], wanted: Column, other: DataFrame | None = None) -> DataFrame:
    """Unordered ``wanted`` pairs of cases that meet in a node, once each: ``c, o``, the number shared ``r`` and of different nodes ``nodes``.

    Both cases' lists are at hand where they meet, so no pairs are shuffled. A pair counts at the first node its lists
    share. ``carried`` columns come along, those of the other case as ``<name>_o``.
    """
    names = list(dict.fromkeys([*on, "n", "c", "ns", *([] if dedupe else ["ms"]), *carried]))
    # Both sides are the same columns in the same order under new names, so that equal sides are shuffled once.
    left, right = (side.select(*[F.col(x).alias(f"{x}_{suffix}") for x in names]) for side, suffix in (
        (short, "c"), (short if other is None else other, "o")))
    met = left.join(right, [F.col(f"{x}_c") == F.col(f"{x}_o") for x in on]).select(
        *[F.col(f"{x}_c").alias(x) for x in names], *[f"{x}_o" for x in names if x not in on])
    # A generator, so that the common nodes are found once.
    pairs = met.where((F.col("c") < F.col("c_o")) & wanted).withColumn(
        "common", F.explode(F.array(F.array_intersect("ns", "ns_o")))).where(F.get("common", F.lit(0)) == F.col("n"))
    nodes = F.size("common").cast("long")
    ours, others = F.map_from_arrays("ns", "ms"), F.map_from_arrays("ns_o", "ms_o")
    shared = nodes if dedupe else F.aggregate("common", F.lit(0).cast("long"), lambda total, n: total + ours[n] * others[n])
    return pairs.select("c", F.col("c_o").alias("o"), shared.alias("r"), nodes.alias("nodes"), *[x for y in carried for x in (y, f"{y}_o")])


def shared_counts(incidence: DataFrame, case: str, node: str, min_shared: int = 2, dedupe: bool = True) -> DataFrame:
    """Unordered case pairs that share at least ``min_shared`` nodes, with the number shared.

    Prefix filter: nodes are put in rarest-first order; two cases that share ``k`` nodes must share one that is not
    among the last ``k - 1`` of either. Candidates therefore never form through a case's most common nodes. With
    repeats counted (``dedupe=False``) a link weighs m * max(m) of its node, so the suffix stays below ``min_shared``.
    A case's list travels with its links and candidates are counted where they meet; only pairs with a case of more than
    ``_LISTED`` links are shuffled and counted by joins.
    """
    links = _links(incidence, case, node, dedupe)
    degree = links.groupBy("n").agg(F.count(F.lit(1)).alias("d"), F.max("m").alias("mm"))
    ranked = links.join(degree, "n").withColumn("w", F.col("m") * F.col("mm"))
    lists = _listed(ranked, ["d", "n"], ["w"])
    # Every link weighs at least 1, so sums from the list's end only grow.
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    last = F.aggregate(F.reverse("all"), start, lambda a, l: F.struct(
        (a["sum"] + l["w"]).alias("sum"), (a["n"] + (a["sum"] + l["w"] < min_shared).cast("int")).alias("n")))
    lists = cut_lineage(lists.withColumn("prefix", F.slice("all", F.lit(1), F.size("all") - last["n"])))
    # Only nodes of high degree are dealt over salts.
    salts = F.when(F.col("d") > 1000, 8).otherwise(1)
    short = lists.where("few").select("c", F.col("all.n").alias("ns"), F.col("all.m").alias("ms"), F.inline(F.transform("prefix", lambda l: F.struct(l["n"].alias("n"), l["d"].alias("d")))))
    left = short.withColumn("salt", F.pmod(F.xxhash64("c"), salts).cast("int"))
    right = short.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    found = _met(left, dedupe, ["n", "salt"], [], F.lit(True), right).where(F.col("r") >= min_shared).select("c", "o", F.col("r").alias("shared"))
    prefix = lists.select("c", "few", F.explode("prefix.n").alias("n"))
    candidates = (_salted_pairs(prefix.where(~F.col("few")).select("n", "c"), prefix.select("n", F.col("c").alias("o"), "few"), "n")
                  .where((F.col("few") & (F.col("c") != F.col("o"))) | (F.col("c") < F.col("o"))).select("c", "o").distinct())
    theirs = links.select(F.col("c").alias("o"), "n", F.col("m").alias("mo"))
    counted = (candidates.join(links, "c").join(theirs, ["o", "n"]).groupBy("c", "o")
               .agg(F.sum(F.col("m") * F.col("mo")).alias("shared")).where(F.col("shared") >= min_shared))
    found = found.unionByName(counted.select(F.least("c", "o").alias("c"), F.greatest("c", "o").alias("o"), "shared").distinct())
    return found.select(F.col("c").alias(f"{case}_a"), F.col("o").alias(f"{case}_b"), "shared")


def neighbour_rate(incidence: DataFrame, labels: DataFrame, case: str, node: str, y: str, train: str,
                   include_self: bool = True, dedupe: bool = False, out: str = "rate") -> DataFrame:
    """Event rate of train cases met over shared nodes, each weighted by the number shared.

    Linear in the links: a node first sums its train labels, a case then sums its nodes; no pairs are formed.
    """
    links = _links(incidence, case, node, dedupe)
    known = labels.select(F.col(case).alias("c"), F.col(y).cast("double").alias("__y"), F.col(train).cast("int").alias("__t"))
    marked = links.join(known, "c")
    sums = marked.groupBy("n").agg(F.sum(F.col("m") * F.col("__y") * F.col("__t")).alias("__sy"),
                                   F.sum(F.col("m") * F.col("__t")).alias("__st"))
    own_y, own_t = (F.lit(0), F.lit(0)) if include_self else (
        F.col("m") * F.col("m") * F.col("__y") * F.col("__t"), F.col("m") * F.col("m") * F.col("__t"))
    totals = marked.join(sums, "n").groupBy("c").agg(
        F.sum(F.col("m") * F.col("__sy") - own_y).alias("__num"), F.sum(F.col("m") * F.col("__st") - own_t).alias("__den"))
    rate = F.coalesce(F.col("__num") / F.greatest(F.col("__den"), F.lit(1)), F.lit(0.0))
    return known.join(totals, "c", "left").select(F.col("c").alias(case), rate.alias(out))


def _split_hubs(links: DataFrame, hub_degree: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rare links, class of each hub-touching case, hub overlap of class pairs, links of hubs per class).

    A class is a distinct set of hub links, so identical cases share one and a hub's members shrink to its classes.
    """
    degree = links.groupBy("n").agg(F.count(F.lit(1)).alias("__d"))
    hubs = degree.where(F.col("__d") > hub_degree).select("n")
    rare = links.join(hubs, "n", "left_anti")
    touching = links.join(hubs, "n", "left_semi")
    member = touching.groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("n", "m"))).alias("__set")).withColumn("k", F.sha2(F.to_json("__set"), 256))
    class_links = member.select("k", "__set").dropDuplicates(["k"]).select(
        "k", F.explode("__set").alias("__l")).select("k", F.col("__l")["n"].alias("n"), F.col("__l")["m"].alias("m"))
    a = class_links.select("n", F.col("k").alias("c"), "m")
    b = class_links.select("n", F.col("k").alias("k2"), F.col("m").alias("m2"))
    overlap = _salted_pairs(a, b, "n").groupBy(F.col("c").alias("k"), "k2").agg(
        F.sum(F.col("m") * F.col("m2")).alias("h"))
    return rare, member.select("c", "k"), overlap, class_links


def _rare_pairs(rare: DataFrame, member: DataFrame, overlap: DataFrame, dedupe: bool, wanted: Column) -> DataFrame:
    """Unordered pairs that meet in a rare node, once each: ``c, o``, rare nodes shared ``r`` and hubs shared ``h``.

    ``wanted`` may leave out pairs of which at least one case touches no hub, by ``r``, ``nodes`` (different nodes shared)
    and, at the pair's first node, the cases' places ``at`` and ``at_o`` by falling m and id. These columns are null
    for the other pairs. Only pairs of cases that both touch hubs, and those of a case with more than ``_LISTED`` links,
    are shuffled.
    """
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("m"), F.asc("c")))
    lists = stored(_listed(rare.withColumn("at", place), ["n"], ["at"]).join(member, "c", "left"))
    short = lists.where("few").select("c", "k", F.col("all.n").alias("ns"), F.col("all.m").alias("ms"), F.inline(F.transform("all", lambda l: F.struct(l["n"].alias("n"), l["at"].alias("at")))))
    both = F.col("k").isNotNull() & F.col("k_o").isNotNull()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    plain = _met(short, dedupe, ["n"], ["at", "k"], ~both).where(wanted).select("c", "o", "r", zero.alias("h"), "nodes", "at", "at_o")
    over = _met(short, dedupe, ["n"], ["k"], both).select("c", "o", "r", "k", F.col("k_o").alias("k2"))
    links = lists.select("c", "k", "few", F.inline("all"))
    other = links.select("n", F.col("c").alias("o"), F.col("k").alias("k2"), F.col("m").alias("mo"), "few")
    longer = (links.where(~F.col("few")).drop("few", "at").join(other, "n").where((F.col("few") & (F.col("c") != F.col("o"))) | (F.col("c") < F.col("o")))
              .groupBy("c", "o", "k", "k2").agg(F.sum(F.col("m") * F.col("mo")).alias("r")).select("c", "o", "r", "k", "k2"))
    rest = over.unionByName(longer).join(overlap, ["k", "k2"], "left").select(
        "c", "o", "r", F.coalesce("h", zero).alias("h"), none.cast("long").alias("nodes"), none.alias("at"), none.alias("at_o"))
    return plain.unionByName(rest)


def neighbour_rate_thr(incidence: DataFrame, labels: DataFrame, case: str, node: str, y: str, train: str, k: int,
                       include_self: bool = True, dedupe: bool = True, hub_degree: int = 1000,
                       out: str = "rate") -> DataFrame:
    """Event rate of the train cases that share at least ``k`` nodes, each counted once.

    Shared nodes split into hubs and the rest. Between hub classes, whole groups that already share ``k`` hubs are
    added at once. Pairs are formed over rare nodes only, and each adds the difference its rare nodes make to that
    verdict. The result is exact for any ``hub_degree``.
    """
    links = _links(incidence, case, node, dedupe)
    known = labels.select(F.col(case).alias("c"), (F.col(y).cast("double") * F.col(train).cast("int")).alias("__y"),
                          F.col(train).cast("double").alias("__t"))
    rare, member, overlap, _ = _split_hubs(links, hub_degree)
    per_class = member.join(known, "c").groupBy("k").agg(F.sum("__y").alias("__cy"), F.sum("__t").alias("__ct"))
    by_class = (overlap.where(F.col("h") >= k).join(per_class.withColumnRenamed("k", "k2"), "k2").groupBy("k")
                .agg(F.sum("__cy").alias("__by"), F.sum("__ct").alias("__bt")))
    met = _rare_pairs(rare, member, overlap, dedupe, F.col("r") >= k)
    turned = met.where((F.col("h") < k) & (F.col("h") + F.col("r") >= k)).select(F.inline(F.array(
        F.struct("c", "o"), F.struct(F.col("o").alias("c"), F.col("c").alias("o")))))
    # A case meets itself, too.
    itself = (rare.groupBy("c").agg(F.sum(F.col("m") * F.col("m")).alias("r")).join(member, "c", "left")
              .join(overlap.where(F.col("k") == F.col("k2")).select("k", "h"), "k", "left").withColumn("h", F.coalesce("h", F.lit(0))))
    itself = itself.where((F.col("h") < k) & (F.col("h") + F.col("r") >= k)).select("c", F.col("c").alias("o"))
    theirs = known.select(F.col("c").alias("o"), F.col("__y").alias("__oy"), F.col("__t").alias("__ot"))
    extra = turned.unionByName(itself).join(theirs, "o").groupBy("c").agg(F.sum("__oy").alias("__ey"), F.sum("__ot").alias("__et"))
    own = links.groupBy("c").agg(F.sum(F.col("m") * F.col("m")).alias("__own"))
    rows = (known.join(member, "c", "left").join(by_class, "k", "left").join(extra, "c", "left").join(own, "c", "left"))
    self_hit = F.lit(0) if include_self else F.coalesce((F.col("__own") >= k).cast("int"), F.lit(0))
    zero = F.lit(0.0)
    num = F.coalesce("__by", zero) + F.coalesce("__ey", zero) - self_hit * F.col("__y")
    den = F.coalesce("__bt", zero) + F.coalesce("__et", zero) - self_hit * F.col("__t")
    return rows.select(F.col("c").alias(case), (num / F.greatest(den, F.lit(1.0))).alias(out))


def cooccurrence_knn(incidence: DataFrame, case: str, node: str, k: int = 8, dedupe: bool = True,
                     hub_degree: int = 1000, symmetric: bool = True) -> DataFrame:
    """The ``k`` cases that share most nodes with each case (ties by smaller id), as edges in both directions.

    Exact with hubs: cases that meet over hubs only are represented by the ``k + 1`` smallest ids of their class.
    Any other member of that class has ``k`` rivals with at least its score and a smaller id.
    """
    links = _links(incidence, case, node, dedupe)
    rare, member, overlap, _ = _split_hubs(links, hub_degree)
    # Of cases that share a single rare node, the first k + 1 there suffice: any later one has k rivals before it.
    shared, ahead = (F.col("r") + F.col("h")).alias("shared"), lambda at: F.col("nodes").isNull() | (F.col("nodes") > 1) | (F.col(at) <= k + 1)
    met = _rare_pairs(rare, member, overlap, dedupe, ahead("at") | ahead("at_o"))
    scored = met.select(F.inline(F.array(
        F.struct("c", "o", shared, ahead("at_o").alias("near")),
        F.struct(F.col("o").alias("c"), F.col("c").alias("o"), shared, ahead("at").alias("near"))))).where("near").drop("near")
    heads = top_k(member, ["k"], [F.asc("c")], k + 1).select(F.col("k").alias("k2"), F.col("c").alias("o"))
    # Per class the k + 1 best hub-only partners suffice for all its members.
    per_class = top_k(overlap.join(heads, "k2").select("k", "o", F.col("h").alias("shared")), ["k"],
                      [F.desc("shared"), F.asc("o")], k + 1)
    over_hubs = member.join(per_class, "k").where(F.col("c") != F.col("o")).select("c", "o", "shared")
    # A pair's full score is no less than its score over hubs, so each case's k best of ``scored`` are enough; what is left
    # of both is dealt by case once.
    best = top_k(scored, ["c"], [F.desc("shared"), F.asc("o")], k).unionByName(over_hubs).repartition("c").groupBy("c", "o").agg(
        F.max("shared").alias("shared"))
    kept = top_k(best, ["c"], [F.desc("shared"), F.asc("o")], k)
    if not symmetric:
        return kept.select(F.col("c").alias("src"), F.col("o").alias("dst"), "shared")
    pairs = stored(kept).select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "shared").distinct()
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "shared"),
                                         F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "shared"))))


# ---- neighbourhood aggregates ----
def neighbour_agg(edges: DataFrame, values: DataFrame, src: str, dst: str, key: str, value: str,
                  isolated: str = "own") -> DataFrame:
    """Mean and maximum of a value over neighbours; isolated nodes take their own value or 0."""
    theirs = values.select(F.col(key).alias(dst), F.col(value).alias("__v"))
    found = edges.select(src, dst).join(theirs, dst).groupBy(F.col(src).alias(key)).agg(
        F.avg("__v").alias("nbr_mean"), F.max("__v").alias("nbr_max"))
    fallback = F.col(value) if isolated == "own" else F.lit(0.0)
    return values.select(key, value).join(found, key, "left").select(
        key, F.coalesce("nbr_mean", fallback).alias("nbr_mean"), F.coalesce("nbr_max", fallback).alias("nbr_max"))


def neighbour_share(edges: DataFrame, nodes: DataFrame, src: str, dst: str, key: str, inside: str) -> DataFrame:
    """Share of neighbours inside a node set; 0 for isolated nodes."""
    flags = nodes.select(F.col(key).alias(dst), F.col(inside).cast("int").alias("__in"))
    found = edges.select(src, dst).join(flags, dst).groupBy(F.col(src).alias(key)).agg(F.avg("__in").alias("share"))
    return nodes.select(key).join(found, key, "left").na.fill(0.0, ["share"])


# ---- embeddings ----
def vector_columns(df: DataFrame, column: str, dim: int, prefix: str = "emb_") -> DataFrame:
    """Array column spread over ``prefix0 ..`` columns."""
    return df.select(*[c for c in df.columns if c != column],
                     *[F.col(column)[i].cast("double").alias(f"{prefix}{i}") for i in range(dim)])


def type_average(embeddings: DataFrame, types: DataFrame, key: str, kind: str, columns: Sequence[str]) -> DataFrame:
    """Mean vector per entity type."""
    return embeddings.join(types.select(key, kind).distinct(), key).groupBy(kind).agg(
        *[F.avg(c).alias(c) for c in columns])


#: Most values of a table of vectors that is broadcast, and most sums that a task holds.
_VALUES, _SUMS = 2_000_000, 8_000_000


def pool_embeddings(links: DataFrame, embeddings: DataFrame, case: str, key: str, columns: Sequence[str],
                    weight: str | None = None, kind: str | None = None, averages: DataFrame | None = None,
                    unknown: str = "skip") -> DataFrame:
    """Weighted mean of entity vectors per case.

    ``unknown`` ids first take their type's average when given; what is left is skipped (``skip``), counted as zero
    vectors (``zero``), or, for weights, counted as zero unless no weight or vector remains, when known vectors are
    averaged plainly (``zero_weighted``). Weights of 0 or less are left out. Cases with nothing known get zeros.
    """
    most = _VALUES // max(1, len(columns))
    few = bounded(embeddings, most)
    if not few:
        # Of many vectors those that occur may be few.
        embeddings = embeddings.join(links.select(key).distinct(), key, "left_semi")
        few = bounded(embeddings, most)
    lut = embeddings.dropDuplicates([key]).select(F.col(key), *[F.col(c) for c in columns], F.lit(1).alias("__known"))
    if few:
        # Narrow links are shuffled by case before they take up vectors, instead of vectors once per link, into parts
        # of which the sums fit in memory even if every link is a case.
        least = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(least, -(-links.count() * (len(columns) + 8) // _SUMS))
        links, lut = links.repartition(parts, case) if parts > least else links.repartition(case), F.broadcast(lut)
    rows = links.join(lut, key, "left")
    if averages is not None and kind is not None:
        fallback = averages.select(kind, *[F.col(c).alias(f"__t_{c}") for c in columns], F.lit(1).alias("__typed"))
        fallback = F.broadcast(fallback) if bounded(averages, _VALUES // max(1, len(columns))) else fallback
        rows = rows.join(fallback, kind, "left").select(
            case, *([weight] if weight else []), F.coalesce("__known", "__typed").alias("__known"),
            *[F.coalesce(c, f"__t_{c}").alias(c) for c in columns])
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    counted = w if unknown != "skip" else F.when(F.col("__known") == 1, w).otherwise(0.0)
    total, aggregates = F.sum(counted), []
    for c in columns:
        mean = F.try_divide(F.sum(F.coalesce(F.col(c) * w, F.lit(0.0))), F.nullif(total, F.lit(0.0)))
        plain = F.avg(c) if unknown == "zero_weighted" else F.lit(None).cast("double")
        aggregates.append(F.coalesce(mean, plain, F.lit(0.0)).alias(c))
    return rows.groupBy(case).agg(*aggregates)


# ---- hypergraphs ----
def hyperedges(members: DataFrame, case: str, keys: Sequence[str], maximum: int | None = None,
               self_loops: DataFrame | None = None) -> DataFrame:
    """Groups of cases that agree on all keys: (edge, case) rows of groups with more than one case.

    ``maximum`` leaves out larger groups, as the size-limited variants do. ``self_loops`` adds one group per case.
    """
    complete = members.where(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0)
    rows = complete.select(F.concat_ws("|", F.lit("+".join(keys)), *[F.col(k).cast("string") for k in keys]).alias("edge"),
                           case).distinct()
    sizes = rows.groupBy("edge").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    if maximum is not None:
        sizes = sizes.where(F.col("__n") <= maximum)
    kept = rows.join(sizes.select("edge"), "edge", "left_semi")
    if self_loops is not None:
        kept = kept.unionByName(self_loops.select(F.concat(F.lit("self|"), F.col(case).cast("string")).alias("edge"), case))
    return kept


def hyper_propagate(incidence: DataFrame, values: DataFrame, case: str, columns: Sequence[str], iterations: int = 1,
                    lazy: bool = False, edge: str = "edge") -> DataFrame:
    """Average values over hyperedges: D_v^-1/2 H D_e^-1 H' D_v^-1/2 X, or X/2 + D_v^-1 H D_e^-1 H' X/2 when lazy."""
    links = incidence.select(edge, case)
    sizes = links.groupBy(edge).agg(F.count(F.lit(1)).alias("__de"))
    degrees = links.groupBy(case).agg(F.count(F.lit(1)).alias("__dv"))
    state = values.select(case, *columns).join(degrees, case, "left").withColumn(
        "__dv", F.greatest(F.coalesce("__dv", F.lit(1)), F.lit(1)))
    for step in range(iterations):
        scale = F.lit(1.0) if lazy else 1.0 / F.sqrt("__dv")
        to_edges = (links.join(state, case).groupBy(edge)
                    .agg(*[F.sum(F.col(c) * scale).alias(c) for c in columns]).join(sizes, edge))
        back = links.join(to_edges, edge).groupBy(case).agg(
            *[F.sum(F.col(c) / F.col("__de")).alias(f"__n_{c}") for c in columns])
        joined = state.join(back, case, "left")
        out_scale = 1.0 / F.col("__dv") if lazy else scale
        moved = {c: F.coalesce(F.col(f"__n_{c}"), F.lit(0.0)) * out_scale for c in columns}
        state = joined.select(case, "__dv", *[
            ((F.col(c) * 0.5 + m * 0.5) if lazy else m).alias(c) for c, m in moved.items()])
        if step + 1 < iterations:
            state = cut_lineage(state)
    return state.drop("__dv")


# ---- random walks ----
#: Neighbours of a node that travel as one row; a hub has many such rows.
_BLOCK = 512


def _walk_tables(edges: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbours by blocks (src, blk, dsts, degs), distinct pairs (src, dst), and (node, degree).

    Neighbours carry a number. A step joins on (node, block of the number), so a hub's visitors spread over its blocks,
    and what a step shuffles besides the walkers are rows of up to ``_BLOCK`` neighbours with their degrees.
    """
    links = edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).where(
        F.col("src").isNotNull() & F.col("dst").isNotNull())
    counted = cut_lineage(links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies")))
    degree = cut_lineage(counted.groupBy("src").agg(F.sum("copies").alias("deg")))
    pairs = counted.join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("dst_deg")), "dst", "left")
    copies = pairs.select("src", "dst", F.coalesce("dst_deg", F.lit(0)).alias("dst_deg"),
                          F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return _numbered_blocks(copies, degree), counted.select("src", "dst"), degree.select(F.col("src").alias("node"), "deg")


def _numbered_blocks(copies: DataFrame, degree: DataFrame) -> DataFrame:
    """Neighbours in md5 order by blocks of ``_BLOCK`` numbers: (src, blk, dsts, degs).

    The first hex digits of the hash split a hub into cells of about ``_BLOCK`` neighbours; cells are sorted as arrays,
    and what lies across two blocks is cut once the sizes of the cells before are known.
    """
    digits = F.least(F.lit(8), F.greatest(F.lit(0), F.ceil(F.log2(F.col("deg") / _BLOCK) / 4))).cast("int")
    sized = copies.join(degree.select("src", digits.alias("__digits")), "src")
    hashed = sized.withColumn("__h", hashed_order(42, "src", "dst", "copy")).withColumn("cell", F.expr("left(__h, __digits)"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.unhex("__h").alias("h"), "dst", "copy", "dst_deg")))
    cells = cut_lineage(hashed.groupBy("src", "cell").agg(sorted_.alias("__n")).select(
        "src", "cell", F.size("__n").cast("long").alias("n"), F.col("__n.dst").alias("dsts"), F.col("__n.dst_deg").alias("degs")))
    whole, parts = cells.where((F.col("cell") == "") & (F.col("n") <= _BLOCK)), cells.where((F.col("cell") != "") | (F.col("n") > _BLOCK))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("src", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    low, high = F.floor(F.col("begin") / _BLOCK), F.floor((F.col("begin") + F.col("n") - 1) / _BLOCK)
    dealt = parts.join(begins, ["src", "cell"]).withColumn("blk", F.explode(F.sequence(low, high)))
    start = F.greatest(F.lit(0), F.col("blk") * _BLOCK - F.col("begin"))
    take = (F.least(F.col("n"), (F.col("blk") + 1) * _BLOCK - F.col("begin")) - start).cast("int")
    cut = dealt.select("src", "blk", F.struct("begin", *[F.slice(c, (start + 1).cast("int"), take).alias(c) for c in ("dsts", "degs")]).alias("__s"))
    joined = cut.groupBy("src", "blk").agg(F.array_sort(F.collect_list("__s")).alias("__s")).select(
        "src", "blk", F.flatten("__s.dsts").alias("dsts"), F.flatten("__s.degs").alias("degs"))
    return cut_lineage(whole.select("src", F.lit(0).cast("long").alias("blk"), "dsts", "degs").unionByName(joined))


def _draw(seed: int, *parts: Column) -> Column:
    """Repeatable non-negative draw per walk and step."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _walkers(degree: DataFrame, per_node: int) -> DataFrame:
    """Walkers at their start: (walk, start, path so far, degree of its last node)."""
    return degree.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))).select(
        F.concat_ws("#", "node", F.col("rep").cast("string")).alias("walk"), F.col("node").alias("start"),
        F.array("node").alias("path"), "deg")


def _proposed(walkers: DataFrame, blocks: DataFrame, draw: Column) -> DataFrame:
    """Walkers with the neighbour that a draw names, ``dst`` and ``dst_deg``; null where the last node has none."""
    moving = walkers.withColumn("src", F.element_at("path", -1)).withColumn(
        "__idx", F.when(F.col("deg") > 0, F.pmod(draw, F.col("deg")))).withColumn("blk", F.floor(F.col("__idx") / _BLOCK))
    place = F.pmod(F.col("__idx"), F.lit(_BLOCK)).cast("int")
    return moving.join(blocks, ["src", "blk"], "left").withColumns(
        {"dst": F.get("dsts", place), "dst_deg": F.get("degs", place)}).drop("src", "blk", "__idx", "dsts", "degs")


def random_walks(edges: DataFrame, src: str, dst: str, length: int = 10, per_node: int = 5, seed: int = 42) -> DataFrame:
    """Uniform walks from every node: (walk, start, step, node) rows; a walk stops at a node without neighbours.

    The table of walkers is checkpointed now and then, so a lost executor never replays the whole walk.
    """
    blocks, _, degree = _walk_tables(edges, src, dst)
    walkers = _walkers(degree, per_node)
    for step in range(1, length):
        found = _proposed(walkers, blocks, _draw(seed, F.col("walk"), F.lit(step)))
        walkers = found.select("walk", "start", F.when(F.col("dst").isNull(), F.col("path")).otherwise(
            F.array_append("path", F.col("dst"))).alias("path"), F.coalesce("dst_deg", F.lit(0)).alias("deg"))
        if step % 3 == 0 and step + 1 < length:
            walkers = cut_lineage(walkers)
    return walkers.select("walk", "start", F.posexplode("path").alias("step", "node"))


def biased_walks(edges: DataFrame, src: str, dst: str, p: float, q: float, length: int = 10, per_node: int = 5,
                 seed: int = 42, proposals: int = 8) -> DataFrame:
    """Second-order walks: going back weighs 1/p, staying near the previous node 1, moving out 1/q.

    Rejection sampling: a uniform neighbour is proposed and accepted with its weight over the largest weight. Only
    whether (previous, proposed) is an edge must be looked up, and only where the draw does not decide by itself. Every
    walker first meets one proposal; those refused meet the others of ``proposals``, then further rounds until each has
    moved.
    """
    blocks, pairs, degree = _walk_tables(edges, src, dst)
    most, low, high = max(1.0 / p, 1.0, 1.0 / q), min(1.0, 1.0 / q), max(1.0, 1.0 / q)

    def share(node: Column, deg: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.greatest(F.lit(1).cast("long"), F.ceil(deg / _BLOCK)))

    near = None
    if low < high:
        sized = pairs.join(degree.select(F.col("node").alias("src"), "deg"), "src")
        near = cut_lineage(sized.groupBy(F.col("src").alias("prev"), share(F.col("dst"), F.col("deg")).alias("part")).agg(
            F.collect_list("dst").alias("__near")))

    def judged(walkers: DataFrame, label: int) -> DataFrame:
        """Each row's proposal of its number ``try``, with ``ok`` whether it is accepted (a stopped walk is, as it stands)."""
        seen = _proposed(walkers, blocks, _draw(seed, F.col("walk"), F.lit(label), F.col("try")))
        seen = seen.withColumn("prev", F.try_element_at("path", F.lit(-2))).withColumn(
            "chance", _draw(seed + 1, F.col("walk"), F.lit(label), F.col("try")) / F.lit(float(16 ** 15)))
        weight = F.when(F.col("prev").isNull(), most).when(F.col("dst") == F.col("prev"), 1.0 / p)
        if near is None:
            weight = weight.otherwise(1.0)
        else:
            weight = weight.when(F.col("chance") < low / most, most).when(F.col("chance") >= high / most, 0.0)
            seen = seen.withColumn("known", weight).withColumn("part", F.when(F.col("known").isNull(), share(F.col("dst"), F.col("prev_deg")))
                                                               .otherwise(-1 - F.pmod(F.xxhash64("walk"), F.lit(1024))))
            seen = seen.join(near, ["prev", "part"], "left")
            inside = F.coalesce(F.array_contains("__near", F.col("dst")), F.lit(False))
            weight = F.coalesce("known", F.when(inside, 1.0).otherwise(1.0 / q))
        return seen.withColumn("ok", F.col("dst").isNull() | (F.col("chance") < weight / most)).select(*state, "try", "dst", "dst_deg", "ok")

    state = ["walk", "start", "path", "prev_deg", "deg"]
    # What a walker is after a move; a walk that stands at a node without neighbours stays as it is.
    path = F.when(F.col("dst").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("dst")))
    after = [path.alias("path"), F.col("deg").alias("prev_deg"), F.coalesce("dst_deg", F.lit(0)).alias("deg")]
    current = _walkers(degree, per_node).withColumn("prev_deg", F.lit(0).cast("long")).select(*state)
    for step in range(1, length):
        first = cut_lineage(judged(current.withColumn("try", F.lit(0)), step * 1000))
        current, waiting = first.where("ok").select("walk", "start", *after), first.where(~F.col("ok")).select(*state)
        round_no, begin = 0, 1
        while not waiting.isEmpty():
            if begin < proposals:
                tries = waiting.withColumn("try", F.explode(F.sequence(F.lit(begin), F.lit(proposals - 1))))
                best = judged(tries, step * 1000 + round_no).withColumn("__after", F.struct(*after)).groupBy("walk").agg(
                    F.min_by("__after", F.when(F.col("ok"), F.col("try"))).alias("m"), *[F.any_value(c).alias(c) for c in state[1:]])
                best = cut_lineage(best)
                moved = best.where(F.col("m").isNotNull()).select("walk", "start", "m.path", "m.prev_deg", "m.deg")
                current, waiting = current.unionByName(moved), best.where(F.col("m").isNull()).select(*state)
            round_no, begin = round_no + 1, 0
    return current.select("walk", "start", F.posexplode("path").alias("step", "node"))


#: Walks that a partition of the skip-gram training has at least where more than a quarter of the cores take part.
_WALKS = 200_000
#: Most numbers of a matrix of vectors that MLlib trains.
_MATRIX = 5_000_000


def walk_embeddings(walks: DataFrame, dim: int = 64, window: int = 5, seed: int = 42, iterations: int = 5) -> DataFrame:
    """Skip-gram vectors of walk nodes: (node, emb_0 ..).

    MLlib keeps two vocabulary matrices of 4-byte numbers on the driver and on every executor: 8 * dim bytes a node. More
    than ``_MATRIX`` numbers in each are trained by buckets of nodes instead (``skipgram.fit``).
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array
    sentences = walks.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("s")).select(
        "walk", F.transform("s", lambda x: x["node"]).alias("sentence"))
    # Vocabulary count and training read the sentences again.
    sentences = cut_lineage(sentences)
    nodes = sentences.select(F.explode("sentence").alias("node")).distinct().count()
    if nodes * dim > _MATRIX:
        return vector_columns(skipgram.fit(sentences, nodes, dim, window, seed, iterations), "v", dim)
    sentences = sentences.select("sentence")
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    parts = max(1, cores // 4, min(cores, sentences.count() // _WALKS))
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, seed=seed, maxIter=iterations, numPartitions=parts,
                     inputCol="sentence", outputCol="v").fit(sentences)
    vectors = model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("v"))
    return vector_columns(vectors, "v", dim)


def inductive_embed(incidence: DataFrame, train: DataFrame, case: str, node: str, dim: int = 64, length: int = 10,
                    per_node: int = 5, window: int = 5, seed: int = 42) -> DataFrame:
    """Walk vectors learnt on train cases only; every other case takes the mean vector of the nodes it links to."""
    links = incidence.select(F.concat(F.lit("c:"), F.col(case).cast("string")).alias("__c"),
                             F.concat(F.lit("n:"), F.col(node).cast("string")).alias("__n"), case).distinct()
    inside = links.join(train.select(case).distinct(), case, "left_semi")
    both = inside.select(F.col("__c").alias("src"), F.col("__n").alias("dst")).unionByName(
        inside.select(F.col("__n").alias("src"), F.col("__c").alias("dst")))
    vectors = walk_embeddings(random_walks(both, "src", "dst", length, per_node, seed), dim, window, seed)
    columns = [f"emb_{i}" for i in range(dim)]
    own = inside.select(case, F.col("__c").alias("node")).distinct().join(vectors, "node").select(case, *columns)
    outside = links.join(train.select(case).distinct(), case, "left_anti").withColumnRenamed("__n", "node")
    pooled = pool_embeddings(outside, vectors, case, "node", columns)
    return own.unionByName(pooled)


# ---- factorisation ----
def svd_embed(incidence: DataFrame, case: str, node: str, value: Column, k: int, train: DataFrame | None = None,
              iterations: int = 6, oversample: int = 8, seed: int = 42) -> DataFrame:
    """Truncated SVD scores A V (k columns) of the case-node matrix, V fitted on the train cases.

    Randomised subspace iteration: the matrix stays a long table, each product is a join and a grouped sum, and only
    Gram matrices of at most (k + oversample) squared numbers reach the driver.
    """
    import numpy as np
    width = k + oversample
    cells = incidence.groupBy(F.col(case).alias("c"), F.col(node).alias("n")).agg(value.cast("double").alias("v"))
    cells = cut_lineage(cells)
    fit = cells if train is None else cells.join(train.select(F.col(case).alias("c")).distinct(), "c", "left_semi")
    names = [f"x{i}" for i in range(width)]

    def multiply(matrix: DataFrame, side: str, other: str, basis: DataFrame, columns: Sequence[str]) -> DataFrame:
        return matrix.join(basis, side).groupBy(other).agg(*[F.sum(F.col("v") * F.col(x)).alias(x) for x in columns])

    def gram(basis: DataFrame) -> np.ndarray:
        row = basis.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}")
                          for i in range(width) for j in range(i, width)]).first()
        result = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                result[i, j] = result[j, i] = row[f"g{i}_{j}"] or 0.0
        return result

    def rotate(basis: DataFrame, key: str, matrix: np.ndarray, columns: Sequence[str]) -> DataFrame:
        return basis.select(key, *[sum((F.col(names[j]) * float(matrix[j, i]) for j in range(width)), F.lit(0.0)).alias(c)
                                   for i, c in enumerate(columns)])

    def orthonormal(basis: DataFrame, key: str) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(basis))
        good = values > values.max() * 1e-12
        scale = np.where(good, 1.0 / np.sqrt(np.where(good, values, 1.0)), 0.0)
        return rotate(basis, key, vectors * scale, names)

    start = fit.select("n").distinct().select("n", *[
        (_draw(seed, F.col("n"), F.lit(i)) / F.lit(float(16 ** 15)) - 0.5).alias(x) for i, x in enumerate(names)])
    basis = orthonormal(cut_lineage(start), "n")
    for _ in range(iterations):
        left = cut_lineage(multiply(fit, "n", "c", basis, names))
        basis = orthonormal(cut_lineage(multiply(fit, "c", "n", orthonormal(left, "c"), names)), "n")
    left = cut_lineage(multiply(fit, "n", "c", basis, names))
    values, vectors = np.linalg.eigh(gram(left))
    order = np.argsort(values)[::-1][:k]
    outputs = [f"svd_{i}" for i in range(k)]
    right = rotate(basis, "n", vectors[:, order], outputs)
    return multiply(cells, "n", "c", right, outputs).withColumnRenamed("c", case)


# ---- nearest neighbours in feature space ----
#: Visits of vectors to blocks whose shuffles lie on disk together.
_VISITS = 4_000_000


def knn_edges(vectors: DataFrame, key: str, vector: str, k: int = 10, pivots: int = 32, block_rows: int | None = None,
              symmetric: bool = True) -> DataFrame:
    """Exact Euclidean k nearest neighbours as edges (src, dst, distance), ties by smaller id.

    Vectors go to the nearest of a bounded number of pivots and, inside a pivot, to blocks of bounded size. A first
    pass inside each block bounds every vector's k-th distance. The second pass sends a vector only to the pivots that
    the triangle inequality cannot rule out and compares blocks of vectors with blocks of vectors; every task keeps
    the k best per vector that its bound allows, so neither all pairs nor a whole group ever exists. Blocks have
    ``block_rows`` vectors, by default a 32nd of all (4096 at least, 32,768 at most), as vectors are shuffled once per block they
    meet. More than ``_VISITS`` of these are made by slices of the vectors, one after the other.
    """
    import numpy as np
    import pandas as pd
    spark = vectors.sparkSession
    # Single precision stays as it is where vectors travel; all arithmetic is in doubles.
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    given = vectors.select(F.col(key).cast("string").alias("member"), F.col(vector).cast(kind).alias("v"))
    given = stored(given.withColumn("id", F.sha2(F.to_json(F.col("v").cast("array<double>")), 256)))
    # Equal vectors are searched once. Their k + 1 smallest ids stand for all copies in any neighbour list.
    member = given.select("member", "id")
    heads = top_k(member, ["id"], [F.asc("member")], k + 1)
    base = given.groupBy("id").agg(F.any_value("v").alias("v"))
    chosen = np.array([r["v"] for r in base.orderBy(F.md5("id"), "id").limit(pivots).collect()])
    shared = spark.sparkContext.broadcast(chosen)

    def text(values):
        """Object series, as an Arrow-backed one may come in several or no chunks."""
        return pd.Series(list(values), dtype=object)

    def matrix(values):
        return np.stack(values.to_numpy()).astype(float)

    def distances(a, b):
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0.0))

    def locate(batches):
        for pdf in batches:
            if len(pdf):
                d = distances(matrix(pdf["v"]), shared.value)
                yield pd.DataFrame({"id": text(pdf["id"]), "v": list(pdf["v"]), "pivot": d.argmin(1), "dist": d.min(1),
                                    "all": list(d)})

    placed = stored(base.mapInPandas(locate, f"id string, v {kind}, pivot int, dist double, all array<double>"))
    stats = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()
    total = sum(r["n"] for r in stats)
    block_rows = block_rows or min(32_768, max(4096, total // 32))
    blocks = {r["pivot"]: max(1, -(-r["n"] // block_rows)) for r in stats}
    radius = {r["pivot"]: r["radius"] for r in stats}
    chunks = max(1, -(-total // block_rows))
    block_of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])[F.col("pivot")]
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), block_of).cast("int"))

    def exact(a, b):
        """Distances by differences: no cancellation, so equal vectors are exactly 0 apart."""
        return np.sqrt(((a - b) ** 2).sum(-1))

    def screened(a, b):
        """Slices of the rows of ``a`` with their squared distances to ``b`` and how far these may be off.

        A product of matrices screens the pairs; only the few that may be nearest are measured by differences.
        """
        tall, wide = (a * a).sum(1), (b * b).sum(1)
        plain = np.isfinite(tall).all() and np.isfinite(wide).all()
        slack = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (tall.max() + wide.max()) if plain else 0.0
        step = max(1, 4_000_000 // max(1, len(b) if plain else b.size))
        for i in range(0, len(a), step):
            part = a[i:i + step]
            yield i, (tall[i:i + step, None] + wide[None, :] - 2.0 * (part @ b.T)) if plain else ((part[:, None, :] - b[None, :, :]) ** 2).sum(2), slack

    def best(ids, others, a, b, limit):
        """The k nearest others per row within its limit by (distance, id)."""
        place = np.empty(len(others), np.int64)
        place[np.argsort(others)] = np.arange(len(others))
        width, found = min(k + 1, len(b)), []
        for at, square, slack in screened(a, b):
            kth, most = np.partition(square, width - 1, axis=1)[:, width - 1], limit[at:at + len(square)] ** 2
            row, col = np.nonzero(square <= (np.where(most < kth, most, kth) + 2 * slack)[:, None])
            other = ids[at + row] != others[col]
            row, col = row[other], col[other]
            d = exact(a[at + row], b[col])
            order = np.lexsort((place[col], d, row))
            row, col, d = row[order], col[order], d[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((ids[at + row[kept]], others[col[kept]], d[kept]))
        src, dst, d = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"src": text(src), "dst": text(dst), "distance": pd.Series(d, dtype="float64")})

    def first_pass(pdf):
        bound = np.full(len(pdf), np.inf)
        if len(pdf) > k:
            v = matrix(pdf["v"])
            for at, square, slack in screened(v, v):
                here = np.arange(len(square))
                square[here, at + here] = np.inf
                bound[at:at + len(square)] = np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0.0) + slack)
        return pd.DataFrame({"id": text(pdf["id"]), "bound": bound})

    bounds = placed.select("id", "v", "pivot", "block").groupBy("pivot", "block").applyInPandas(
        first_pass, "id string, bound double")
    limits = stored(placed.join(bounds, "id"))
    radii = F.array(*[F.lit(float(radius.get(i, -1.0))) for i in range(len(chosen))])
    counts = F.array(*[F.lit(int(blocks.get(i, 0))) for i in range(len(chosen))])
    reach = F.filter(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda i: (counts[i] > 0) & (
        F.element_at("all", i + 1) - radii[i] <= F.col("bound") * (1 + 1e-9) + 1e-9))
    def compare(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"src": text([]), "dst": text([]), "distance": pd.Series([], dtype="float64")})
        return best(left["id"].to_numpy(dtype=object), right["t_id"].to_numpy(dtype=object), matrix(left["v"]), matrix(right["t_v"]),
                    left["limit"].to_numpy())

    by = ["pivot", "block", "chunk"]
    chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
    own = base.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))

    def nearest(some: DataFrame) -> DataFrame:
        """The k + 1 nearest of some of the vectors, all of a chunk or none."""
        visits = (some.select("id", "v", (F.col("bound") * (1 + 1e-9) + 1e-9).alias("limit"), F.explode(reach).alias("pivot"))
                  .withColumn("block", F.explode(F.sequence(F.lit(0), (block_of - 1).cast("int")))).withColumn("chunk", chunk))
        wanted = visits.select(*by).distinct()
        targets = placed.select("id", "v", "pivot", "block").join(wanted, ["pivot", "block"]).select(
            F.col("id").alias("t_id"), F.col("v").alias("t_v"), F.col("pivot").alias("t_pivot"), F.col("block").alias("t_block"),
            F.col("chunk").alias("t_chunk"))
        partial = visits.groupBy(*by).cogroup(targets.groupBy(*[f"t_{c}" for c in by])).applyInPandas(
            compare, "src string, dst string, distance double")
        itself = own.join(some.select(F.col("id").alias("src")), "src", "left_semi") if slices > 1 else own
        near = partial.unionByName(itself).withColumnRenamed("dst", "id").join(heads, "id").select(
            F.col("src").alias("id"), F.col("member").alias("dst"), "distance")
        return top_k(near, ["id"], [F.asc("distance"), F.asc("dst")], k + 1)

    count = limits.select(F.aggregate(reach, F.lit(0).cast("long"), lambda n, i: n + counts[i]).alias("n")).agg(F.sum("n")).first()[0]
    slices = min(chunks, max(1, -(-(count or 0) // _VISITS)))
    if slices == 1:
        per_group = nearest(limits)
    else:
        parts = [stored(nearest(limits.where(F.pmod(chunk, F.lit(slices)) == i))) for i in range(slices)]
        per_group = reduce(DataFrame.unionByName, parts)
    pairs = member.withColumnRenamed("member", "src").join(per_group, "id").where(F.col("src") != F.col("dst"))
    edges = top_k(pairs.select("src", "dst", "distance"), ["src"], [F.asc("distance"), F.asc("dst")], k)
    if not symmetric:
        return edges
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()
