"""Tiers, best hits, method comparison, similarity and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import relational as R
from ..operators import similarity as S
from ..tables import table as t
from .registry import query


@query("baseline_vs_advanced", "WITH j AS (SELECT l_orderkey, p_type, l_returnflag, l_linestatus = 'O' AS adv, l_linestatus = 'O' AND l_returnflag = 'R' AS fus, p_type ILIKE '%0' AS ph FROM lineitem JOIN part ON p_partkey = l_partkey), g AS (SELECT l_orderkey, p_type, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (NOT adv), '') AS baseline_tools, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (adv), '') AS advanced_tools, count(DISTINCT l_returnflag) FILTER (adv) AS n_adv, bool_or(NOT adv) AS base, bool_or(adv AND fus) AS fusion, bool_or(ph) AS ph FROM j GROUP BY ALL) SELECT l_orderkey, p_type, baseline_tools, advanced_tools, n_adv, NOT base AND NOT ph AND (fusion OR n_adv >= 2) AS advanced_only FROM g")
def baseline_vs_advanced(spark, d):
    j = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").join(t(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    adv = F.col("l_linestatus") == "O"
    return E.compare_methods(j, ["l_orderkey", "p_type"], "l_returnflag", adv, F.col("l_returnflag") == "R", F.col("p_type").ilike("%0"))


@query("tiering", "WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, round(greatest(max(l_discount), max(l_tax), max(least(l_quantity / 50, 1.0))), 6) AS evidence FROM lineitem GROUP BY l_orderkey), x AS (SELECT o_orderkey, coalesce(n, 0) AS n_methods, coalesce(evidence, 0.0) AS evidence FROM orders LEFT JOIN g ON l_orderkey = o_orderkey) SELECT o_orderkey, n_methods, evidence, CASE WHEN n_methods >= 2 THEN 'positive' WHEN n_methods = 1 THEN 'gray' ELSE 'negative' END AS tier, CASE WHEN n_methods >= 3 THEN '1A' WHEN n_methods = 2 THEN '1B' WHEN n_methods = 0 THEN '3' WHEN evidence >= 0.5 THEN '2A' ELSE '2B' END AS subtier FROM x")
def tiering(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n"), F.round(F.greatest(F.max("l_discount"), F.max("l_tax"), F.max(F.least(F.col("l_quantity") / 50, F.lit(1.0)))), 6).alias("e"))
    x = t(spark, d, "orders").select("o_orderkey").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_methods"), F.coalesce("e", F.lit(0.0)).alias("evidence"))
    return x.withColumn("tier", E.tier(F.col("n_methods"))).withColumn("subtier", E.subtier(F.col("n_methods"), F.col("evidence")))


@query("best_hit", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1")
def best_hit(spark, d):
    return R.first_by(t(spark, d, "lineitem"), ["l_orderkey"], F.desc("l_extendedprice"), *map(F.asc, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"))).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query("multi_cutoff_hit", "SELECT user_id, cutoff, event_id, round(value, 6) AS value FROM (SELECT e.*, c.cutoff, row_number() OVER (PARTITION BY user_id, cutoff ORDER BY value DESC, event_id) AS rn FROM events e JOIN (SELECT unnest([0.0::DOUBLE, 1.0, 10.0, 50.0]) AS cutoff) c ON e.value >= c.cutoff) WHERE rn = 1")
def multi_cutoff_hit(spark, d):
    best = E.best_at_cutoffs(t(spark, d, "events"), "user_id", "value", [0.0, 1.0, 10.0, 50.0], F.desc("value"), F.asc("event_id"))
    return best.select("user_id", "cutoff", "event_id", F.round("value", 6).alias("value"))


VEC = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS r, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM e a JOIN e b ON a.vec_id <> b.vec_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS INTEGER) AS rank FROM s), n AS (SELECT * FROM k WHERE rank <= {k})"
VOTE = ", l AS (SELECT n.*, CAST(label AS VARCHAR) AS family FROM n JOIN embeddings ON vec_id = r), p AS (SELECT q, family, count(*) AS c, min(rank) AS first, max(sim) AS best, round(sum(sim), 6) AS weight FROM l GROUP BY ALL), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {by} DESC, first) AS rn FROM p) WHERE rn = 1), o AS (SELECT p.q, sum(p.c) AS k, max(p.best) AS top_sim, max(p.best) FILTER (p.family <> w.family) AS other FROM p JOIN w ON w.q = p.q GROUP BY p.q)"
VOTED = " SELECT w.q, w.family, o.top_sim, round(w.c / o.k, 6) AS purity, round(CASE WHEN o.other IS NULL THEN 1.0 ELSE o.top_sim - o.other END, 6) AS margin FROM w JOIN o ON o.q = w.q"
CENT = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT CAST(label AS VARCHAR) AS family, list(x ORDER BY i) AS c FROM m GROUP BY label), s AS (SELECT vec_id AS id, family, round(list_cosine_similarity(v, c), 6) AS sim FROM e, c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, family) AS rn FROM s)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings")


def near(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Searched once and written: every voter reads the same table."""
    return S.knn(vectors(spark, d), vectors(spark, d), k)


def families(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("r"), F.col("label").cast("string").alias("family"))


@query("knn_topk", VEC.format(k=15) + " SELECT q, r, sim, rank FROM n")
def knn_topk(spark, d):
    return near(spark, d, 15).select("q", "r", "sim", "rank")


@query("knn_vote", VEC.format(k=15) + VOTE.format(by="c") + VOTED)
def knn_vote(spark, d):
    return S.vote(near(spark, d, 15), families(spark, d))


@query("weighted_vote", VEC.format(k=15) + VOTE.format(by="weight") + VOTED)
def weighted_vote(spark, d):
    return S.vote(near(spark, d, 15), families(spark, d), weighted=True)


@query("centroid_assign", CENT + " SELECT a.id, a.family, a.sim, round(coalesce(a.sim - b.sim, 1.0), 6) AS margin FROM r a LEFT JOIN r b ON b.id = a.id AND b.rn = 2 WHERE a.rn = 1")
def centroid_assign(spark, d):
    named = vectors(spark, d).withColumn("family", F.col("label").cast("string"))
    return S.nearest_centroid(vectors(spark, d), S.centroids(named, "family"), "family")


def ballots(spark: SparkSession, d: str) -> DataFrame:
    """Three voters; each abstains where its own confidence is low."""
    k15 = near(spark, d, 15)
    a = S.vote(k15, families(spark, d)).select(F.col("q").alias("id"), F.lit("k15").alias("method"), F.when(F.col("purity") >= 0.2, F.col("family")).alias("family"), F.col("purity").alias("confidence"))
    b = S.vote(k15.filter("rank <= 5"), families(spark, d)).select(F.col("q").alias("id"), F.lit("k5").alias("method"), F.when(F.col("purity") >= 0.4, F.col("family")).alias("family"), F.col("purity").alias("confidence"))
    c = centroid_assign(spark, d).select("id", F.lit("centroid").alias("method"), "family", F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return a.unionByName(b).unionByName(c)


WEIGHTS = {"k15": 0.5, "k5": 0.3, "centroid": 0.2}
BALLOTS = (
    VEC.format(k=15)
    + VOTE.format(by="c")
    + """, va AS (SELECT w.q AS id, 0.5 AS w, w.family, round(w.c / o.k, 6) AS conf FROM w JOIN o ON o.q = w.q),
p5 AS (SELECT q, family, count(*) AS c, min(rank) AS first FROM l WHERE rank <= 5 GROUP BY ALL),
w5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, first) AS rn FROM p5) WHERE rn = 1),
k5 AS (SELECT q, sum(c) AS k FROM p5 GROUP BY q),
vb AS (SELECT w5.q AS id, 0.3 AS w, family, round(c / k, 6) AS conf FROM w5 JOIN k5 USING (q)),
u AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) / sqrt(list_dot_product(v, v)) AS x FROM e),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
ce AS (SELECT CAST(label AS VARCHAR) AS family, list(x ORDER BY i) AS c FROM m GROUP BY label),
cs AS (SELECT vec_id AS id, family, round(list_cosine_similarity(v, ce.c), 6) AS sim FROM e, ce),
cr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, family) AS rn FROM cs),
vc AS (SELECT id, 0.2 AS w, family, least(greatest(sim, 0.0), 1.0) AS conf FROM cr WHERE rn = 1),
b AS (SELECT id, w, CASE WHEN conf >= 0.2 THEN family END AS family, conf FROM va UNION ALL SELECT id, w, CASE WHEN conf >= 0.4 THEN family END, conf FROM vb UNION ALL SELECT * FROM vc)"""
)
CONSENSUS = ", aw AS (SELECT id, CAST(sum(w) {only} AS DOUBLE) AS aw FROM b GROUP BY id), sc2 AS (SELECT b.id, family, round(CAST(sum(CAST(w AS DOUBLE) * conf) AS DOUBLE) / aw, 8) AS score, count(*) AS n_agree FROM b JOIN aw ON aw.id = b.id WHERE family IS NOT NULL GROUP BY b.id, family, aw), be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, family) AS rn FROM sc2) WHERE rn = 1) SELECT i.id, CASE WHEN score >= {tau} THEN family END AS family, coalesce(score, 0.0) AS score, coalesce(n_agree, 0) AS n_agree FROM (SELECT DISTINCT id FROM b) i LEFT JOIN be ON be.id = i.id"


@query("consensus_a", BALLOTS + CONSENSUS.format(only="FILTER (family IS NOT NULL)", tau=0.3))
def consensus_a(spark, d):
    return E.consensus(ballots(spark, d), WEIGHTS, over_present=True, abstain_below=0.3)


@query("consensus_b", BALLOTS + CONSENSUS.format(only="", tau=0.2))
def consensus_b(spark, d):
    return E.consensus(ballots(spark, d), WEIGHTS, over_present=False, abstain_below=0.2)


@query("consensus_details", BALLOTS + """, v AS (SELECT id, family, CAST(family AS INTEGER) % 3 AS parent, CAST(round(sum(CAST(w AS DOUBLE) * conf), 8) AS DOUBLE) AS s, count(*) AS n,
  list(CASE CAST(round(w * 10) AS INTEGER) WHEN 5 THEN 'k15' WHEN 3 THEN 'k5' ELSE 'centroid' END) AS m FROM b WHERE family IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, family) AS rn FROM v), t AS (SELECT id, family AS top, parent AS tp FROM r WHERE rn = 1)
SELECT r.id, max(top) AS family, round(sum(CASE WHEN parent = tp THEN n ELSE 0 END) / sum(n), 6) AS agree_frac, string_agg(family, ',' ORDER BY rn) AS all_families, array_to_string(list_sort(flatten(list(m))), ',') AS voters FROM r JOIN t ON t.id = r.id GROUP BY r.id""")
def consensus_details(spark, d):
    """Agreement of the voters by parent, here the label modulo three; all families by score; who voted."""
    return E.vote_details(ballots(spark, d), WEIGHTS, (F.col("family").cast("int") % 3).cast("string"))


@query("minmax_rank", "WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS price, avg(p_size) AS size, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand), m AS (SELECT *, ln(1 + n) AS ln FROM g), x AS (SELECT p_brand, round(0.35 * coalesce((price - min(price) OVER ()) / nullif(max(price) OVER () - min(price) OVER (), 0), 0) + 0.30 * coalesce((size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0), 0) + 0.25 * coalesce((types - min(types) OVER ()) / nullif(max(types) OVER () - min(types) OVER (), 0), 0) + 0.10 * coalesce((ln - min(ln) OVER ()) / nullif(max(ln) OVER () - min(ln) OVER (), 0), 0), 6) AS score FROM m) SELECT p_brand, score, CAST(row_number() OVER (ORDER BY score DESC, p_brand) AS INTEGER) AS place FROM x")
def minmax_rank(spark, d):
    from pyspark.sql import Window

    g = t(spark, d, "part").groupBy("p_brand").agg(F.log1p(F.count("*")).alias("ln"), F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"), F.count_distinct("p_type").alias("types"))
    score = 0.35 * E.min_max("price") + 0.30 * E.min_max("size") + 0.25 * E.min_max("types") + 0.10 * E.min_max("ln")
    return g.select("p_brand", F.round(score, 6).alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("p_brand"))))


HEADS = "WITH g AS (SELECT l_orderkey, min(l_returnflag) AS p1, max(l_returnflag) AS p2, CASE WHEN min(l_linestatus) = 'F' THEN 'R' ELSE 'N' END AS p3, round(least(max(l_discount) * 10, 1.0), 9) AS a, round(max(l_tax) * 12, 9) AS b, round(max(l_quantity) / 50, 9) AS c FROM lineitem GROUP BY l_orderkey)"
TIER = "CASE WHEN score > 0.35 THEN 'FLAG' WHEN score > 0.15 THEN 'WATCH' ELSE 'ACCEPT' END AS tier"


def heads(spark: SparkSession, d: str) -> DataFrame:
    """Three calls of each order and their confidences."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("p1"), F.max("l_returnflag").alias("p2"), F.min("l_linestatus").alias("s"), F.max("l_discount").alias("a"), F.max("l_tax").alias("b"), F.max("l_quantity").alias("c"))
    return li.select("l_orderkey", "p1", "p2", F.when(F.col("s") == "F", "R").otherwise("N").alias("p3"), F.round(F.least(F.col("a") * 10, F.lit(1.0)), 9).alias("a"), F.round(F.col("b") * 12, 9).alias("b"), F.round(F.col("c") / 50, 9).alias("c"))


@query("triage", HEADS + ", s AS (SELECT l_orderkey, (1 + 1 + CAST(p2 = p1 AS INTEGER) + CAST(p3 = p1 AS INTEGER)) / 4.0::DOUBLE AS agreement, (a + b + c) / 3 AS conf, greatest(a, b, c) AS top FROM g), x AS (SELECT l_orderkey, agreement, round(0.40::DOUBLE * (1 - agreement) + 0.35::DOUBLE * (1 - conf) + 0.25::DOUBLE * least(greatest(top - conf, 0), 1), 9) AS score FROM s) SELECT l_orderkey, agreement, round(score, 6) AS score, " + TIER + " FROM x")
def triage(spark, d):
    """Four votes: three heads and the call itself, which follows the first head."""
    h = heads(spark, d)
    agree = (2 + (F.col("p2") == F.col("p1")).cast("int") + (F.col("p3") == F.col("p1")).cast("int")) / 4.0
    x = h.select("l_orderkey", agree.alias("agreement"), E.triage(agree, (F.col("a") + F.col("b") + F.col("c")) / 3, F.col("a"), F.col("b"), F.col("c")).alias("t"))
    return x.select("l_orderkey", "agreement", F.round("t.score", 6).alias("score"), "t.tier")


@query("triage_majority", HEADS + ", s AS (SELECT l_orderkey, greatest(1 + CAST(p2 = p1 AS INTEGER) + CAST(p3 = p1 AS INTEGER), 1 + CAST(p2 = p3 AS INTEGER)) AS n, a AS conf, greatest(a, b, c) AS top FROM g), x AS (SELECT l_orderkey, n, round(0.40::DOUBLE * (1 - n / 3.0::DOUBLE) + 0.35::DOUBLE * (1 - conf) + 0.25::DOUBLE * least(greatest(top - conf, 0), 1), 9) AS score FROM s) SELECT l_orderkey, n AS n_majority, round(score, 6) AS score, " + TIER + " FROM x")
def triage_majority(spark, d):
    """Three heads; the share of the majority counts, and the first head's confidence stands for the call's."""
    h = heads(spark, d).withColumn("n", E.majority(F.col("p1"), F.col("p2"), F.col("p3")))
    x = h.select("l_orderkey", F.col("n").alias("n_majority"), E.triage(F.col("n") / 3.0, F.col("a"), F.col("a"), F.col("b"), F.col("c")).alias("t"))
    return x.select("l_orderkey", "n_majority", F.round("t.score", 6).alias("score"), "t.tier")
