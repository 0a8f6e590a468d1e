"""Evidence tables brought together, and what is computed of them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import merge as J
from ..operators import metrics as M
from ..tables import scratch
from ..tables import table as t
from .evidence import HEADS, VEC, heads, near, vectors
from .registry import query


@query("identity_map", "WITH x AS (SELECT md5(text) AS k, doc_id, doc_id % 2 = 0 AS l FROM documents), a AS (SELECT k, count(DISTINCT doc_id) AS n_left FROM x WHERE l GROUP BY k), b AS (SELECT k, count(DISTINCT doc_id) AS n_right FROM x WHERE NOT l GROUP BY k) SELECT k, n_left, n_right FROM a JOIN b USING (k)")
def identity_map(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    return J.identity_map(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1"), "k", "doc_id", "doc_id")


@query("identity_coverage", "WITH x AS (SELECT md5(text) AS k, doc_id, doc_id % 2 = 0 AS l FROM documents), m AS (SELECT k FROM x WHERE l INTERSECT SELECT k FROM x WHERE NOT l) SELECT count(*) FILTER (l) AS n_left, count(*) FILTER (l AND k IN (SELECT k FROM m)) AS left_mapped, count(*) FILTER (NOT l AND k IN (SELECT k FROM m)) AS right_mapped, count(DISTINCT k) FILTER (k IN (SELECT k FROM m)) AS n_digests FROM x")
def identity_coverage(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"))
    m = J.identity_map(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 2 = 1"), "k", "doc_id", "doc_id")
    n = x.agg(F.count(F.when(F.col("doc_id") % 2 == 0, 1)).alias("n_left"))
    return m.agg(F.coalesce(F.sum("n_left"), F.lit(0)).alias("left_mapped"), F.coalesce(F.sum("n_right"), F.lit(0)).alias("right_mapped"), F.count("*").alias("n_digests")).join(F.broadcast(n))  # one row each


@query("prioritized_match", "WITH i AS (SELECT doc_id, md5(text) AS k FROM documents), a AS (SELECT doc_id, 'q' || quality AS v FROM labels), b AS (SELECT md5(text) AS k, min(lang) AS v FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT i.doc_id, coalesce(a.v, b.v) AS family, CASE WHEN a.v IS NOT NULL THEN 'id' WHEN b.v IS NOT NULL THEN 'digest' END AS matched_by FROM i LEFT JOIN a USING (doc_id) LEFT JOIN b ON b.k = i.k")
def prioritized_match(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("k"))
    by_id = t(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("family"))
    by_digest = docs.filter("doc_id % 3 = 0").groupBy("k").agg(F.min("lang").alias("family"))
    return J.prioritized(docs.select("doc_id", "k"), by_id, by_digest, "doc_id", "k", "family").select("doc_id", "family", "matched_by")


@query("merge_defaults", "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def merge_defaults(spark, d):
    return J.with_defaults(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query("merge_predictions", "WITH a AS (SELECT l_orderkey AS id, max(l_discount) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS id, max(l_tax) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), c AS (SELECT o_orderkey AS id, o_orderstatus AS truth FROM orders) SELECT id, x, y, truth FROM a JOIN b USING (id) JOIN c USING (id)")
def merge_predictions(spark, d):
    li = t(spark, d, "lineitem")
    a = li.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_discount").alias("x"))
    b = li.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_tax").alias("y"))
    return a.join(b, "id").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("truth")), "id")


@query("four_way_evidence", "WITH a AS (SELECT l_orderkey AS id, max(l_discount) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey AS id, max(l_tax) AS x FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), c AS (SELECT l_orderkey AS id, max(l_quantity / 50) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), e AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, round(coalesce(a.x, 0.0), 6) AS a, round(coalesce(b.x, 0.0), 6) AS b, round(coalesce(c.x, 0.0), 6) AS c, coalesce(e.n, 0) AS n, CAST(a.x IS NOT NULL AS INTEGER) + CAST(b.x IS NOT NULL AS INTEGER) + CAST(c.x IS NOT NULL AS INTEGER) AS n_tools FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey LEFT JOIN c ON c.id = o_orderkey LEFT JOIN e ON e.id = o_orderkey")
def four_way_evidence(spark, d):
    """Every item, whatever tables have evidence of it.  The four sides share their key, so one aggregation stands for four scans and joins."""
    li = t(spark, d, "lineitem")
    of = lambda flag, x: F.max(F.when(F.col("l_returnflag") == flag, x))
    e = li.groupBy(F.col("l_orderkey").alias("id")).agg(of("A", F.col("l_discount")).alias("a"), of("N", F.col("l_tax")).alias("b"), of("R", F.col("l_quantity") / 50).alias("c"), F.count("*").alias("n"))
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(e, "id", "left")
    tools = sum((F.col(c).isNotNull().cast("int") for c in "abc"), F.lit(0))
    return x.select("id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in "abc"], F.coalesce("n", F.lit(0)).cast("long").alias("n"), tools.alias("n_tools"))


EDGES = VEC.format(k=5) + ", l AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM embeddings), x AS (SELECT q, r, sim, a.label FROM n JOIN l a ON a.vec_id = q JOIN l b ON b.vec_id = r WHERE a.label = b.label AND a.label <> -1 AND q <> r)"


def clusters(spark: SparkSession, d: str):
    return vectors(spark, d).select("vec_id", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label"))


@query("within_cluster_edges", EDGES + " SELECT q, r, label, sim FROM x")
def within_cluster_edges(spark, d):
    return J.within_cluster(near(spark, d, 5).select("q", "r", "sim"), clusters(spark, d), "q", "r", "vec_id", "label").select("q", "r", "label", "sim")


@query("pair_identity", EDGES + " SELECT z.label, z.n, count(x.sim) AS n_pairs, round(coalesce(avg(x.sim), 0.0), 6) AS mean, round(coalesce(quantile_cont(x.sim, 0.5), 0.0), 6) AS median FROM (SELECT label, count(*) AS n FROM l WHERE label <> -1 GROUP BY label) z LEFT JOIN x USING (label) GROUP BY z.label, z.n")
def pair_identity(spark, d):
    return J.pair_identity(within_cluster_edges(spark, d), clusters(spark, d), "label", "sim").select("label", "n", "n_pairs", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("target_family", "WITH b AS (SELECT * FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem) WHERE rn = 1) SELECT l_orderkey, l_partkey, p_brand FROM b LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 > 0) ON p_partkey = l_partkey")
def target_family(spark, d):
    labels = t(spark, d, "part").filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return J.family_of_best(t(spark, d, "lineitem"), labels, "l_orderkey", "l_partkey", "p_brand", F.desc("l_extendedprice"), F.asc("l_partkey"))


@query("pruned_fetch", "SELECT source, doc_id, length(text) AS n FROM documents WHERE source IN ('src1', 'src7') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def pruned_fetch(spark, d):
    docs = t(spark, d, "documents")
    wanted = docs.filter("source in ('src1', 'src7')").select("source", "doc_id").join(t(spark, d, "labels").filter("quality = 0"), "doc_id", "left_semi").select("source", "doc_id")
    return J.fetch(docs, wanted, "source", "doc_id").select("source", "doc_id", F.char_length("text").cast("long").alias("n"))


@query("family_lookup", "WITH i AS (SELECT DISTINCT p_partkey % 40 AS k, CASE WHEN p_partkey % 3 = 0 THEN 'GH' || (p_partkey % 40) || '_' || (p_partkey % 4) ELSE 'GH' || (p_partkey % 40) END AS family FROM part), r AS (SELECT 'GH' || s_suppkey AS family, '3.2.1.' || s_suppkey AS ec FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'GH' || s_suppkey || '_1', '9.9.9.' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) SELECT i.family, coalesce(x.ec, y.ec) AS ec, coalesce(x.ec, y.ec) IS NOT NULL AS mapped FROM (SELECT DISTINCT family FROM i) i LEFT JOIN r x ON x.family = i.family LEFT JOIN r y ON contains(i.family, '_') AND y.family = split_part(i.family, '_', 1)")
def family_lookup(spark, d):
    k, gh = F.col("p_partkey"), F.lit("GH")
    name = F.concat(gh, (k % 40).cast("string"))
    items = t(spark, d, "part").select(F.when(k % 3 == 0, F.concat(name, F.lit("_"), (k % 4).cast("string"))).otherwise(name).alias("family")).distinct()
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(gh, F.col("s_suppkey").cast("string")).alias("n"), F.col("s_suppkey").cast("string").alias("x"))
    ref = s.filter("s_suppkey % 2 = 0").select(F.col("n").alias("family"), F.concat(F.lit("3.2.1."), "x").alias("ec")).union(s.filter("s_suppkey % 3 = 0").select(F.concat("n", F.lit("_1")), F.concat(F.lit("9.9.9."), "x")))
    return J.lookup_with_base(items, ref, "family", ["ec"])


@query("terms_by_aspect", "WITH x AS (SELECT DISTINCT l_orderkey, l_returnflag AS aspect, p_type AS term FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT l_orderkey, coalesce(string_agg(term, ';' ORDER BY term) FILTER (aspect = 'A'), '') AS a, coalesce(string_agg(term, ';' ORDER BY term) FILTER (aspect = 'N'), '') AS n, coalesce(string_agg(term, ';' ORDER BY term) FILTER (aspect = 'R'), '') AS r FROM x GROUP BY l_orderkey")
def terms_by_aspect(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_orderkey").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == k, F.col("p_type")))), ";").alias(k.lower()) for k in "ANR"])


GRID = [0.0, 0.3, 0.5, 0.7, 0.9]


@query("threshold_grid", HEADS + ", x AS (SELECT o_orderstatus AS b, c, p1 = p2 AS x, p1 = p2 OR p1 = p3 AS o FROM g JOIN orders ON o_orderkey = l_orderkey), y AS (SELECT unnest(['overall', b]) AS bucket, c, x, o FROM x), h AS (SELECT unnest([0.0::DOUBLE, 0.3, 0.5, 0.7, 0.9]) AS threshold), k AS (SELECT bucket, threshold, count(*) AS n, count(*) FILTER (c >= threshold) AS confident, count(*) FILTER (c >= threshold AND x) AS nx, count(*) FILTER (c >= threshold AND o) AS no FROM y, h GROUP BY ALL) SELECT bucket, threshold, n, confident, round((n - confident) / n, 4) AS abstain_share, coalesce(round(nx / nullif(confident, 0), 4), 0.0) AS exact_of_confident, coalesce(round(no / nullif(confident, 0), 4), 0.0) AS overlap_of_confident, round(nx / n, 4) AS exact_of_all, round(no / n, 4) AS overlap_of_all FROM k")
def threshold_grid(spark, d):
    x = heads(spark, d).join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    return M.threshold_grid(x, "o_orderstatus", "c", F.col("p1") == F.col("p2"), (F.col("p1") == F.col("p2")) | (F.col("p1") == F.col("p3")), GRID)


@query("prediction_sets", HEADS + ", c AS (SELECT l_orderkey, p1 AS f, a AS c FROM g UNION ALL SELECT l_orderkey, p2, b FROM g UNION ALL SELECT l_orderkey, p3, c FROM g), m AS (SELECT l_orderkey, f, max(c) AS c FROM c GROUP BY ALL), z AS (SELECT l_orderkey, count(*) AS menu_size, count(*) FILTER (round(1 - c, 9) <= 0.4) AS set_size, bool_or(round(1 - c, 9) <= 0.4 AND f = 'R') AS covered FROM m GROUP BY l_orderkey) SELECT menu_size, set_size, count(*) AS n, round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM z GROUP BY ALL")
def prediction_sets(spark, d):
    """Sets at a quantile of 0.4; their sizes, and how many hold the true family, here R."""
    h = heads(spark, d)
    c = h.select("l_orderkey", F.explode(F.array(*[F.struct(F.col(p).alias("f"), F.col(c).alias("c")) for p, c in (("p1", "a"), ("p2", "b"), ("p3", "c"))])).alias("x")).select("l_orderkey", "x.*")
    s = M.menu(c, "l_orderkey", "f", "c").select(F.size("menu").cast("long").alias("menu_size"), M.prediction_set(F.col("menu"), 0.4).alias("s"))
    return s.groupBy("menu_size", F.size("s").cast("long").alias("set_size")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.array_contains("s", "R"), 1.0).otherwise(0.0)), 6).alias("coverage"))


@query("energy_score", "WITH f AS (SELECT min(p_size) AS a0, max(p_size) AS a1, min(p_retailprice) AS b0, max(p_retailprice) AS b1 FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, round(((p_size - a0) / CAST(a1 - a0 AS DOUBLE) + 1 - (p_retailprice - b0) / (b1 - b0)) / 2, 6) AS energy FROM part, f")
def energy_score(spark, d):
    part = t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return M.energy(part, {"p_size": 1, "p_retailprice": -1}, part.filter("p_partkey % 2 = 0")).select("p_partkey", F.round("energy", 6).alias("energy"))


@query("cluster_profile", "WITH m AS (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_type) AS rn, sum(c) OVER (PARTITION BY p_brand) AS s FROM m) SELECT p_brand, count(*) AS n, count(DISTINCT p_size) AS n_sizes, count(DISTINCT p_type) AS n_types, round(avg(p_retailprice), 6) AS mean_price, max(o.p_type) AS top_type, round(max(o.c / o.s), 6) AS top_share FROM part JOIN (SELECT p_brand AS b, p_type, c, s FROM o WHERE rn = 1) o ON b = p_brand GROUP BY p_brand".replace("count(DISTINCT p_type)", "count(DISTINCT part.p_type)"))
def cluster_profile(spark, d):
    part = t(spark, d, "part")
    g = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("n_sizes"), F.count_distinct("p_type").alias("n_types"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))
    top = M.modal(part, "p_brand", "p_type").select("p_brand", F.col("top").alias("top_type"), F.round("share", 6).alias("top_share"))
    return g.join(top, "p_brand")


@query("tier_class_counts", "WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n >= 2 THEN 'positive' WHEN n = 1 THEN 'gray' ELSE 'negative' END AS tier, o_orderpriority AS class, count(*) AS n FROM orders LEFT JOIN g ON l_orderkey = o_orderkey GROUP BY ALL")
def tier_class_counts(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_returnflag").alias("k"))
    x = t(spark, d, "orders").join(g, "o_orderkey", "left")
    return x.groupBy(E.tier(F.coalesce("k", F.lit(0))).alias("tier"), F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("n"))


@query("class_accuracy", HEADS + ", x AS (SELECT o_orderpriority AS label, p1 = p2 AS e, p1 = p2 OR p1 = p3 AS o, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE o_orderstatus END AS kind FROM g JOIN orders ON o_orderkey = l_orderkey) SELECT label, count(*) AS n, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN o THEN 1.0 ELSE 0.0 END), 6) AS overlap, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS kind FROM x GROUP BY label HAVING count(*) >= 5")
def class_accuracy(spark, d):
    kind = F.when(F.col("o_orderpriority").like("1%"), "urgent").otherwise(F.col("o_orderstatus"))
    x = heads(spark, d).join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("label"), kind.alias("kind")), "l_orderkey")
    out = M.class_accuracy(x, "label", F.col("p1") == F.col("p2"), (F.col("p1") == F.col("p2")) | (F.col("p1") == F.col("p3")), "kind")
    return out.select("label", "n", F.round("exact", 6).alias("exact"), F.round("overlap", 6).alias("overlap"), "kind")


@query("similarity_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def similarity_summary(spark, d):
    return M.summary(t(spark, d, "events"), "event_type", "value", {"median": 0.5, "p75": 0.75, "p90": 0.9})


@query("available_parts", "WITH m AS (SELECT l_partkey, max(l_extendedprice) AS top FROM lineitem WHERE l_linenumber > 4 GROUP BY 1), x AS (SELECT max(top) AS top FROM m) SELECT p_partkey, round((coalesce(m.top / x.top, 0.0) + CASE WHEN p_size % 4 > 0 THEN p_size / 50.0::DOUBLE ELSE 0 END) / CASE WHEN p_size % 4 > 0 THEN 2 ELSE 1 END, 6) AS score FROM part LEFT JOIN m ON l_partkey = p_partkey, x")
def available_parts(spark, d):
    """A strength scaled by the largest of all, 0 where there is none, and the mean of it and of another part where that is known."""
    m = t(spark, d, "lineitem").filter("l_linenumber > 4").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("top"))
    largest = m.agg(F.max("top").alias("largest"))
    x = t(spark, d, "part").select("p_partkey", "p_size").join(m, "p_partkey", "left").join(F.broadcast(largest))  # one row
    score = M.mean_of_available(F.coalesce(F.col("top") / F.col("largest"), F.lit(0.0)), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50.0))
    return x.select("p_partkey", F.round(score, 6).alias("score"))


@query("top_with_other", "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS rn FROM c) SELECT CASE WHEN rn <= 3 THEN p_type ELSE 'other' END AS p_type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def top_with_other(spark, d):
    return M.top_with_other(t(spark, d, "part"), "p_type", 3)


@query("novelty_class", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND (p_brand IN ('Brand#11', 'Brand#12') OR p_type = 'ECONOMY') THEN 'novel_base' WHEN p_partkey % 3 = 0 THEN 'novel_subfamily' WHEN p_partkey % 3 = 1 THEN 'control' END AS class FROM part")
def novelty_class(spark, d):
    from ..functions.annotation import novelty_class as classify

    kind = F.when(F.col("p_partkey") % 3 == 0, "novel_family").when(F.col("p_partkey") % 3 == 1, "novel_seq").otherwise("other")
    return t(spark, d, "part").select("p_partkey", classify(kind, F.array("p_brand", "p_type"), ["Brand#11", "Brand#12", "ECONOMY"]).alias("class"))


FOUR = "WITH a AS (SELECT l_orderkey AS id, max(l_extendedprice) AS bits FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT user_id AS id, count(*) AS hits FROM events GROUP BY 1), c AS (SELECT doc_id AS id, max(quality) AS quality FROM labels GROUP BY 1), e AS (SELECT p_partkey AS id, min(p_brand) AS family FROM part GROUP BY 1)"


@query("four_evidence_tables", FOUR + " SELECT o_orderkey AS id, round(coalesce(bits, 0.0), 2) AS bits, coalesce(hits, 0) AS hits, coalesce(quality, -1) AS quality, coalesce(family, '-') AS family, CAST((bits IS NOT NULL)::INT + (hits IS NOT NULL)::INT + (a2.id IS NOT NULL)::INT + (family IS NOT NULL)::INT AS INTEGER) AS n_tools FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN b ON b.id = o_orderkey LEFT JOIN c a2 ON a2.id = o_orderkey LEFT JOIN e ON e.id = o_orderkey")
def four_evidence_tables(spark, d):
    """Four tables of their own, joined to every item."""
    of = lambda name, k, c: t(spark, d, name).groupBy(F.col(k).alias("id")).agg(c)
    tables = {
        "a": t(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.max("l_extendedprice"), 2).alias("bits")),
        "b": of("events", "user_id", F.count("*").alias("hits")),
        "c": of("labels", "doc_id", F.max("quality").alias("quality")),
        "e": of("part", "p_partkey", F.min("p_brand").alias("family")),
    }
    return J.with_evidence(t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", tables, {"bits": 0.0, "hits": 0, "quality": -1, "family": "-"})


@query("partitioned_fetch", "SELECT source, doc_id, length(text) AS n FROM documents WHERE source IN ('src1', 'src7') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def partitioned_fetch(spark, d):
    """A table in folders by source, of which only the wanted folders are read."""
    path = scratch(spark, "partitioned")
    t(spark, d, "documents").write.partitionBy("source").parquet(path)
    docs = spark.read.parquet(path)
    wanted = t(spark, d, "documents").filter("source in ('src1', 'src7')").select("source", "doc_id").join(t(spark, d, "labels").filter("quality = 0"), "doc_id", "left_semi").select("source", "doc_id")
    return J.fetch(docs, wanted, "source", "doc_id").select("source", "doc_id", F.char_length("text").cast("long").alias("n"))


@query("gene_clusters", """WITH m AS (SELECT l_orderkey AS k, l_partkey AS g, CASE l_returnflag WHEN 'A' THEN 'CAZyme' WHEN 'N' THEN 'TC' ELSE '' END AS ty, CASE WHEN l_linenumber % 3 = 0 THEN 'c' || l_suppkey ELSE '' END AS contig, l_suppkey AS s, l_suppkey + 5 AS e, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS pos FROM lineitem),
x AS (SELECT m.*, CASE WHEN p_size % 2 = 0 THEN 'g' || p_size END AS gc, p_size AS gs, p_size + 100 AS ge FROM m LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 > 0) ON p_partkey = g),
ty AS (SELECT k, coalesce(nullif(ty, ''), 'null') AS ty, count(*) AS n, min(pos) AS pos FROM m GROUP BY 1, 2), c AS (SELECT k, string_agg(ty || '×' || n, ', ' ORDER BY pos) AS composition FROM ty GROUP BY k)
SELECT x.k AS cluster_key, coalesce(arg_min(contig, pos) FILTER (contig <> ''), arg_min(gc, pos) FILTER (gc IS NOT NULL), '?') AS contig, least(min(s), min(gs)) AS start, greatest(max(e), max(ge)) AS "end", any_value(composition) AS composition, count(*) AS n_genes, any_value(o_orderpriority) AS substrate FROM x JOIN c ON c.k = x.k LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON o_orderkey = x.k GROUP BY x.k""")
def gene_clusters(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "CAZyme").when(F.col("l_returnflag") == "N", "TC").otherwise("")
    contig = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).otherwise("")
    members = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("cluster_key"), F.col("l_partkey").alias("gene_key"), kind.alias("gene_type"), contig.alias("contig"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + 5).alias("end"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("pos"))
    genes = t(spark, d, "part").filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("gene_key"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("g"), F.col("p_size").cast("string"))).alias("contig"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 100).cast("long").alias("end"))
    substrates = t(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("cluster_key"), F.col("o_orderpriority").alias("substrate"), F.lit(1.0).alias("score"))
    return J.build_clusters(members, genes, substrates).drop("score")
