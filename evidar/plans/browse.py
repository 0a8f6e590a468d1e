"""The read layer: versions, facets, search, joins, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotation as A
from ..operators import intervals as I
from ..operators import relational as R
from ..tables import table as t
from .registry import query

LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"


def latest_orders(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(t(spark, d, "orders").filter("o_custkey is not null"), "o_custkey", "o_orderdate", "o_orderkey")


@query("latest_version", f"SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day FROM ({LATEST})")
def latest_version(spark, d):
    return latest_orders(spark, d).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("order_day"))


@query("facet_distinct_topk", f"SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM ({LATEST}) o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 40")
def facet_distinct_topk(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(latest_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return R.facet(lines.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "p_brand", F.count_distinct("l_orderkey"), 40)


@query("facet_nonnull", "SELECT event_type, count(*) AS n FROM events WHERE value > 0 AND event_type IS NOT NULL GROUP BY event_type")
def facet_nonnull(spark, d):
    return R.facet(t(spark, d, "events").filter("value > 0"), "event_type", F.count("*"))


@query("facet_all_top", "SELECT p_type, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def facet_all_top(spark, d):
    return R.facet(t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "p_type", F.count_distinct("l_suppkey"), 10)


HEADLINE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("headline_stats", "SELECT " + ", ".join(f"(SELECT count(*) FROM {x}) AS n_{x}" for x in HEADLINE))
def headline_stats(spark, d):
    counts = [t(spark, d, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("k"), "n") for x in HEADLINE]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out.agg(*[F.max(F.when(F.col("k") == x, F.col("n"))).alias(f"n_{x}") for x in HEADLINE])


@query("group_rollup", "WITH s AS (SELECT n_name, c_mktsegment, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), top AS (SELECT n_name, c_mktsegment AS top_segment FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY c DESC, c_mktsegment) AS rn FROM s) WHERE rn = 1), c AS (SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name) SELECT n_name, n_customers, n_orders, top_segment FROM c JOIN top USING (n_name)")
def group_rollup(spark, d):
    nation, cust = t(spark, d, "nation"), t(spark, d, "customer")
    named = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    per = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"))
    counts = named.join(per, "c_custkey", "left").groupBy("n_name").agg(F.count_distinct("c_custkey").alias("n_customers"), F.sum(F.coalesce("o", F.lit(0))).alias("n_orders"))
    segs = named.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("c"))
    return counts.join(R.first_by(segs, ["n_name"], F.desc("c"), F.asc("c_mktsegment")).select("n_name", F.col("c_mktsegment").alias("top_segment")), "n_name")


@query("matrix_pivot", "SELECT p_type, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY p_type")
def matrix_pivot(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.matrix(j, "p_type", "o_orderstatus", ["F", "O", "P"])


@query("search_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%wid%' OR p_brand ILIKE '%wid%' ORDER BY p_name, p_partkey LIMIT 50 OFFSET 50")
def search_like(spark, d):
    return R.search(t(spark, d, "part"), ["p_name", "p_brand"], "wid", ["p_name", "p_partkey"], page=2).select("p_partkey", "p_name")


@query("search_wildcard_semantics", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand ILIKE '%BRAND_1%' GROUP BY p_brand")
def search_wildcard_semantics(spark, d):
    return t(spark, d, "part").filter(F.col("p_brand").ilike("%BRAND_1%")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("typed_union_hits", " UNION ALL ".join(f"(SELECT '{k}' AS kind, CAST({i} AS BIGINT) AS id, {n} AS label FROM {k} WHERE {n} ILIKE '%1%' OR {n} ILIKE '%A%' ORDER BY {i} LIMIT 10)" for k, i, n in (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("region", "r_regionkey", "r_name"))))
def typed_union_hits(spark, d):
    out = None
    for kind, i, n in (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("region", "r_regionkey", "r_name")):
        hits = t(spark, d, kind).filter(F.col(n).ilike("%1%") | F.col(n).ilike("%A%")).orderBy(i).limit(10).select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), F.col(n).alias("label"))
        out = hits if out is None else out.unionByName(hits)
    return out


@query("set_ops", "WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def set_ops(spark, d):
    a = t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k"))
    b = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    named = lambda op, x: x.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("intersect", a.intersect(b))).union(named("except", a.subtract(b)))


@query("semi_anti", "SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders FROM customer GROUP BY c_mktsegment")
def semi_anti(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    both = c.join(o, on, "left_semi").select("c_mktsegment", F.lit(1).alias("w")).union(c.join(o, on, "left_anti").select("c_mktsegment", F.lit(0)))
    return both.groupBy("c_mktsegment").agg(F.sum("w").cast("long").alias("with_orders"), F.sum(1 - F.col("w")).cast("long").alias("without_orders"))


@query("left_join_unmatched", "SELECT count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS unmatched FROM (SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS m FROM orders)")
def left_join_unmatched(spark, d):
    return R.unmatched(t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


SPANS = "WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + (event_id % 7) * 3600000000 AS b FROM events), f AS (SELECT user_id, min(event_id) AS focal_id FROM events GROUP BY user_id), g AS (SELECT f.user_id, f.focal_id, s.a AS fa, s.b AS fb FROM f JOIN s ON s.event_id = f.focal_id)"


@query("neighbourhood", SPANS + ", n AS (SELECT g.focal_id, s.event_id, row_number() OVER (PARTITION BY g.focal_id ORDER BY s.a, s.event_id) AS place FROM s JOIN g ON g.user_id = s.user_id WHERE s.b >= g.fa - 43200000000 AND s.a <= g.fb + 43200000000) SELECT focal_id, event_id, CAST(place AS INTEGER) AS place FROM n WHERE place <= 60")
def neighbourhood(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = t(spark, d, "events").select("event_id", "user_id", at.alias("a"), (at + (F.col("event_id") % 7) * 3600000000).alias("b"))
    focal = e.groupBy("user_id").agg(F.min(F.struct("event_id", "a", "b")).alias("f")).select("user_id", F.col("f.event_id").alias("focal_id"), F.col("f.a").alias("focal_start"), F.col("f.b").alias("focal_end"))
    return R.neighbourhood(e, focal, ["user_id"], "a", "b", "event_id", 43200000000, 60).select("focal_id", "event_id", "place")


@query("interval_pairs_binned", "WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders) SELECT a.o_custkey, count(*) AS n_pairs FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.s + 30 AND b.s <= a.s + 30 GROUP BY a.o_custkey")
def interval_pairs_binned(spark, d):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("s")).withColumn("e", F.col("s") + 30)
    return I.overlapping_pairs(o, "o_custkey", "o_orderkey", "s", "e").groupBy("o_custkey").agg(F.count("*").alias("n_pairs"))


@query("cluster_aggregate", "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT l_orderkey, string_agg(l_returnflag || ' x ' || n, ', ' ORDER BY l_returnflag) AS composition FROM c GROUP BY l_orderkey), m AS (SELECT l_orderkey, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day, count(*) AS n_members FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, first_day, last_day, n_members, composition FROM m JOIN s USING (l_orderkey)")
def cluster_aggregate(spark, d):
    per = t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "n"))), lambda x: F.concat(x["l_returnflag"], F.lit(" x "), x["n"].cast("string")))
    day = lambda c: c.cast("date").cast("string")
    return per.groupBy("l_orderkey").agg(day(F.min("a")).alias("first_day"), day(F.max("b")).alias("last_day"), F.sum("n").alias("n_members"), F.array_join(parts, ", ").alias("composition"))


@query("propagate_attribute", "SELECT r_name, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def propagate_attribute(spark, d):
    where = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_quantity").join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("label_dialects", "SELECT p_brand, nullif(upper(regexp_extract(p_brand, '^([A-Za-z]+[0-9]*)', 1)), '') AS ingest_family, nullif(regexp_extract(replace(p_brand, '#', ''), '^([A-Za-z]+[0-9]+)', 1), '') AS view_family, count(*) AS n FROM part GROUP BY ALL")
def label_dialects(spark, d):
    g = t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return g.select("p_brand", A.ingest_family(F.col("p_brand")).alias("ingest_family"), A.view_family(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("view_family"), "n")


@query("coalesce_fallback", "SELECT p_partkey, coalesce(nullif(split_part(CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE p_name END, ' ', 1), '-'), nullif(CASE WHEN p_partkey % 2 = 0 THEN 'NA' ELSE p_brand END, 'NA'), 'UNKNOWN') AS family FROM part")
def coalesce_fallback(spark, d):
    a = A.cleaned(F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.col("p_name")), "overview")
    b = A.cleaned(F.when(F.col("p_partkey") % 2 == 0, "NA").otherwise(F.col("p_brand")), "overview")
    return t(spark, d, "part").select("p_partkey", F.coalesce(F.get(F.split(a, " "), F.lit(0)), b, F.lit("UNKNOWN")).alias("family"))


@query("json_attributes", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.absent')) AS n_absent FROM events GROUP BY event_type")
def json_attributes(spark, d):
    v = t(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("v", "$.k", "long")).alias("k"), F.count(F.try_variant_get("v", "$.absent", "string")).alias("n_absent"))


@query("url_parse", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no FROM pages")
def url_parse(spark, d):
    part = lambda *x: F.try_parse_url("url", *map(F.lit, x))
    return t(spark, d, "pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("QUERY", "page").alias("page_no"))


@query("turn_sequence", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n_turns, CAST(count(*) FILTER (role <> prev) AS BIGINT) AS n_changes FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id")
def turn_sequence(spark, d):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    g = t(spark, d, "conversations").groupBy("conv_id").agg(roles.alias("r"))
    changes = F.size(F.filter(F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r")), lambda a, b: a != b), lambda x: x))
    return g.select("conv_id", F.array_join("r", ">").alias("roles"), F.size("r").cast("long").alias("n_turns"), changes.cast("long").alias("n_changes"))


@query("sample_rollup", "WITH j AS (SELECT c_nationkey AS k, l_orderkey, l_returnflag, l_quantity, p_type FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey), f AS (SELECT k, p_type, count(DISTINCT l_orderkey) AS n FROM j GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, p_type) AS rn FROM f) SELECT n_name, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_orderkey) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_quantity > 45) AS n_large, (SELECT string_agg(p_type || '=' || n, ',' ORDER BY rn) FROM r WHERE r.k = j.k AND rn <= 12) AS families FROM j JOIN nation ON n_nationkey = k GROUP BY n_name, j.k")
def sample_rollup(spark, d):
    """Counts of each sample, here a nation, and its twelve most frequent families."""
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    j = j.select(F.col("c_nationkey").alias("k"), "l_orderkey", "l_returnflag", "l_quantity", "p_type")
    counts = j.groupBy("k").agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("n_returned"), F.count(F.when(F.col("l_quantity") > 45, 1)).alias("n_large"))
    top = R.first_by(j.groupBy("k", "p_type").agg(F.count_distinct("l_orderkey").alias("n")), ["k"], F.desc("n"), F.asc("p_type"), n=12, rank="rn")
    named = top.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p_type", "n"))), lambda x: F.concat_ws("=", x["p_type"], x["n"])), ",").alias("families"))
    return counts.join(named, "k").join(t(spark, d, "nation"), F.col("k") == F.col("n_nationkey")).select("n_name", "n_rows", "n_orders", "n_returned", "n_large", "families")
