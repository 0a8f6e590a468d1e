"""Pages, ordered children, report blocks, scalar functions: the rest of the read layer."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import annotation as A
from ..operators import folds
from ..operators import relational as R
from ..operators import report as P
from ..tables import table as t
from .evidence import HEADS, heads
from .registry import query


@query("ordered_children", "SELECT o_orderkey, o_orderpriority, count(l_partkey) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%' GROUP BY ALL")
def ordered_children(spark, d):
    parents = t(spark, d, "orders").filter("o_orderpriority like '1%'").select("o_orderkey", "o_orderpriority")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    out = P.with_children(parents, lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "c")
    return out.select("o_orderkey", "o_orderpriority", F.size("c").cast("long").alias("n_lines"), F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",").alias("lines"))


@query("keyed_fetch", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def keyed_fetch(spark, d):
    return t(spark, d, "orders").filter("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("page_clamp", "SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS pages, CAST(least(1000000, greatest(ceil(count(*) / 50.0), 1)) AS BIGINT) AS page FROM part WHERE p_size > 25")
def page_clamp(spark, d):
    return P.page_of(t(spark, d, "part").filter("p_size > 25"), 1_000_000)


@query("filtered_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) FILTER (l_linestatus = 'F') >= 2 AND count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 40) = 0) ORDER BY p_name, p_partkey LIMIT 50 OFFSET 50")
def filtered_page(spark, d):
    """A page of what a computed predicate leaves: the predicate is part of the plan, so no number of rows is fetched to be cut."""
    li = t(spark, d, "lineitem")
    g = li.groupBy("l_partkey").agg(F.count_distinct(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag"))).alias("n"), F.count(F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40), 1)).alias("bad"))
    kept = t(spark, d, "part").join(g.filter("n >= 2 and bad = 0"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return kept.orderBy("p_name", "p_partkey").offset(50).limit(50).select("p_partkey", "p_name")


@query("distinct_limit", "SELECT DISTINCT p_type FROM part WHERE p_type ILIKE '%s%' ORDER BY p_type LIMIT 10")
def distinct_limit(spark, d):
    return t(spark, d, "part").filter(F.col("p_type").ilike("%s%")).select("p_type").distinct().orderBy("p_type").limit(10)


@query("child_filter", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower(o_orderpriority) = lower('1-urgent') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority ILIKE '1-URGENT')")
def child_filter(spark, d):
    """Parents with a matching child, and of their children those that match, whatever the case."""
    wanted = F.lower("o_orderpriority") == F.lower(F.lit("1-urgent"))
    o = t(spark, d, "orders").filter(wanted)
    return t(spark, d, "customer").select("c_custkey").join(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey")


@query("exact_filters", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus ILIKE 'f' GROUP BY o_orderstatus")
def exact_filters(spark, d):
    return t(spark, d, "orders").filter((F.col("o_orderpriority") == "2-HIGH") & F.col("o_orderstatus").ilike("f")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("sort_keys", "(SELECT 'size' AS key, p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 20) UNION ALL (SELECT 'unknown', p_partkey FROM part ORDER BY p_name, p_partkey LIMIT 20)")
def sort_keys(spark, d):
    """A key that is not on the list falls back to the first one."""
    allowed = {"name": [F.asc("p_name")], "size": [F.desc("p_size")], "price": [F.desc("p_retailprice")]}
    part = t(spark, d, "part")
    top = lambda k: part.orderBy(*R.sort_key(allowed, k), "p_partkey").limit(20).select(F.lit(k).alias("key"), "p_partkey")
    return top("size").union(top("unknown"))


@query("contig_extent", "SELECT user_id, count(*) AS n, 1 AS region_start, max(event_id + 10) AS region_end FROM events GROUP BY user_id")
def contig_extent(spark, d):
    return R.extents(t(spark, d, "events").withColumn("end", F.col("event_id") + 10), "user_id", "end")


@query("provenance_rows", "SELECT e.event_id, e.event_type FROM events e WHERE e.user_id = 3 ORDER BY ts, event_id")
def provenance_rows(spark, d):
    """Rows whose entity is the item's sample, whatever their type, in order."""
    return t(spark, d, "events").filter("user_id = 3").orderBy("ts", "event_id").select("event_id", "event_type")


REVIEW = HEADS + ", n AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_domains, min(l_returnflag) FILTER (l_quantity > 40) AS baseline FROM lineitem GROUP BY l_orderkey), c AS (SELECT l_orderkey, p1, p2, CASE WHEN b >= 0.5 THEN p3 END AS p3, p1 AS family, round((a + b + c) / 3, 9) AS conf, 2 + CAST(p2 = p1 AS INTEGER) + CAST(p3 = p1 AS INTEGER) AS agreement, n_domains, baseline FROM g JOIN n USING (l_orderkey)), v AS (SELECT *, list_filter([p1, p2, p3], lambda x: x IS NOT NULL) AS h FROM c), w AS (SELECT *, list_sort(list_distinct(h)) AS u FROM v), x AS (SELECT *, list_max(list_transform(u, lambda k: len(list_filter(h, lambda y: y = k)))) AS n_majority FROM w), y AS (SELECT *, list_filter(u, lambda k: len(list_filter(h, lambda z: z = k)) = n_majority)[1] AS majority FROM x), r AS (SELECT *, list_filter([CASE WHEN conf < 0.35 THEN 'abstains' END, CASE WHEN len(h) >= 3 AND len(u) = len(h) THEN 'heads_all_differ' END, CASE WHEN agreement <= 2 THEN 'low_agreement' END, CASE WHEN n_majority >= 2 AND family <> majority THEN 'against_majority' END], lambda x: x IS NOT NULL) AS strong, list_filter([CASE WHEN len(u) > 1 THEN 'not_unanimous' END, CASE WHEN conf < 0.9 THEN 'below_high_confidence' END, CASE WHEN n_domains > 1 THEN 'several_domains' END, CASE WHEN baseline <> family THEN 'baseline_disagrees' END], lambda x: x IS NOT NULL) AS weak FROM y)"


def calls(spark: SparkSession, d: str):
    h = heads(spark, d)
    li = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("n_domains"), F.min(F.when(F.col("l_quantity") > 40, F.col("l_returnflag"))).alias("baseline"))
    agree = 2 + (F.col("p2") == F.col("p1")).cast("int") + (F.col("p3") == F.col("p1")).cast("int")
    return h.withColumn("agreement", agree).withColumn("conf", F.round((F.col("a") + F.col("b") + F.col("c")) / 3, 9)).withColumn("p3", F.when(F.col("b") >= 0.5, F.col("p3"))).join(li, "l_orderkey")


@query("review_verdict", REVIEW + " SELECT l_orderkey, CASE WHEN len(strong) > 0 THEN 'review' WHEN len(weak) > 0 THEN 'attention' ELSE 'clean' END AS level, majority, CAST(n_majority AS INTEGER) AS n_majority, array_to_string(list_concat(strong, weak), ',') AS reasons FROM r")
def review_verdict(spark, d):
    v = P.review([F.col("p1"), F.col("p2"), F.col("p3")], F.col("p1"), F.col("conf"), F.col("agreement"), F.col("n_domains"), F.col("baseline"))
    return calls(spark, d).select("l_orderkey", v.alias("v")).select("l_orderkey", "v.level", "v.majority", "v.n_majority", F.array_join("v.reasons", ",").alias("reasons"))


@query("fusion_self_vote", HEADS + " SELECT l_orderkey, p1 AS family, CAST(CAST(p2 = p1 AS INTEGER) + CAST(p3 = p1 AS INTEGER) + CASE WHEN l_orderkey % 2 = 0 THEN CAST(p3 = p1 AS INTEGER) ELSE 1 END AS INTEGER) AS agreement FROM g")
def fusion_self_vote(spark, d):
    """Two heads vote, and in even orders the call's own vote is there already, with the third head's family."""
    two = F.create_map(F.lit("x"), F.col("p2"), F.lit("y"), F.col("p3"))
    votes = F.when(F.col("l_orderkey") % 2 == 0, F.map_concat(two, F.create_map(F.lit("fusion"), F.col("p3")))).otherwise(two)
    return heads(spark, d).select("l_orderkey", F.col("p1").alias("family"), P.self_vote(votes, F.col("p1"))["agreement"].alias("agreement"))


@query("stale_value", "SELECT p_partkey, CASE WHEN abs(m.price - p_retailprice) > 0.05 THEN m.price ELSE p_retailprice END AS value, coalesce(abs(m.price - p_retailprice) > 0.05, false) AS stale FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) / 16 AS price FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) m ON l_partkey = p_partkey")
def stale_value(spark, d):
    m = t(spark, d, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.max("l_extendedprice") / 16).alias("price"))
    x = t(spark, d, "part").select("p_partkey", "p_retailprice").join(m, "p_partkey", "left")
    return x.select("p_partkey", P.corrected(F.col("p_retailprice"), F.col("price")).alias("x")).select("p_partkey", "x.value", "x.stale")


@query("evidence_report", REVIEW + " SELECT r.l_orderkey, o_orderpriority AS priority, coalesce(c_name, '-') AS customer, len(strong) + len(weak) AS n_reasons, n_lines, best_part FROM r LEFT JOIN orders ON o_orderkey = r.l_orderkey LEFT JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, count(*) AS n_lines, arg_max(l_partkey, (l_extendedprice, -l_partkey)) AS best_part FROM lineitem GROUP BY 1) n USING (l_orderkey)")
def evidence_report(spark, d):
    """Blocks of an item joined from its tables, nested as in the report file (``sinks.json_rows`` writes them), here unfolded."""
    v = P.review([F.col("p1"), F.col("p2"), F.col("p3")], F.col("p1"), F.col("conf"), F.col("agreement"), F.col("n_domains"), F.col("baseline"))
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.max(F.struct("l_extendedprice", (-F.col("l_partkey")).alias("p"))).alias("best"))
    who = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "c_name")
    report = F.struct(F.struct("o_orderpriority", "c_name").alias("identity"), v.alias("review"), F.struct("n_lines", (-F.col("best.p")).alias("best_part")).alias("lines"))
    out = calls(spark, d).join(lines, "l_orderkey").join(who, "l_orderkey", "left").select("l_orderkey", report.alias("r"))
    return out.select("l_orderkey", F.col("r.identity.o_orderpriority").alias("priority"), F.coalesce("r.identity.c_name", F.lit("-")).alias("customer"), F.size("r.review.reasons").cast("long").alias("n_reasons"), "r.lines.n_lines", "r.lines.best_part")


@query("decoy_texts", "WITH x AS (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part) SELECT p_partkey, string_agg(c, '' ORDER BY md5('11|' || i || '|' || p_name), c) AS decoy FROM x GROUP BY p_partkey")
def decoy_texts(spark, d):
    """The decoys themselves: letters in the order of a hash of seed, place and sequence."""
    return t(spark, d, "part").select("p_partkey", folds.shuffled_letters(F.col("p_name"), "11").alias("decoy"))


LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'GH5_4' WHEN 1 THEN 'cbm48' WHEN 2 THEN 'SLH' WHEN 3 THEN 'PF00150' WHEN 4 THEN ' GT2 ' END"


@query("label_links", f"WITH x AS (SELECT p_partkey, {LABEL} AS f, CASE p_partkey % 4 WHEN 0 THEN '3.2.1.' || p_size WHEN 1 THEN '3.2.1.-' WHEN 2 THEN 'GO:' || p_partkey ELSE 'ARO:' || p_size END AS a FROM part) SELECT p_partkey, CASE WHEN regexp_matches(lower(trim(f)), '^(gh|gt|pl|ce|aa|cbm|slh|cohesin|dockerin)') THEN 'http://www.cazy.org/' || trim(f) || '.html' END AS family_link, CASE WHEN regexp_matches(a, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN 'https://enzyme.expasy.org/EC/' || a END AS ec_link, CASE WHEN a LIKE 'GO:%' THEN 'https://www.ebi.ac.uk/QuickGO/term/' || a END AS go_link, CASE WHEN a LIKE 'ARO:%' THEN 'https://card.mcmaster.ca/ontology/' || substr(a, 5) END AS resistance_link FROM x")
def label_links(spark, d):
    a = F.expr("case p_partkey % 4 when 0 then concat('3.2.1.', p_size) when 1 then '3.2.1.-' when 2 then concat('GO:', p_partkey) else concat('ARO:', p_size) end")
    x = t(spark, d, "part").select("p_partkey", F.expr(LABEL).alias("f"), a.alias("a"))
    return x.select("p_partkey", A.family_link(F.col("f")).alias("family_link"), A.ec_link(F.col("a")).alias("ec_link"), A.go_link(F.col("a")).alias("go_link"), A.resistance_link(F.col("a")).alias("resistance_link"))


@query("location_label", "SELECT o_orderkey, o_orderpriority || ':' || format('{:,}', o_custkey) || '-' || format('{:,}', o_custkey + o_orderkey) || ' (' || coalesce(nullif(o_orderstatus, 'P'), '.') || ')' AS label FROM orders")
def location_label(spark, d):
    return t(spark, d, "orders").select("o_orderkey", A.location(F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey"), F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("label"))


@query("ec_agreement_levels", "WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'EC:' || (1 + p_partkey % 3) || '.2.1.' || p_size END AS a, (1 + p_partkey % 2) || '.2.' || (p_partkey % 2) || '.' || (p_size + p_partkey % 2) AS b FROM part), y AS (SELECT *, string_split(replace(a, 'EC:', ''), '.') AS x, string_split(b, '.') AS y FROM x) SELECT p_partkey, CASE WHEN a = '' THEN 'incomparable' WHEN x = y THEN 'exact' WHEN x[1:3] = y[1:3] THEN 'class3' WHEN x[1:2] = y[1:2] THEN 'class2' WHEN x[1:1] = y[1:1] THEN 'class1' ELSE 'different' END AS level FROM y")
def ec_agreement_levels(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    a = F.when(p % 7 == 0, "").otherwise(F.concat(F.lit("EC:"), (1 + p % 3).cast("string"), F.lit(".2.1."), s.cast("string")))
    b = F.concat((1 + p % 2).cast("string"), F.lit(".2."), (p % 2).cast("string"), F.lit("."), (s + p % 2).cast("string"))
    return t(spark, d, "part").select("p_partkey", A.ec_agreement(a, b).alias("level"))


@query("confidence_bands", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN NULL WHEN v >= 0.5 THEN 'HIGH' WHEN v >= 0.05 THEN 'LOW' ELSE 'VERY_LOW' END AS band FROM (SELECT value, round(value / 100, 6) AS v FROM events)) GROUP BY band")
def confidence_bands(spark, d):
    return t(spark, d, "events").groupBy(A.confidence_band(F.round(F.col("value") / 100, 6)).alias("band")).agg(F.count("*").alias("n"))


@query("scalar_cells", "WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '{\"k\": 1}' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '-' WHEN 3 THEN p_size || '.5' WHEN 4 THEN '[broken' ELSE p_name END AS c, CASE p_partkey % 3 WHEN 0 THEN 'domains' WHEN 1 THEN 'structure' ELSE p_type END AS f FROM part) SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'int' WHEN 2 THEN 'empty' WHEN 3 THEN 'float' ELSE 'text' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'structure' ELSE 'other' END AS feature, CASE WHEN p_partkey % 6 IN (1, 3) THEN CAST(trunc(CAST(c AS DOUBLE)) AS INTEGER) ELSE CAST(p_partkey % 6 AS INTEGER) END AS coordinate, replace(p_partkey || '|' || c, '|', '-') AS id, regexp_extract(p_partkey || '|' || c, '[^|]*$') AS field FROM x")
def scalar_cells(spark, d):
    p = F.col("p_partkey")
    cell = F.expr("case p_partkey % 6 when 0 then '{\"k\": 1}' when 1 then string(p_size) when 2 then '-' when 3 then concat(p_size, '.5') when 4 then '[broken' else p_name end")
    kind = F.when(p % 3 == 0, "domains").when(p % 3 == 1, "structure").otherwise(F.col("p_type"))
    x = t(spark, d, "part").select("p_partkey", cell.alias("c"), kind.alias("f"))
    name = F.concat_ws("|", "p_partkey", "c")
    return x.select("p_partkey", A.cell_kind(F.col("c")).alias("kind"), A.feature_type(F.col("f")).alias("feature"), A.first_whole(F.col("c"), (p % 6).cast("string")).alias("coordinate"), A.canonical_id(name).alias("id"), A.last_field(name).alias("field"))


@query("scalar_biology", "WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SP(Sec/SPI)' WHEN 1 THEN 'signal' WHEN 2 THEN 'OTHER' END AS p, CASE event_id % 3 WHEN 0 THEN 'signal:1-' || user_id || '|tm:30-50' WHEN 1 THEN 'signal:x-3' ELSE 'inside:1-9' END AS topo, value FROM events) SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'Extracellular' ELSE 'Intracellular' END AS localization, CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(topo, '^signal:1-([0-9]+)', 1) AS INTEGER) ELSE -1 END AS signal_end, least(greatest((round(value, 6) - 10) / 40, 0.0), 1.0) AS scaled, CASE WHEN event_id * 37 >= 1000 THEN round_even(event_id * 37 / 1000, 1) || ' kb' ELSE (event_id * 37) || ' bp' END AS size FROM x")
def scalar_biology(spark, d):
    e = F.col("event_id")
    p = F.when(e % 4 == 0, "SP(Sec/SPI)").when(e % 4 == 1, "signal").when(e % 4 == 2, "OTHER")
    topo = F.when(e % 3 == 0, F.concat(F.lit("signal:1-"), F.col("user_id").cast("string"), F.lit("|tm:30-50"))).when(e % 3 == 1, "signal:x-3").otherwise("inside:1-9")
    return t(spark, d, "events").select("event_id", A.localization_from_signal(p).alias("localization"), F.coalesce(A.signal_span(topo)["end"], F.lit(-1)).alias("signal_end"), A.scaled(F.round("value", 6), 10, 50).alias("scaled"), A.base_pairs(e * 37).alias("size"))


@query("feature_order", "SELECT p_brand, string_agg(p_partkey, ',' ORDER BY coalesce(nullif(p_size, 50), 0), p_partkey) FILTER (k = 'domain') AS domains, string_agg(p_partkey, ',' ORDER BY coalesce(nullif(p_size, 50), 0) DESC, p_partkey) FILTER (k = 'hit') AS hits FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'domain' ELSE 'hit' END AS k FROM part) GROUP BY p_brand")
def feature_order(spark, d):
    """Features of an item by type: domains by start, hits by falling score; a missing one counts as 0."""
    at = F.coalesce(F.nullif(F.col("p_size"), F.lit(50)), F.lit(0))
    x = t(spark, d, "part").select("p_brand", "p_partkey", at.alias("at"), (F.col("p_partkey") % 2 == 0).alias("domain"))
    listed = lambda flag, way: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct((F.col("at") * way).alias("o"), "p_partkey")))), lambda s: s["p_partkey"])
    return x.groupBy("p_brand").agg(F.nullif(F.array_join(listed(F.col("domain"), 1), ","), F.lit("")).alias("domains"), F.nullif(F.array_join(listed(~F.col("domain"), -1), ","), F.lit("")).alias("hits"))


@query("colour_order", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem WHERE l_returnflag <> 'A') SELECT l_orderkey, l_linenumber, l_partkey, CAST((i + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 8 AS INTEGER) AS colour FROM x")
def colour_order(spark, d):
    """Places on a palette of eight: a signal span (here orders divisible by three have one) takes the first place, spans without coordinates take none."""
    span = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    g = t(spark, d, "lineitem").filter("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span)).alias("s"))
    return g.select("l_orderkey", F.explode(F.transform("s", lambda x, i: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"), ((i + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)) % 8).cast("int").alias("colour")))).alias("x")).select("l_orderkey", "x.*")


@query("slice_choice", "WITH g AS (SELECT p_brand, p_size, count(*) AS n, avg(CASE WHEN p_partkey % 3 > 0 THEN 1.0 ELSE 0.0 END) AS share, count(*) FILTER (p_partkey % 3 = 0) AS k FROM part GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS rn FROM g WHERE n BETWEEN 2 AND 500 AND share > 0.5 AND k >= 1) SELECT p_brand, p_size, n, round(share, 6) AS share FROM c WHERE rn = 1 ORDER BY p_brand LIMIT 5")
def slice_choice(spark, d):
    g = t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.avg(F.when(F.col("p_partkey") % 3 > 0, 1.0).otherwise(0.0)).alias("share"), F.count(F.when(F.col("p_partkey") % 3 == 0, 1)).alias("k"))
    return folds.first_per_class(g.filter("n between 2 and 500 and share > 0.5 and k >= 1"), "p_brand", "p_size", 5).select("p_brand", "p_size", "n", F.round("share", 6).alias("share"))


@query("decoys", "SELECT p_partkey, array_to_string(list_sort(string_split(p_name, '')), '') AS letters, length(p_name) AS n FROM part")
def decoys(spark, d):
    """The decoy has the letters of its sequence, sorted here."""
    x = t(spark, d, "part").select("p_partkey", folds.shuffled_letters(F.col("p_name"), "11").alias("s"))
    return x.select("p_partkey", F.array_join(F.array_sort(F.filter(F.split("s", ""), lambda c: c != "")), "").alias("letters"), F.length("s").cast("long").alias("n"))
