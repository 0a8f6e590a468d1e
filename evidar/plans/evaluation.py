"""Text tables, evaluation metrics, folds, sampling, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..operators import intervals as folded
from ..operators import metrics, models, search
from ..operators import relational as R
from ..streaming import counters, ingest
from ..tables import scratch
from ..tables import table as t
from .registry import query

EVAL = "WITH e AS (SELECT l.doc_id, l.quality = 1 AS y, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS s FROM labels l JOIN documents d USING (doc_id))"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: y says good quality, s is a score from the length."""
    docs = t(spark, d, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("s"))
    return t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("y")).join(docs, "doc_id")


@query("md5_dedupe", "SELECT doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def md5_dedupe(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


TRAIN = "CAST(substr(source, 4) AS INTEGER) < 10"


@query("leakage_guard", f"SELECT doc_id FROM documents WHERE {TRAIN} AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE NOT ({TRAIN}))")
def leakage_guard(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("k"), (F.substring("source", 4, 9).cast("int") < 10).alias("train"))
    return docs.filter("train").join(docs.filter("not train"), "k", "left_anti").select("doc_id")


@query("contamination", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark, d):
    return search.containing(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id")


@query("novelty_bucket", f"WITH k AS (SELECT md5(text) AS h, lang || source AS f, {TRAIN} AS train, doc_id FROM documents), f AS (SELECT DISTINCT lang AS f FROM documents WHERE {TRAIN} AND lang <> 'es') SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN md5(text) IN (SELECT h FROM k WHERE train) THEN 'carried_over' WHEN lang NOT IN (SELECT f FROM f) THEN 'novel_family' ELSE 'novel_seq' END AS bucket FROM documents WHERE NOT ({TRAIN})) GROUP BY bucket")
def novelty_bucket(spark, d):
    docs = t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"), "lang", (F.substring("source", 4, 9).cast("int") < 10).alias("train"))
    old = docs.filter("train").select("h", F.lit(1).alias("seen")).distinct()
    known = docs.filter("train and lang <> 'es'").select("lang", F.lit(1).alias("known")).distinct()
    j = docs.filter("not train").join(old, "h", "left").join(known, "lang", "left")
    bucket = F.when(F.col("seen") == 1, "carried_over").when(F.col("known").isNull(), "novel_family").otherwise("novel_seq")
    return j.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("set_metrics", "WITH a AS (SELECT o_orderkey AS id, list_sort(list(DISTINCT l_returnflag)) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_returnflag)) AS q FROM lineitem GROUP BY 1), x AS (SELECT b.id, coalesce(p, []) AS p, q FROM b LEFT JOIN a USING (id)), y AS (SELECT *, len(list_intersect(p, q)) AS i FROM x) SELECT count(*) AS n, round(avg(CASE WHEN p = q THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN i > 0 THEN 1.0 ELSE 0.0 END), 6) AS overlap, round(avg(i / (len(p) + len(q) - i)), 6) AS jaccard FROM y")
def set_metrics(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    sets = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag")))).alias("p"), F.array_sort(F.collect_set("l_returnflag")).alias("q"))
    i = F.size(F.array_intersect("p", "q"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return sets.agg(F.count("*").alias("n"), share(F.col("p") == F.col("q")).alias("exact"), share(i > 0).alias("overlap"), F.round(F.avg(i / F.size(F.array_union("p", "q"))), 6).alias("jaccard"))


@query("auroc_ties", EVAL + ", r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM e) SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r")
def auroc_ties(spark, d):
    return metrics.auroc(scored(spark, d), "s", F.col("y")).select(F.round("auroc", 6).alias("auroc"))


@query("average_precision", EVAL + ", g AS (SELECT s, count(*) FILTER (y) AS p, count(*) AS k FROM e GROUP BY s), c AS (SELECT p, sum(p) OVER w AS tp, sum(k) OVER w AS k FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(p * tp / k) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d), "s", F.col("y")).select(F.round("average_precision", 6).alias("average_precision"))


@query("precision_recall_curve", EVAL + ", g AS (SELECT s, count(*) FILTER (y) AS p, count(*) AS k FROM e GROUP BY s), c AS (SELECT s, sum(p) OVER w AS tp, sum(k) OVER w AS k, sum(p) OVER () AS n FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(s, 6) AS threshold, round(tp / k, 6) AS precision, round(tp / n, 6) AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0")
def precision_recall_curve(spark, d):
    return metrics.precision_recall_curve(scored(spark, d), "s", F.col("y")).select(*[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall")])


POINTS = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]


@query("operating_points", EVAL + ", h AS (SELECT unnest(CAST([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9] AS DOUBLE[])) AS threshold), m AS (SELECT threshold, count(*) FILTER (s >= threshold AND y) AS tp, count(*) FILTER (s >= threshold AND NOT y) AS fp, count(*) FILTER (s < threshold AND y) AS fn FROM e, h GROUP BY threshold) SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM m")
def operating_points(spark, d):
    return metrics.operating_points(scored(spark, d), "s", F.col("y"), POINTS)


@query("purity_sweep", EVAL + ", h AS (SELECT CAST(unnest(range(1, 201)) AS DOUBLE) / 200 AS t), m AS (SELECT t, avg(CASE WHEN y THEN 0.0 ELSE 1.0 END) AS p FROM e JOIN h ON s < t GROUP BY t) SELECT coalesce(max(t) FILTER (p >= 0.2), 0.1) AS threshold FROM m")
def purity_sweep(spark, d):
    return metrics.purity_threshold(scored(spark, d), "s", F.col("y"), [i / 200 for i in range(1, 201)], 0.2, 0.1)


@query("conformal_quantile", EVAL + ", c AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM e), a AS (SELECT unnest(CAST([0.05, 0.1, 0.2, 0.3] AS DOUBLE[])) AS alpha) SELECT alpha, round(s, 6) AS quantile FROM c, a WHERE i - 1 = ceil(round(least(ceil((n + 1) * (1 - alpha)) / n, 1.0) * (n - 1), 9))")
def conformal_quantile(spark, d):
    return metrics.conformal_quantile(scored(spark, d), "s", [0.05, 0.1, 0.2, 0.3]).withColumn("quantile", F.round("quantile", 6))


@query("percentile_rank_strict", "SELECT p_brand, round(100 * avg(CASE WHEN s_acctbal < price THEN 1.0 ELSE 0.0 END), 6) AS percentile FROM (SELECT p_brand, avg(p_retailprice) AS price FROM part GROUP BY p_brand), supplier GROUP BY p_brand")
def percentile_rank_strict(spark, d):
    """Where each of a few values stands in a distribution: one aggregation of the distribution, a column for each value."""
    price = t(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"))
    few = price.agg(F.array_sort(F.collect_list(F.struct("p_brand", "price"))).alias("v"))  # a row for each brand
    below = t(spark, d, "supplier").join(F.broadcast(few)).select("s_acctbal", F.explode("v").alias("x"))
    return below.groupBy(F.col("x.p_brand").alias("p_brand")).agg(F.round(100 * F.avg(F.when(F.col("s_acctbal") < F.col("x.price"), 1.0).otherwise(0.0)), 6).alias("percentile"))


@query("reliability_ece", EVAL + ", b AS (SELECT CAST(greatest(ceil(round(s * 10, 9)), 1) AS INTEGER) AS bin, s, y FROM e), g AS (SELECT bin, count(*) AS n, avg(s) AS c, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS a FROM b GROUP BY bin) SELECT bin, n, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy, round(n / sum(n) OVER () * abs(c - a), 6) AS ece_part FROM g")
def reliability_ece(spark, d):
    return metrics.reliability(scored(spark, d), "s", F.col("y"))


@query("confusion_other", "WITH x AS (SELECT source AS t, 'src' || (doc_id % 20) AS p FROM documents), k AS (SELECT t FROM x GROUP BY t HAVING count(*) >= 50) SELECT CASE WHEN t IN (SELECT t FROM k) THEN t ELSE 'other' END AS truth, CASE WHEN p IN (SELECT t FROM k) THEN p ELSE 'other' END AS predicted, count(*) AS n FROM x GROUP BY 1, 2")
def confusion_other(spark, d):
    x = t(spark, d, "documents").select("source", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("p"))
    return metrics.confusion(x, "source", "p", 50)


def intervals(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), F.col("value"))
    return e.withColumn("end", F.col("start") + 3600 * 6 + (F.col("event_id") % 7) * 3600).withColumn("worst", -F.col("value"))


# In order of the rows of a user: what was kept so far, and the ends of the lanes so far, go with the recursion.
IN_ORDER = "WITH RECURSIVE e AS (SELECT user_id, event_id, value, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS s FROM events), i AS (SELECT user_id, event_id, s, s + 21600 + (event_id % 7) * 3600 AS e, row_number() OVER (PARTITION BY user_id ORDER BY {order}, event_id) AS n FROM e), "


@query("overlap_resolve", IN_ORDER.format(order="-value") + """f AS (SELECT user_id, 0::BIGINT AS n, []::STRUCT(i BIGINT, s BIGINT, e BIGINT)[] AS k FROM (SELECT DISTINCT user_id FROM i)
  UNION ALL SELECT f.user_id, i.n, CASE WHEN len(list_filter(f.k, lambda x: least(x.e, i.e) - greatest(x.s, i.s) + 1 > 0.5 * least(x.e - x.s + 1, i.e - i.s + 1))) = 0 THEN list_append(f.k, {'i': i.event_id, 's': i.s, 'e': i.e}) ELSE f.k END FROM f JOIN i ON i.user_id = f.user_id AND i.n = f.n + 1),
z AS (SELECT user_id, unnest(arg_max(k, n)) AS x FROM f GROUP BY user_id) SELECT user_id, x.i AS event_id, x.s AS start, x.e AS "end" FROM z""")
def overlap_resolve(spark, d):
    return folded.resolve_overlaps(intervals(spark, d), "user_id", "event_id", "start", "end", "worst")


@query("lane_pack", IN_ORDER.format(order="s") + """f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS l, []::BIGINT[] AS ends FROM (SELECT DISTINCT user_id FROM i)
  UNION ALL SELECT user_id, n, event_id, l, CASE WHEN l <= len(ends) THEN list_concat(ends[1:l - 1], [e], ends[l + 1:]) ELSE list_append(ends, e) END FROM (SELECT f.user_id, i.n, i.event_id, i.e, f.ends, coalesce(list_position(list_transform(f.ends, lambda x: i.s > x + 8), true), len(f.ends) + 1) AS l FROM f JOIN i ON i.user_id = f.user_id AND i.n = f.n + 1))
SELECT user_id, event_id, CAST(l - 1 AS INTEGER) AS lane FROM f WHERE n > 0""")
def lane_pack(spark, d):
    return folded.pack_lanes(intervals(spark, d), "user_id", "event_id", "start", "end")


@query("stratified_sample", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|13'), doc_id) AS rn FROM documents) WHERE rn <= 40")
def stratified_sample(spark, d):
    return folds.stratified_sample(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 40, "13").select("lang", "doc_id")


@query("quota_sample", "WITH x AS (SELECT lang, doc_id, md5(doc_id || '|7') AS h FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS i FROM x), o AS (SELECT *, i > CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 30 WHEN 'fr' THEN 20 ELSE 0 END AS over FROM n) SELECT lang, doc_id FROM o ORDER BY over, h, doc_id LIMIT 100")
def quota_sample(spark, d):
    return folds.quota_sample(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", {"en": 0.5, "de": 0.3, "fr": 0.2}, 100, "7")


@query("tumbling_windows_extension", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows_extension(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.tumbling_counts(e).select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n")


@query("family_counts_min_anchor", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type HAVING count(*) >= 100")
def family_counts_min_anchor(spark, d):
    return R.facet(t(spark, d, "part"), "p_type", F.count("*")).filter("n >= 100")


COUNTED = "SELECT event_type AS class, count(*) AS n, array_to_string((array_agg(CAST(event_id AS VARCHAR) ORDER BY md5(event_id || '|0'), event_id))[1:5], ' ') AS sample FROM events GROUP BY event_type"


@query("class_counters", COUNTED)
def class_counters(spark, d):
    """Events of each type and five of them, drawn in one pass."""
    return counters.counters(t(spark, d, "events"), "event_type", "event_id", 5).withColumn("sample", F.array_join("sample", " "))


@query("class_counters_stream", COUNTED)
def class_counters_stream(spark, d):
    """The same with state over a folder that gets files twice."""
    root, events = scratch(spark, "counters"), t(spark, d, "events").select("event_id", "event_type")
    for value in (0, 1):
        events.filter(F.col("event_id") % 2 == value).write.mode("append").parquet(f"{root}/in")  # the deliveries, which make up the whole table
        out = counters.count_stream(spark, f"{root}/in", "event_id long, event_type string", root, "event_type", "event_id", 5)
    return out.withColumn("sample", F.array_join("sample", " "))


@query("stream_idempotent", "SELECT l_returnflag || l_linestatus AS batch, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity, 1 AS n_versions FROM lineitem GROUP BY ALL")
def stream_idempotent(spark, d):
    """A folder of files taken as a stream; some are delivered twice, and the stream is started twice."""
    root = scratch(spark, "stream")
    li = t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").withColumn("batch", F.concat("l_returnflag", "l_linestatus"))
    schema = "l_returnflag string, l_linestatus string, l_quantity double, batch string"
    name = lambda path: F.regexp_extract(path, "k=([A-Z]+)/", 1)
    # A source is one file here, so each part is written as one.
    for turn, part in enumerate((li, li.filter("l_returnflag = 'R'"))):
        part.withColumn("k", F.col("batch")).repartition("k").sortWithinPartitions("l_quantity").write.partitionBy("k").option("maxRecordsPerFile", 0).parquet(f"{root}/in/{turn}")
        ingest.ingest_stream(spark, f"{root}/in", schema, f"{root}/wh", name)
    ingest.ingest_stream(spark, f"{root}/in", schema, f"{root}/wh", name)
    n = ingest.versions(spark, f"{root}/wh").groupBy("batch").agg(F.count_distinct("release").cast("int").alias("n_versions"))
    return ingest.current(spark, f"{root}/wh").groupBy("batch").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).join(n, "batch")


@query("logistic_gate")
def logistic_gate(spark, d):
    """Scores of a gate that tells the even classes of vectors from the odd ones; tested by its optimum."""
    e = t(spark, d, "embeddings").withColumn("y", F.col("label") % 2)
    return models.gate_scores(models.gate(e, "embedding", "y"), e, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("logistic_novelty")
def logistic_novelty(spark, d):
    """Cross-fitted scores of documents by two signals against their quality label."""
    x = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select("doc_id", "quality", F.log1p("n_chars").alias("a"), F.size(F.split("text", "\n")).alias("b"))
    return models.novelty_scores(x, "doc_id", ["a", "b"], "quality").withColumn("score", F.round("score", 6))
