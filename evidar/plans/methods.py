"""Calls named, flagged and read by the dimension of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import methods as M
from ..operators import evidence as E
from ..sources import readers, sinks
from ..tables import scratch
from ..tables import table as t
from .registry import query

#: A tool for each line number; one is not registered, one is missing.
TOOLS = ["HMMER", "DIAMOND", "ESM-C-kNN", "fusion", "another", "SaProt"]
CASES = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(TOOLS, 1))
TOOL = f"CASE l_linenumber {CASES} END"
DIM = "d(key, display, family, kind, signal, colour, place) AS (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in m[:7]) + ")" for m in M.METHODS) + ")"


def calls(spark, d):
    return M.with_methods(t(spark, d, "lineitem").withColumn("tool", F.expr(TOOL)), "tool", M.registry(spark))


@query("method_dimension", f"WITH {DIM}, x AS (SELECT {TOOL} AS tool FROM lineitem) SELECT coalesce(display, tool, '—') AS method_display, coalesce(family, 'unknown') AS method_family, kind AS method_kind, signal AS method_signal, coalesce(colour, '#64748b') AS method_colour, CAST(coalesce(place, 999) AS INTEGER) AS method_place, coalesce(family = 'advanced', false) AS is_advanced, count(*) AS n FROM x LEFT JOIN d ON key = tool GROUP BY ALL")
def method_dimension(spark, d):
    return calls(spark, d).groupBy("method_display", "method_family", "method_kind", "method_signal", "method_colour", "method_place", "is_advanced").agg(F.count("*").alias("n"))


@query("advanced_by_method", f"WITH {DIM}, j AS (SELECT l_orderkey, {TOOL} AS tool, p_type ILIKE '%0' AS ph FROM lineitem JOIN part ON p_partkey = l_partkey), x AS (SELECT l_orderkey, tool, ph, coalesce(family = 'advanced', false) AS adv FROM j LEFT JOIN d ON key = tool), g AS (SELECT l_orderkey, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (NOT adv), '') AS baseline_tools, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (adv), '') AS advanced_tools, count(DISTINCT tool) FILTER (adv) AS n_adv, bool_or(NOT adv) AS base, coalesce(bool_or(adv AND tool = 'fusion'), false) AS fusion, bool_or(ph) AS ph FROM x GROUP BY ALL) SELECT l_orderkey, baseline_tools, advanced_tools, n_adv, NOT base AND NOT ph AND (fusion OR n_adv >= 2) AS advanced_only FROM g")
def advanced_by_method(spark, d):
    """Baseline against advanced methods, told apart by the dimension."""
    j = calls(spark, d).join(t(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return E.compare_methods(j, ["l_orderkey"], "tool", F.col("is_advanced"), F.coalesce(F.col("tool") == "fusion", F.lit(False)), F.col("p_type").ilike("%0"))


@query("method_predictions", """WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand || '; ' || p_type WHEN 1 THEN p_brand WHEN 2 THEN '-' ELSE ' , ' || p_type || ',' END AS f, p_size FROM part WHERE p_partkey % 7 > 0)
SELECT 'p' || k AS protein_id, CASE k % 4 WHEN 0 THEN split_part(f, '; ', 1) WHEN 1 THEN f WHEN 3 THEN trim(f, ' ,') END AS family, p_size / 50.0::DOUBLE AS confidence, CASE k % 4 WHEN 0 THEN replace(f, '; ', ',') WHEN 3 THEN trim(f, ' ,') END AS all_families,
'{"knn_purity":' || (p_size + 0.5) || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ',"knn_margin":' || k ELSE ',"knn_margin":{"a": [' || k || ']}' END || '}' AS extra, 'ESM-C-kNN' AS tool FROM x""")
def method_predictions(spark, d):
    """A raw table of a method, read by its row in the dimension."""
    k = F.col("p_partkey")
    several = F.when(k % 4 == 0, F.concat("p_brand", F.lit("; "), "p_type")).when(k % 4 == 1, F.col("p_brand")).when(k % 4 == 2, F.lit("-")).otherwise(F.concat(F.lit(" , "), "p_type", F.lit(",")))
    margin = F.when(k % 3 == 0, F.lit("-")).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit('{"a": ['), k.cast("string"), F.lit("]}")))
    raw = t(spark, d, "part").select(F.when(k % 7 > 0, F.concat(F.lit("p"), k.cast("string"))).otherwise("-").alias("query_id"), several.alias("knn_pred"), (F.col("p_size") / 50).alias("knn_conf"), (F.col("p_size") + 0.5).alias("knn_purity"), margin.alias("knn_margin"), F.lit("x").alias("unread"))
    path = scratch(spark, "method")
    sinks.write_csv(raw, path, sep="\t")
    return readers.method_predictions(spark, path, "ESM-C-kNN", M.registry(spark)).select("protein_id", "family", "confidence", "all_families", "extra", "tool")
