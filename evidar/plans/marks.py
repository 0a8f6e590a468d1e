"""Small operators on whole tables: capped samples, signatures of sources, first rows, padded and masked sequences, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotation as A
from ..operators import folds
from ..streaming import ingest
from ..tables import table as t
from .registry import query


@query("capped_sample", "WITH x AS (SELECT lang, doc_id, md5(doc_id || '|13') AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM x) SELECT lang, doc_id FROM r WHERE rn <= 40 ORDER BY h, doc_id LIMIT 60")
def capped_sample(spark, d):
    """At most 40 of each language, and 60 in all."""
    return folds.stratified_sample(t(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id", 40, "13", cap=60).select("lang", "doc_id")


@query("source_signature", "WITH x AS (SELECT CAST(s_nationkey AS VARCHAR) AS source, 'r' || s_suppkey || ':' || sha256(s_name) AS h FROM supplier) SELECT source, sha256(string_agg(h, '|' ORDER BY h)) AS checksum FROM x GROUP BY source")
def source_signature(spark, d):
    s = t(spark, d, "supplier")
    files = s.select(F.col("s_nationkey").cast("string").alias("source"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("role"), F.col("s_name").cast("binary").alias("content"))
    return ingest.signature(files)


@query("first_occurrences", "SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_occurrences(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"))
    return folds.first_occurrences(docs, F.col("text_key"), "doc_id").select("text_key", "doc_id")


@query("masked_letters", "WITH x AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) AS i FROM part) SELECT p_partkey, string_agg(CASE WHEN ((i * 7 + p_partkey) % 10) / 10.0 < 0.4 THEN '#' ELSE c END, '' ORDER BY i) AS masked FROM x GROUP BY p_partkey")
def masked_letters(spark, d):
    """Letters of low confidence become "#"; the confidence comes of place and key here."""
    confidence = F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: ((i * 7 + F.col("p_partkey")) % 10) / 10.0)
    return t(spark, d, "part").select("p_partkey", A.masked(F.col("p_name"), confidence, 0.4).alias("masked"))


@query("padded_domains", "WITH x AS (SELECT doc_id, text, doc_id % 50 + 1 AS s, doc_id % 50 + 1 + doc_id % 40 AS e FROM documents), y AS (SELECT *, greatest(s - 10, 1) AS a, least(e + 10, length(text)) AS b FROM x) SELECT doc_id, CASE WHEN b - a + 1 >= 20 THEN substr(text, a, b - a + 1) END AS part FROM y")
def padded_domains(spark, d):
    start = (F.col("doc_id") % 50 + 1).cast("int")
    end = (F.col("doc_id") % 50 + 1 + F.col("doc_id") % 40).cast("int")
    return t(spark, d, "documents").select("doc_id", A.padded(F.col("text"), start, end).alias("part"))


@query("interpro_links", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.ebi.ac.uk/interpro/entry/InterPro/IPR' || p_partkey || '/' END AS link FROM part")
def interpro_links(spark, d):
    k = F.col("p_partkey").cast("string")
    return t(spark, d, "part").select("p_partkey", A.interpro_link(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("IPR"), k)).otherwise(F.concat(F.lit("PF"), k))).alias("link"))
