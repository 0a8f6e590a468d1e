"""Readers over files that are written from the test tables, so that their SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..tables import scratch
from ..tables import table as t
from .registry import query


def written(spark: SparkSession, df: DataFrame, *parts: Column | str) -> str:
    """The path of text files with a line for each row."""
    path = scratch(spark, "files")
    df.select(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")).write.text(path)
    return path


@query("read_fasta", "SELECT 'd' || doc_id AS id, length(regexp_replace(text, '[\\x20\\x09-\\x0D>]', '', 'g')) AS n FROM documents WHERE length(regexp_replace(text, '[\\x20\\x09-\\x0D>]', '', 'g')) > 0")
def read_fasta(spark, d):
    """Texts written as wrapped sequences and read again."""
    path = scratch(spark, "fasta")
    docs = t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.regexp_replace("text", r"[\x20\x09-\x0D>]", "").alias("sequence"))
    sinks.write_fasta(docs, path)
    return readers.fasta(spark, path).select("id", F.char_length("sequence").cast("long").alias("n"))


@query("read_gff3", "SELECT 'L' || event_id AS gene_key, user_id * 10 AS start, user_id * 10 + event_id AS end, event_id + 1 AS length, CASE WHEN event_id % 3 = 0 THEN '+' WHEN event_id % 3 = 1 THEN '-' END AS strand, event_type || ' & ' || user_id AS product FROM events")
def read_gff3(spark, d):
    e = t(spark, d, "events")
    strand = F.when(F.col("event_id") % 3 == 0, "+").when(F.col("event_id") % 3 == 1, "-").otherwise("?")
    path = written(spark, e, "c", F.col("user_id"), "\tx\tCDS\t", F.col("user_id") * 10, "\t", F.col("user_id") * 10 + F.col("event_id"), "\t.\t", strand, "\t0\tID=g;locus_tag=L", F.col("event_id"), ";product=", F.col("event_type"), "%20%26%20", F.col("user_id"))
    return readers.gff3(spark, path).select("gene_key", F.col("start").cast("long"), F.col("end").cast("long"), F.col("length").cast("long"), "strand", "product")


def hit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines by part and line; ranges of them are a file each."""
    return t(spark, d, "lineitem").repartitionByRange("l_partkey", "l_linenumber").sortWithinPartitions("l_partkey", "l_linenumber")


@query("read_structure_hits", "SELECT protein_id, target, target_family, CAST(rank AS INTEGER) AS rank FROM (SELECT 'o' || l_orderkey AS protein_id, 'GH' || l_partkey || '_x' || l_linenumber AS target, 'GH' || l_partkey AS target_family, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def read_structure_hits(spark, d):
    """Ties go by the order of the files, here by part and line."""
    path = written(spark, hit_rows(spark, d), "o", F.col("l_orderkey"), "\tGH", F.col("l_partkey"), "_x", F.col("l_linenumber"), "\t0.5\t1\t1\t1\t1\t1\t1\t1\t1e-5\t", F.col("l_extendedprice"))
    return readers.structure_hits(spark, path, 3).select("protein_id", "target", "target_family", "rank")


@query("read_ranked_ec", "SELECT 'p' || p_partkey AS protein_id, e AS ec_number, round(c, 4) AS confidence, r AS rank FROM (SELECT p_partkey, '3.2.1.' || p_size AS e, p_size / 100.0::DOUBLE AS c, 1 AS r FROM part UNION ALL SELECT p_partkey, '1.1.-.-', 0.5, 2 FROM part WHERE p_partkey % 2 = 0)")
def read_ranked_ec(spark, d):
    second = F.when(F.col("p_partkey") % 2 == 0, ",broken,EC:1.1.-.-/0.5").otherwise("")
    path = written(spark, t(spark, d, "part"), "p", F.col("p_partkey"), ",EC:3.2.1.", F.col("p_size"), "/", F.col("p_size") / 100, second)
    return readers.ranked_ec(spark, path).select("protein_id", "ec_number", F.round("confidence", 4).alias("confidence"), "rank")


@query("read_predictions", "SELECT 'p' || p_partkey AS protein_id, p_brand AS family, p_size / 50.0::DOUBLE AS confidence, p_type AS kind FROM part WHERE p_partkey % 3 > 0")
def read_predictions(spark, d):
    part = t(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise("NaN").alias("call"), (F.col("p_size") / 50).alias("c"), F.col("p_type").alias("kind"))
    path = scratch(spark, "predictions")
    sinks.write_csv(part, path, sep="\t")
    return readers.predictions(spark, path, "name", "call", "c").select("protein_id", "family", "confidence", F.col("extra")["kind"].alias("kind"))


@query("read_features", "SELECT 'p' || p_partkey AS protein_id, p_name AS label, p_retailprice AS score, p_size AS start, p_size + 9 AS end, 'PF' || p_partkey AS acc, CAST(p_partkey AS VARCHAR) AS k FROM part")
def read_features(spark, d):
    p = F.col("p_partkey").cast("string")
    part = t(spark, d, "part").select(F.concat(F.lit("p"), p).alias("protein_id"), F.concat(F.lit("PF"), p).alias("acc"), F.col("p_name").alias("name"), F.col("p_size").alias("start"), (F.col("p_size") + 9).cast("double").alias("end"), F.col("p_retailprice").alias("score"), F.concat(F.lit('{"acc": "old", "k": '), p, F.lit("}")).alias("extra"))
    path = scratch(spark, "features")
    part.write.option("quote", '"').option("escape", '"').csv(path, sep="\t", header=True)
    out = readers.features(spark, path, "domain", "Pfam/hmmscan")
    return out.select("protein_id", "label", "score", "start", "end", F.col("attributes")["acc"].alias("acc"), F.col("attributes")["k"].alias("k"))


@query("read_wanted_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def read_wanted_rows(spark, d):
    """Compressed tables, of which only wanted rows are kept."""
    path = scratch(spark, "gz")
    t(spark, d, "orders").select(F.concat_ws("\t", "o_orderkey", "o_orderstatus").alias("value")).write.option("compression", "gzip").text(path)
    wanted = t(spark, d, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").cast("string").alias("k"))
    return readers.wanted_rows(spark, path, wanted, 0, 2).select("id", F.get("c", F.lit(1)).alias("status"))
