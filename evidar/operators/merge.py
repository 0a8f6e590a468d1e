"""Joins that bring tables of evidence together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_by


def identity_map(left: DataFrame, right: DataFrame, digest: str, a: str, b: str) -> DataFrame:
    """(digest, n_left, n_right) of the digests on both sides: a many-to-many match that is not spelled out as pairs."""
    x = left.groupBy(digest).agg(F.count_distinct(a).alias("n_left"))
    return x.join(right.groupBy(digest).agg(F.count_distinct(b).alias("n_right")), digest)


def prioritized(items: DataFrame, by_id: DataFrame, by_digest: DataFrame, id_: str, digest: str, value: str) -> DataFrame:
    """``items`` with the value found by id, or else by digest, and which of the two it was; both tables have a row for each key."""
    x = items.join(by_id.select(id_, F.col(value).alias("_a")), id_, "left").join(by_digest.select(digest, F.col(value).alias("_b")), digest, "left")
    return x.withColumn(value, F.coalesce("_a", "_b")).withColumn("matched_by", F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "digest")).drop("_a", "_b")


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """``left`` with columns of ``right``; where there is no row, or no value, the default."""
    out = left.join(right.select(key, *[F.col(c).alias(f"_{c}") for c in defaults]), key, "left")
    return out.select(*left.columns, *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()])


def within_cluster(edges: DataFrame, labels: DataFrame, a: str, b: str, id_: str, label: str, noise: object = -1) -> DataFrame:
    """``edges`` between two different members of one cluster, with its label; noise is no cluster."""
    named = labels.filter(F.col(label) != noise)
    x = edges.filter(F.col(a) != F.col(b)).join(named.select(F.col(id_).alias(a), F.col(label).alias("_a")), a)
    return x.join(named.select(F.col(id_).alias(b), F.col(label).alias("_b")), b).filter("_a = _b").withColumnRenamed("_a", label).drop("_b")


def pair_identity(edges: DataFrame, labels: DataFrame, label: str, value: str, noise: object = -1) -> DataFrame:
    """(label, n, n_pairs, mean, median) of every cluster; 0 where it has no pair."""
    sizes = labels.filter(F.col(label) != noise).groupBy(label).agg(F.count("*").alias("n"))
    stats = edges.groupBy(label).agg(F.count("*").alias("n_pairs"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"))
    return sizes.join(stats, label, "left").select(label, "n", F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("median", F.lit(0.0)).alias("median"))


def family_of_best(hits: DataFrame, labels: DataFrame, query: str, target: str, family: str, *order: Column) -> DataFrame:
    """(query, target, family) of each query's best target; a target that has no label gives a null family."""
    best = first_by(hits, [query], *order)
    return best.join(labels.select(target, family), target, "left").select(query, target, family)


def fetch(rows: DataFrame, wanted: DataFrame, partition: str, id_: str) -> DataFrame:
    """The rows of the wanted (partition, id); only the partitions that are asked for are read.

    ``rows`` is partitioned by folders of ``partition``, so where Spark
    broadcasts the wanted rows it takes the folders to read from them, at run
    time; nothing is collected.
    """
    return rows.join(wanted.select(partition, id_).distinct(), [partition, id_], "left_semi")


def with_evidence(items: DataFrame, key: str, tables: dict[str, DataFrame], defaults: dict[str, object]) -> DataFrame:
    """``items`` with the columns of every table of evidence, which has a row for each key or none, and n_tools, how many tables know the item.

    A column that ``defaults`` names gets that value where nothing is known.
    All sides are joined on one key, so items are shuffled by it once.
    """
    out, flags = items, []
    for name, df in tables.items():
        out = out.join(df.withColumn(f"_{name}", F.lit(1)), key, "left")
        flags.append(F.coalesce(f"_{name}", F.lit(0)))
    out = out.withColumn("n_tools", sum(flags, F.lit(0)).cast("int")).drop(*[f"_{n}" for n in tables])
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def build_clusters(members: DataFrame, genes: DataFrame, substrates: DataFrame) -> DataFrame:
    """(cluster_key, contig, start, end, composition, n_genes, substrate, score) of gene clusters.

    ``members`` is (cluster_key, gene_key, gene_type, contig, start, end, pos),
    a row for each gene in the order of ``pos``; ``genes`` is (gene_key, contig,
    start, end); ``substrates`` is (cluster_key, substrate, score).  A cluster
    spans the coordinates of its members and of their genes, 0 without any; its
    contig is the first that a member names, else the first of a gene, else
    "?"; its composition counts the types in the order in which they first
    appear, as "type×n".  Types are counted before clusters are gathered, so a
    cluster of any number of genes is a row for each type.
    """
    g = genes.select("gene_key", F.nullif("contig", F.lit("")).alias("_contig"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.lit(True).alias("_known"))
    x = members.join(g, "gene_key", "left").withColumn("gene_type", F.coalesce(F.nullif("gene_type", F.lit("")), F.lit("null")))
    named = lambda c: F.min(F.when(c.isNotNull(), F.struct("pos", c.alias("contig"))))
    per = x.groupBy("cluster_key", "gene_type").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.least(F.min("start"), F.min("_start")).alias("start"), F.greatest(F.max("end"), F.max("_end")).alias("end"), named(F.nullif("contig", F.lit(""))).alias("own"), named(F.col("_contig")).alias("gene"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene_type", "n"))), lambda t: F.concat(t["gene_type"], F.lit("×"), t["n"].cast("string")))
    out = per.groupBy("cluster_key").agg(F.coalesce(F.min("own")["contig"], F.min("gene")["contig"], F.lit("?")).alias("contig"), F.coalesce(F.min("start"), F.lit(0)).alias("start"), F.coalesce(F.max("end"), F.lit(0)).alias("end"), F.array_join(kinds, ", ").alias("composition"), F.sum("n").alias("n_genes"))
    return out.join(substrates.select("cluster_key", "substrate", "score"), "cluster_key", "left")


def lookup_with_base(items: DataFrame, reference: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """``items`` with ``columns`` of the family's own entry, or of its base family's; null and not mapped where there is neither."""
    base = F.when(F.col(family).contains("_"), F.substring_index(F.col(family), "_", 1))
    entry = lambda tag: reference.select(F.col(family).alias(f"_{tag}"), F.struct(*columns).alias(f"_{tag}_v"))
    out = items.withColumn("_base", base).join(entry("x"), F.trim(F.col(family)) == F.col("_x"), "left").join(entry("y"), F.col("_base") == F.col("_y"), "left")
    found = F.coalesce("_x_v", "_y_v")
    return out.select(*items.columns, *[found[c].alias(c) for c in columns], found.isNotNull().alias("mapped"))
