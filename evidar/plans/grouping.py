"""Groups of rows that are alike: density clusters and representatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, redundancy
from ..operators import merge as J
from ..tables import table as t
from .evidence import near, vectors
from .registry import query


def density(spark, d):
    """The clusters and the neighbours that they are made of, each searched or computed once."""
    neighbours = near(spark, d, 10)
    return neighbours, clusters.density_clusters(neighbours, vectors(spark, d), "vec_id", smallest=5, samples=3, levels=8).withColumnRenamed("id", "vec_id")


@query("density_clusters")
def density_clusters(spark, d):
    return density(spark, d)[1].select("vec_id", "label")


@query("density_cluster_identity")
def density_cluster_identity(spark, d):
    """Similarities of neighbours within the same density cluster; noise is no cluster."""
    neighbours, labels = density(spark, d)
    labels = labels.select("vec_id", F.coalesce("label", F.lit(-1)).alias("label"))
    edges = J.within_cluster(neighbours.select("q", "r", "sim"), labels, "q", "r", "vec_id", "label")
    return J.pair_identity(edges, labels, "label", "sim").select("label", "n", "n_pairs", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("redundancy_reduction")
def redundancy_reduction(spark, d):
    """Turns of conversations, whole texts, with the longest that stands for each."""
    turns = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return redundancy.reduce_redundancy(turns, "id", "text", identity=0.9, coverage=0.9, k=12)
