"""Deterministic sampling and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_by


def draw(id_: str, seed: str) -> Column:
    """A place in a reproducible random order."""
    return F.md5(F.concat_ws("|", F.col(id_).cast("string"), F.lit(seed)))


def stratified_sample(df: DataFrame, stratum: str, id_: str, n: int, seed: str, cap: int | None = None) -> DataFrame:
    """The n rows of each stratum that stand first in the random order, and the first ``cap`` of those overall.

    It stands for reservoir sampling: each row has the same chance, and the
    result does not depend on the partitioning.
    """
    out = first_by(df.withColumn("_draw", draw(id_, seed)), [stratum], F.asc("_draw"), F.asc(id_), n=n)
    return (out.orderBy("_draw", id_).limit(cap) if cap else out).drop("_draw")


def quota_sample(df: DataFrame, stratum: str, id_: str, shares: dict[str, float], total: int, seed: str) -> DataFrame:
    """About ``total`` rows by shares of the strata; what a stratum lacks is filled up from the others in the random order."""
    drawn = df.withColumn("_draw", draw(id_, seed)).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_draw", id_)))
    quota = F.lit(0)
    for k, v in shares.items():
        quota = F.when(F.col(stratum) == k, F.bround(F.lit(total * v)).cast("int")).otherwise(quota)
    return drawn.withColumn("_over", F.col("_n") > quota).orderBy("_over", "_draw", id_).limit(total).drop("_draw", "_n", "_over")


def first_occurrences(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row of each key: the first in input order."""
    return first_by(df.withColumn("_key", key), ["_key"], *[F.asc(c) for c in order]).drop("_key")


def shuffled_letters(sequence: Column, seed: str = "0") -> Column:
    """A decoy with the letters of a sequence in another order, the same for the same seed: letters by a hash of seed, place and letter."""
    letters = F.filter(F.split(sequence, ""), lambda x: x != "")
    drawn = F.transform(letters, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), i, sequence)).alias("k"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(drawn), lambda p: p["x"]), "")


def first_per_class(df: DataFrame, class_: str, order: str, limit: int) -> DataFrame:
    """The first row of each class in order, and the first ``limit`` classes."""
    return first_by(df, [class_], F.asc(order)).orderBy(class_).limit(limit)
