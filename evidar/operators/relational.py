"""Search, facets, matrices, neighbourhoods: the read layer over versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join

def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in a total order; ``rank`` names a column for the place."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The newest version of each key."""
    return first_by(df, [key], *[F.col(v).desc() for v in version])


def facet(df: DataFrame, key: str, count: Column, limit: int | None = None) -> DataFrame:
    """(key, n), the most frequent first and ties by key."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(count.cast("long").alias("n")).orderBy(F.desc("n"), F.asc(key))
    return out.limit(limit) if limit else out


def search(df: DataFrame, columns: list[str], text: str, order: list[str], page: int = 1, size: int = 50) -> DataFrame:
    """A page of the rows that have the text in one of the columns; ``%`` and ``_`` are wildcards, case does not count."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{text}%")
    return df.filter(hit).orderBy(*order).offset(size * (page - 1)).limit(size)


def matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row x column with zeros, and their total; ``values`` are the columns."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)
    return wide.withColumn("total", sum((F.col(v) for v in values), F.lit(0)).cast("long"))


def neighbourhood(df: DataFrame, focal: DataFrame, keys: list[str], start: str, end: str, id_: str, flank: float, limit: int) -> DataFrame:
    """Rows of the focal row's keys that overlap its interval widened by ``flank``, at most ``limit`` for each focal row, the lowest first.

    ``focal`` has the keys, ``focal_id``, ``focal_start`` and ``focal_end``;
    starts and ends are whole numbers.  Rows and focal rows meet in a hierarchy
    of bins, so many focal rows on one contig do not make all its pairs.
    """
    rows = df.withColumn("s", F.col(start)).withColumn("e", F.col(end))
    asked = focal.withColumn("s", (F.col("focal_start") - flank).cast("long")).withColumn("e", (F.col("focal_end") + flank).cast("long"))
    near = overlap_join(rows, asked, keys).select(*[F.col(f"a.{c}").alias(c) for c in df.columns], *[F.col(f"b.{c}").alias(c) for c in focal.columns if c not in keys])
    return first_by(near, ["focal_id"], F.asc(start), F.asc(id_), n=limit, rank="place")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``left`` meet a row of ``right``, and how many meet none."""
    flag = left.join(right.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return flag.agg(F.count("_hit").alias("matched"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("long").alias("unmatched"))


def sort_key(allowed: dict[str, list[Column]], key: str) -> list[Column]:
    """The order that an allow-list has for a key; for any other key its first one."""
    return allowed.get(key) or next(iter(allowed.values()))


def extents(df: DataFrame, key: str, end: str) -> DataFrame:
    """(key, n, region_start, region_end) of each key: from 1 to the last end on it."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.lit(1).alias("region_start"), F.max(end).alias("region_end"))
