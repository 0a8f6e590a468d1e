"""Minimax contiguous partition of ordered atomic groups into shards.

Documents are ordered by (digest of the text, doc_id), so equal texts stand
together and form one atomic group.  The smallest shard capacity for which a
greedy left-to-right filling needs at most ``n_shards`` shards is found by
binary search, and the order is cut where that filling cuts it.

The order, its running sums and the group ends are Spark tables.  The search
sees the group ends only through histograms of a fixed number of blocks: with
the ends of a block known as an interval, a capacity is surely feasible, surely
infeasible or open.  Blocks that leave capacities open are split again, until
few enough ends remain to be looked at one by one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Workspace, table

N_SHARDS = 16
BLOCKS = 8192
EXACT = 50_000


class Ends:
    """What is known of the sorted group ends: disjoint intervals [first end, last end, number of ends]."""

    def __init__(self, blocks: list[tuple[int, int, int]]):
        self.blocks = sorted(blocks)
        self.firsts = [b[0] for b in self.blocks]

    def last_until(self, p: int) -> tuple[int, int]:
        """Bounds of the largest end that is at most p (0 if there is none)."""
        i = bisect_right(self.firsts, p) - 1
        if i < 0:
            return 0, 0
        first, last, n = self.blocks[i]
        return (last, last) if p >= last else (first, first) if n <= 2 else (first, p)

    def cuts(self, capacity: int, n: int, high: bool) -> list[int]:
        """Ends of n shards that are filled greedily, as near (or, high, as far) as they may lie."""
        at, out = 0, []
        for _ in range(n):
            at = max(at, self.last_until(at + capacity)[high])
            out.append(at)
        return out


def minimax_cuts(ends: DataFrame, total: int, n: int = N_SHARDS, blocks: int = BLOCKS, exact: int = EXACT) -> list[int]:
    """The ends of the n shards of the smallest feasible capacity over a table of group ends (column ``end``)."""
    if not total:
        return [0] * n
    spans, known = [(1, total)], []
    while True:
        width = max(1, -(-sum(b - a + 1 for a, b in spans) // blocks))
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | F.col("end").between(a, b)
        # The spans' edges are block edges too, so that what lies outside them stays as it is known.
        part = F.lit(0)
        for i, (a, b) in enumerate(spans):
            part = F.when(F.col("end").between(a, b), i).otherwise(part)
        cells = ends.filter(inside).groupBy(part.alias("part"), F.floor(F.col("end") / width).alias("cell"))
        known = [k for k in known if not any(a <= k[0] and k[1] <= b for a, b in spans)]
        known += [tuple(r) for r in cells.agg(F.min("end"), F.max("end"), F.count("*")).select(F.col("min(end)"), F.col("max(end)"), F.col("count(1)")).collect()]
        seen = Ends(known)
        low, high = 0, total  # low is surely infeasible, high surely feasible
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if seen.cuts(m, n, False)[-1] >= total else (m, b)
        high = b
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if seen.cuts(m, n, True)[-1] < total else (a, m)
        low = a
        if high - low == 1 and seen.cuts(high, n, False) == seen.cuts(high, n, True):
            return seen.cuts(high, n, False)
        near, far = seen.cuts(low, n, False), seen.cuts(high, n, True)
        spans = []  # at most one for each cut: the blocks from the nearest to the farthest place it may have
        for lo, hi in zip(near, far, strict=True):
            own = [k for k in known if k[2] > 2 and k[0] <= hi and k[1] >= lo]
            if own:
                a, b = min(k[0] for k in own), max(k[1] for k in own)
                while spans and spans[-1][1] >= a - 1:
                    first, last = spans.pop()
                    a, b = min(a, first), max(b, last)
                spans.append((a, b))
        if sum(k[2] for k in known if any(a <= k[0] and k[1] <= b for a, b in spans)) <= exact:
            blocks = 1 << 62


def assign(docs: DataFrame, ws: Workspace, n_shards: int = N_SHARDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, or all) with size, text_crc32, shard and slot.

    A null text has size 1 and stands with the empty texts.  Repeated rows and
    rows without an id keep a slot each.  A group larger than its share fills a
    shard of its own; groups are never cut.  Columns of ``docs`` that bear the
    names of the four new ones are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [c for c in (docs.columns if keep is None else keep) if c not in {"size", "text_crc32", "shard", "slot"}]
    # Repeated rows are told apart, so a large group of them spreads over partitions.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_group"), F.monotonically_increasing_id().alias("_copy"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(parts, "_group", "doc_id", "_copy").sortWithinPartitions("_group", "doc_id", "_copy").drop("_copy", "doc_id").withColumn("_part", F.spark_partition_id())
    schema = StructType([*dealt.schema.fields, StructField("_row", LongType()), StructField("_bytes", LongType())])
    placed = ws.save(dealt.mapInArrow(running, schema), "placed")
    before, rows, size = {}, 0, 0
    for r in placed.groupBy("_part").agg(F.max("_row").alias("rows"), F.max("_bytes").alias("size")).orderBy("_part").collect():  # a row for each partition
        before[r["_part"]] = (rows, size)
        rows, size = rows + r["rows"], size + r["size"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame([(k, *v) for k, v in before.items()], "_part int, _row0 long, _bytes0 long"))
    placed = placed.join(offsets, "_part").select("_group", "_own", "size", "text_crc32", (F.col("_row") + F.col("_row0")).alias("_row"), (F.col("_bytes") + F.col("_bytes0")).alias("_bytes"))
    ends = ws.save(placed.groupBy("_group").agg(F.max("_bytes").alias("end")).select("end"), "ends")
    cuts = minimax_cuts(ends, size, n_shards)
    shard = sum((F.when(F.col("_bytes") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("_row").alias("first")).collect()}
    start = F.lit(0).cast("long")
    for k, v in first.items():
        start = F.when(F.col("shard") == k, F.lit(v).cast("long")).otherwise(start)
    return placed.select("_own.*", "size", "text_crc32", "shard", (F.col("_row") - start).alias("slot"))


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a sorted partition and sums their sizes."""
    rows = total = 0
    for b in batches:
        sizes = b.column("size").to_numpy()
        own = [np.arange(rows + 1, rows + 1 + len(sizes)), total + np.cumsum(sizes)]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own)], names=[*b.schema.names, "_row", "_bytes"])
        rows, total = rows + len(sizes), total + int(sizes.sum())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = assign(docs, Workspace(spark, "op4"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns and size, text_crc32, shard and slot."""
    return assign(docs, Workspace(spark, "stage4"))
