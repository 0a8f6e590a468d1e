"""Intervals in a hierarchy of bins: each stands once, in the level whose width fits it.

An interval [s, e] of whole numbers, both ends included, has the level L with
2**(L-1) < length <= 2**L and stands in the bin s >> L of that level.  What
overlaps a given interval is then found in at most three bins of each level
that is as wide or wider, and in no more bins for a longer interval.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import scratch

#: Levels by which an interval must be smaller than another to be looked up in sums over bins instead of alone.
FAR = 3


def level(s: Column, e: Column) -> Column:
    """The smallest L with 2**L >= length."""
    return F.when(e <= s, F.lit(0)).otherwise(F.length(F.bin((e - s).cast("long")))).cast("int")


def down(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def width(by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), by)


def bins(s: Column, e: Column, m: Column) -> Column:
    """Bins of level ``m`` in which intervals that overlap [s, e] may begin."""
    return F.sequence(down(s - width(m) + 1, m), down(e, m))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Struct columns (a, b) of the rows of equal keys whose intervals share a point; both tables have s and e, whole numbers.

    The shorter of two intervals looks for the longer one in its bin; of equal
    levels the row of ``a`` looks.  So a pair is found once, whatever the
    lengths, and the join has only equality keys.  Rows whose end is before
    their start, or with a null key or end, overlap nothing.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        fine = df.filter("s <= e").withColumn("_l", level(F.col("s"), F.col("e")))
        return fine.select(*keys, *[F.col(c).alias(f"_{name}_{c}") for c in df.columns], F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "_l")

    x, y = side(a, "a"), side(b, "b")
    mine, yours = [f"_a_{c}" for c in a.columns], [f"_b_{c}" for c in b.columns]

    def spread(own: DataFrame, other: DataFrame, names: list[str], wider: str) -> DataFrame:
        there = other.agg(F.array_sort(F.collect_set("_l")).alias("_there"))  # one row of at most 64 levels
        m = F.transform(F.filter("_there", lambda m: m >= F.col("_l") if wider == ">=" else m > F.col("_l")), lambda m: F.transform(bins(F.col("s"), F.col("e"), m), lambda i: F.struct(m.alias("m"), i.alias("bin"))))
        return own.join(F.broadcast(there)).select(*keys, *names, F.explode(F.flatten(m)).alias("_p")).select(*keys, *names, "_p.m", "_p.bin")

    still = lambda own, names: own.select(*keys, *names, F.col("_l").alias("m"), down(F.col("s"), F.col("_l")).alias("bin"))
    on = [*keys, "m", "bin"]
    meet = (F.col("_a_s") <= F.col("_b_e")) & (F.col("_b_s") <= F.col("_a_e"))
    pairs = spread(x, y, mine, ">=").join(still(y, yours), on).filter(meet).select(*mine, *yours)
    pairs = pairs.unionAll(still(x, mine).join(spread(y, x, yours, ">"), on).filter(meet).select(*mine, *yours))
    return pairs.select(F.struct(*[F.col(f"_a_{c}").alias(c) for c in a.columns]).alias("a"), F.struct(*[F.col(f"_b_{c}").alias(c) for c in b.columns]).alias("b"))


def overlapping_pairs(df: DataFrame, key: str, id_: str, start: str, end: str) -> DataFrame:
    """(key, a, b), a < b, of the intervals of a key that share a point."""
    rows = df.select(key, F.col(id_).alias("i"), F.col(start).alias("s"), F.col(end).alias("e"))
    return overlap_join(rows, rows, [key]).filter("a.i < b.i").select(F.col(f"a.{key}").alias(key), F.col("a.i").alias("a"), F.col("b.i").alias("b"))


def _sums(l: Column, s: Column, levels: list[int]) -> Column:
    """(m, bin): where an interval stands in the sums of the levels that are FAR wider."""
    return F.transform(F.filter(F.array(*map(F.lit, levels)), lambda m: m >= l + FAR), lambda m: F.struct(m.alias("m"), down(s, m - 2).alias("bin")))


def _quarters(l: Column, s: Column, e: Column) -> Column:
    """(m, bin): the sums, over quarters of its own width, in which those stand that are FAR levels smaller and may overlap an interval."""
    return F.transform(F.sequence(down(s, l - 2) - 1, down(e, l - 2)), lambda i: F.struct(l.alias("m"), i.alias("bin")))


def _alone(s: Column, e: Column, levels: list[int], wanted: Callable[[Column], Column]) -> Column:
    """(m, bin): where intervals of the ``wanted`` levels stand alone that may overlap an interval."""
    return F.flatten(F.transform(F.filter(F.array(*map(F.lit, levels)), wanted), lambda m: F.transform(bins(s, e, m), lambda i: F.struct(m.alias("m"), i.alias("bin")))))


def resolve_overlaps(df: DataFrame, key: str, id_: str, start: str, end: str, *order: str, share: float = 0.5) -> DataFrame:
    """(key, id, start, end) of the rows kept when each key is read in ``order`` (ascending, nulls last) and then by id: those that overlap no kept row by more than ``share`` of the shorter.

    It goes by rounds instead of reading a key in order.  A row that is the
    best of all open rows in every bin that could hold one overlapping it is
    kept, whatever comes; the open rows that overlap it too much are dropped.
    This is repeated until none is open; rows in random order take about as
    many rounds as the logarithm of the longest chain of overlapping rows, a
    chain that gets steadily better takes one for each row.  In a round the
    open rows stay in their own bins: they are summed up there, and the kept
    ones, each in one round only, are sent to the bins of about their own
    width.  Only where some rows are FAR levels wider than others do open rows
    look beyond: sums over bins take the place of the many short rows under a
    long one.  So no key, dense region or pair of crowded bins is spelled out,
    and each round is written.

    Starts and ends are whole numbers and ``share`` is below 1.  A null key is
    a key.  A row with a null start or end, or one that ends before it starts,
    overlaps nothing and is kept.  Of equal rows one is kept.
    """
    spark, root = df.sparkSession, scratch(df.sparkSession, "overlaps")

    def save(x: DataFrame, name: str) -> DataFrame:
        x.write.parquet(f"{root}/{name}")
        return spark.read.schema(x.schema).parquet(f"{root}/{name}")

    s, e, l = F.col("s"), F.col("e"), F.col("l")
    length, k = e - s + 1, F.struct(F.col(key)).alias("k")  # a struct is equal to itself where the key in it is null
    rows = df.select(k, F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate((key, id_, start, end))]).alias("row"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(id_).alias("_id"), F.monotonically_increasing_id().alias("uid"))
    best = F.struct(*[x for i in range(len(order)) for x in (F.col(f"_o{i}").isNull().alias(f"n{i}"), F.col(f"_o{i}").alias(f"o{i}"))], F.col("_id").alias("id"), F.col("uid").alias("uid")).alias("rank")
    # The row itself is kept where it takes no part; of the others its parts are enough.
    rows = save(rows.select("k", level(s, e).alias("l"), "s", "e", best, F.when(s <= e, F.lit(None)).otherwise(F.col("row")).alias("row")), "rows")
    out = rows.filter("s is null or e is null or s > e").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate((key, id_, start, end))])
    touching = rows.filter("s <= e").select("k", "l", down(s, l).alias("bin"), "s", "e", "rank")
    levels = sorted(touching.agg(F.collect_set("l").alias("levels")).first()["levels"])  # at most 64
    far = bool(levels) and levels[-1] - levels[0] >= FAR
    on, own, turn, open_ = ["k", "m", "bin"], ["k", "l", "bin"], 0, touching
    spread = lambda x, p, *c: x.select("k", *c, F.explode(p).alias("p")).select("*", "p.*").drop("p")
    while open_.limit(1).count():
        turn += 1
        firsts = save(open_.groupBy(*own).agg(F.min(F.struct("rank", "s", "e")).alias("t")).select(*own, "t.*"), f"firsts-{turn}")
        tops, at = firsts.select("k", l.alias("m"), "bin", F.col("rank").alias("top")), F.col("bin").alias("own")
        waits = spread(firsts, _alone(s, e, levels, lambda m: m > l - FAR), "l", at, "rank").join(tops, on).filter("top < rank").select("k", "l", F.col("own").alias("bin"))
        if far:
            short = spread(open_, _sums(l, s, levels), "rank").groupBy(*on).agg(F.min("rank").alias("top"))
            waits = waits.unionAll(spread(firsts.filter(l >= levels[0] + FAR), _quarters(l, s, e), "l", at, "rank").join(short, on).filter("top < rank").select("k", "l", F.col("own").alias("bin")))
        won = save(firsts.join(waits.distinct(), own, "left_anti"), f"won-{turn}")
        # Winners of about the width of an open row come to its bin; few of them can stand there, for they hardly overlap.
        sent = spread(won, _alone(s, e, levels, lambda m: (m > l - FAR) & (m < l + FAR)), s.alias("ws"), e.alias("we")).withColumnsRenamed({"k": "wk", "bin": "wbin"})
        both = F.least("e", "we") - F.greatest("s", "ws") + 1
        much = both > share * F.least(length, F.col("we") - F.col("ws") + 1)
        left = open_.join(sent, (F.col("k") == F.col("wk")) & (l == F.col("m")) & (F.col("bin") == F.col("wbin")) & much, "left_anti")
        if far:
            uid = F.col("rank.uid").alias("uid")
            alone = won.select("k", l.alias("m"), "bin", s.alias("ws"), e.alias("we"))
            under = spread(open_, _alone(s, e, levels, lambda m: m >= l + FAR), uid, "s", "e").join(alone, on).filter(much).select("uid")
            # A much shorter winner overlaps too much by its end past a start, or by its start before an end.
            sums = spread(won, _sums(l, s, levels), "s", "e").groupBy(*on).agg(F.max(e + 1 - share * length).alias("past"), F.min(s + share * length - 1).alias("from"))
            before = F.col("bin") <= down(s, F.col("m") - 2)
            over = spread(open_.filter(l >= levels[0] + FAR), _quarters(l, s, e), uid, "s", "e").join(sums, on).filter(F.when(before, F.col("past") > s).otherwise(F.col("from") < e)).select("uid")
            left = left.withColumn("uid", uid).join(under.unionAll(over).distinct(), "uid", "left_anti").drop("uid")
        open_ = save(left, f"open-{turn}")
    if turn:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        won = spark.read.schema(won.schema).parquet(*[f"{root}/won-{i}" for i in range(1, turn + 1)])
        out = out.unionAll(won.select(F.col(f"k.{key}").alias(key), F.col("rank.id").alias(id_), s.cast(kinds[start]).alias(start), e.cast(kinds[end]).alias(end)))
    return out


def islands(df: DataFrame, key: str, start: str, end: str, *order: str, gap: float = 0) -> DataFrame:
    """``df`` with ``_island``: in the order of start and ``order``, a row past every end before it, and ``gap`` more, begins a new island of its key.

    No row of an island touches another island, so what is decided in order can
    be decided in each island alone.  Rows are dealt by ranges of (key, start),
    which sampled quantiles cut evenly; what passes from one range of a key to
    the next is one row for each.  A null key is a key; rows with a null start
    or end are left out.
    """
    spark, by = df.sparkSession, [key, start, *order]
    rows = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    path = f"{scratch(spark, 'islands')}/rows"
    rows.write.parquet(path)  # the ranges then stay what they are
    rows = spark.read.schema(rows.schema).parquet(path)
    k = F.struct(F.col(key))
    inside = Window.partitionBy(k, "_range").orderBy(start, *order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, a row each

    def carried(x: DataFrame, total: Column, over: Column) -> DataFrame:
        sums = x.groupBy(k.alias("_k"), "_range").agg(total.alias("_sum")).select("_k", F.col("_range").alias("_r"), over.over(ahead).alias("_carry"))
        return x.join(sums, (k == F.col("_k")) & (F.col("_range") == F.col("_r"))).drop("_k", "_r")

    reach = carried(rows, F.max(end), F.max("_sum")).withColumn("_reach", F.greatest("_carry", F.max(end).over(before)))
    flag = reach.withColumn("_new", F.coalesce((F.col(start) > F.col("_reach") + gap).cast("int"), F.lit(1))).drop("_carry", "_reach")
    return carried(flag, F.sum("_new"), F.sum("_sum")).withColumn("_island", F.coalesce("_carry", F.lit(0)) + F.sum("_new").over(upto)).drop("_carry", "_new", "_range")


def pack_lanes(df: DataFrame, key: str, id_: str, start: str, end: str, gap: float = 8) -> DataFrame:
    """(key, id, lane): each interval, by start and then id, in the first lane whose last interval ends more than ``gap`` before it begins.

    The first free lane depends on all rows before it in the island, so an
    island is read in order: sorted by Spark, streamed through, with the open
    lanes in memory and no more, in n log(lanes).  Islands are shared out, so
    one task reads in order only what is linked by overlaps.  A null key is a
    key; a row with a null start or end has lane null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = islands(df.select(key, id_, start, end), key, start, end, id_, gap=gap)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = None
        free: list[int] = []
        busy: list[tuple[float, int]] = []
        lanes = 0
        for b in batches:
            out = []
            for where, s, e in zip(zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if where != at:
                    at, free, busy, lanes = where, [], [], 0
                while busy and busy[0][0] + gap < s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, lanes = lanes, lanes + 1
                heapq.heappush(busy, (e, lane))
                out.append(lane)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int32())], names=["k", "i", "lane"])

    dealt = rows.repartition(key, "_island").sortWithinPartitions(key, "_island", start, id_).select(key, id_, start, end, "_island")
    packed = dealt.mapInArrow(pack, f"k {kinds[key]}, i {kinds[id_]}, lane int").select(F.col("k").alias(key), F.col("i").alias(id_), "lane")
    odd = df.filter(F.col(start).isNull() | F.col(end).isNull())
    return packed.unionAll(odd.select(key, id_, F.lit(None).cast("int").alias("lane")))
