"""Nearest neighbours and centroids over embedding tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import scratch
from .relational import first_by

#: Rows of a block, queries that meet it in one task, and the bytes of centres that travel with a task.
BLOCK, QUERIES, CENTRE_BYTES = 4096, 2048, 32 << 20
#: A search that prunes little is swept: its queries are cut into so many shares or more, of so many at most, and all entries stream past each.
SHARES, SHARE = 24, 65_536
#: Queries that tell how much is pruned, and the part of the cells from which on a search is swept; both decide the cost and never the result.
ASKED, WIDE = 2_000, 0.1
#: Width of the rings of a cell, in distance from its centre (unit vectors lie at most 2 apart).
RING = 1 / 64
#: What rounding to six digits may move a similarity by, and a little more.
SLACK = 2e-6


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as unit vectors, in double precision."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def distances(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ centres.T), 0))


def named(vector: str) -> Column:
    """A name that equal vectors share: two digests."""
    return F.concat_ws("/", F.xxhash64(vector).cast("string"), F.md5(F.col(vector).cast("string")))


class NeighbourIndex:
    """A written index for exact nearest neighbours by cosine.

    Rows with the same vector are one entry.  Entries belong to the cell of
    their nearest centre; a cell is cut into rings by the distance from its
    centre, and rings into blocks of about BLOCK entries.  By the triangle
    inequality a query at distance d of a centre is no nearer than lo - d and
    d - hi to an entry of a ring (lo, hi), so a block whose bound is worse than
    the query's k-th best neighbour so far need not be compared.

    Tables, in a folder that the cluster shares: ``entries`` (e, v, cell, dist,
    ring, block), ``members`` (e, id) and ``blocks`` (cell, ring, block, n, lo,
    hi), which has a row for BLOCK entries or a ring.
    """

    def __init__(self, spark: SparkSession, reference: DataFrame, vector: str = "embedding", id_: str = "vec_id", cells: int | None = None, block: int = BLOCK):
        self.spark, self.path, self.block = spark, scratch(spark, "neighbours"), block
        # Equal vectors are one entry, named by two digests of them.
        rows = reference.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null").withColumn("e", named("v"))
        self.kind = rows.schema["id"].dataType.simpleString()
        zero = ~F.exists("v", lambda x: x != 0)
        self.members = self.save(rows.select("e", "id", zero.alias("zero")), "members")
        self.zeros = self.members.filter("zero").select("id")
        self.members = self.members.select("e", "id")
        entries = self.save(rows.filter(~zero).groupBy("e").agg(F.first("v").alias("v")), "vectors")
        self.n = entries.count()
        first = entries.select(F.size("v").alias("d")).first()
        self.dim = first["d"] if first else 1
        self.one_block = cells is None and self.n <= block
        if self.one_block:  # nothing to prune
            self.blocks = spark.createDataFrame([(0, 0, self.n, 0.0, 2.0, 1)], "cell int, group long, n long, lo double, hi double, parts long")
            self.entries = entries.select("e", "v", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("part"))
            return
        wanted = cells or int(max(1, min(self.n**0.5, self.n / 2048, CENTRE_BYTES / 8 / self.dim)))
        self.centres = self._centres(entries, wanted)
        dealt = self.save(self._dealt(entries), "dealt")
        # Rings of a cell are joined until a block is full; one that is more than full is dealt by a hash.
        rings = dealt.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
        upto = Window.partitionBy("cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)  # 128 rings of a cell at most
        rings = rings.withColumn("group", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / block))
        groups = rings.groupBy("cell", "group").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        self.blocks = self.save(groups.withColumn("parts", F.ceil(F.col("n") / block)), "blocks")
        placed = dealt.join(rings.select("cell", "ring", "group"), ["cell", "ring"]).join(self.blocks.select("cell", "group", "parts"), ["cell", "group"])
        self.entries = self.save(placed.select("e", "v", "cell", "group", F.pmod(F.xxhash64("e", F.lit(1)), F.col("parts")).alias("part")), "entries")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _centres(self, entries: DataFrame, wanted: int) -> np.ndarray:
        """Drawn entries, moved once to the mean of the drawn ones next to each; bounded by CENTRE_BYTES."""
        drawn = entries.orderBy(F.xxhash64("e", F.lit(7)), "e").limit(int(min(8 * wanted, max(wanted, CENTRE_BYTES / 8 / self.dim)))).select("v").collect()
        u = unit(pa.array([list(r["v"]) for r in drawn], pa.list_(pa.float64())), self.dim) if drawn else np.zeros((0, self.dim))
        c = u[:wanted]
        if len(u) > len(c):
            near = distances(u, c).argmin(1)
            c = np.stack([u[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
            length = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(length > 1e-9, c / np.maximum(length, 1e-9), u[: len(c)])
        return c

    def _dealt(self, entries: DataFrame) -> DataFrame:
        centres, dim = self.centres, self.dim

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    d = distances(unit(b.column("v"), dim), centres)
                    cell = d.argmin(1)
                    dist = d[np.arange(len(d)), cell]
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist), pa.array((dist / RING).astype(np.int32))], names=["e", "v", "cell", "dist", "ring"])

        return entries.mapInArrow(deal, f"e string, v {entries.schema['v'].dataType.simpleString()}, cell int, dist double, ring int")

    def _cells(self, asked: DataFrame, best: int | None = None) -> DataFrame:
        """(q, cell, d): the ``best`` cells of each query by their bounds, or all that may hold one of similarity ``least``; ``least`` null takes all."""
        centres, dim = self.centres, self.dim
        span = {r["cell"]: (r["lo"], r["hi"]) for r in self.blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # a row for each centre
        lo, hi = (np.array([span.get(c, (9.0, 9.0))[i] for c in range(len(centres))]) for i in (0, 1))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 22) // max(1, len(centres)))
            for b in batches:
                for at in range(0, len(b), step):
                    x = b.slice(at, step)
                    d = distances(unit(x.column("v"), dim), centres)
                    off = np.maximum(np.maximum(lo - d, d - hi), 0)
                    if best:
                        order = np.lexsort((d, off), axis=1)[:, :best]
                        i, j = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
                    else:
                        least = x.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                        i, j = np.nonzero((1 - off * off / 2 >= least[:, None] - SLACK) | np.isnan(least)[:, None])
                    yield pa.RecordBatch.from_arrays([x.column("q").take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(d[i, j])], names=["q", "cell", "d"])

        return asked.mapInArrow(place, "q string, cell int, d double")

    def _compare(self, asked: DataFrame, todo: DataFrame, k: int) -> DataFrame:
        """(q, e, sim): the k nearest entries of each block to each query that ``todo`` (q, cell, group) sends there."""
        key = ["cell", "group", "part"]
        split = todo.groupBy("cell", "group").agg(F.ceil(F.count("*") / QUERIES).alias("turns")).join(self.blocks.select("cell", "group", "parts"), ["cell", "group"])
        left = todo.join(split, ["cell", "group"]).select("q", "cell", "group", F.pmod(F.xxhash64("q", F.lit(2)), F.col("turns")).alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(asked.select("q", "v"), "q")
        right = self.entries.join(split.select("cell", "group", "turns"), ["cell", "group"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
        dim = self.dim
        types = pa.schema([("q", pa.string()), ("e", pa.string()), ("sim", pa.float64())])

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return types.empty_table()
            q, e = np.array(a["q"].to_pylist(), object), np.array(b["e"].to_pylist(), object)
            sims = np.round(unit(a["v"].combine_chunks(), dim) @ unit(b["v"].combine_chunks(), dim).T, 6)
            # All that reach the k-th best: ties are decided by the members' ids.
            least = np.partition(sims, -k, axis=1)[:, -k] if len(e) > k else np.full(len(q), -2.0)
            i, j = np.nonzero(sims >= least[:, None])
            return pa.table([pa.array(q[i], pa.string()), pa.array(e[j], pa.string()), pa.array(sims[i, j])], schema=types)

        return left.groupBy(*key, "turn").cogroup(right.groupBy(*key, "turn")).applyInArrow(best, "q string, e string, sim double")

    def _swept(self, asked: DataFrame, k: int) -> DataFrame:
        """(q, e, sim): of all entries, those that reach the k-th best of each query.

        A share's queries come first and stay in memory with their best so far;
        entries stream past them.  Each entry is sent once for each share, and
        only what is found goes on.
        """
        shares = max(SHARES, -(-asked.count() // SHARE))
        left = asked.select(F.pmod(F.xxhash64("q", F.lit(2)), F.lit(shares)).alias("share"), F.lit(0).alias("kind"), F.col("q").alias("name"), "v")
        right = self.entries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), F.lit(1).alias("kind"), F.col("e").alias("name"), "v")
        dim = self.dim
        names = ["q", "e", "sim"]

        class Share:
            def __init__(self):
                self.q, self.v, self.unit, self.waiting = [], [], None, 0

            def ask(self, b):
                self.q += b.column("name").to_pylist()
                self.v.append(unit(b.column("v"), dim))

            def meet(self, b):
                if self.unit is None:
                    self.unit = np.concatenate(self.v) if self.v else np.zeros((0, dim))
                    self.least = np.full(len(self.unit), -9.0)
                    self.i, self.s, self.e = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, object)]
                if not len(self.unit):
                    return
                e, v = np.array(b.column("name").to_pylist(), object), unit(b.column("v"), dim)
                step = max(k, (1 << 22) // len(self.unit))
                for at in range(0, len(e), step):
                    sims = self.unit @ v[at : at + step].T
                    least = self.least
                    if sims.shape[1] > k and least.min() < -2:
                        least = np.maximum(least, np.round(np.partition(sims, -k, axis=1)[:, -k], 6))
                    i, j = np.nonzero(sims >= (least - SLACK)[:, None])
                    self.i.append(i)
                    self.s.append(np.round(sims[i, j], 6))
                    self.e.append(e[at + j])
                    self.waiting += len(i)
                    if self.waiting > 2 * k * len(self.unit):
                        self.settle()

            def settle(self):
                """Only what reaches the k-th best is kept, ties included."""
                i, s, e = map(np.concatenate, (self.i, self.s, self.e))
                order = np.lexsort((-s, i))
                i, s, e = i[order], s[order], e[order]
                first = np.searchsorted(i, np.arange(len(self.unit) + 1))
                full = np.flatnonzero(np.diff(first) >= k)
                self.least[full] = s[first[full] + k - 1]
                kept = s >= self.least[i]
                self.i, self.s, self.e, self.waiting = [i[kept]], [s[kept]], [e[kept]], 0

            def told(self):
                if self.unit is not None and len(self.unit):
                    self.settle()
                    q = np.array(self.q, object)
                    for at in range(0, len(self.i[0]), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(q[self.i[0][part]], pa.string()), pa.array(self.e[0][part], pa.string()), pa.array(self.s[0][part])], names=names)

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, share = None, Share()
            for b in batches:
                n, kind = b.column("share").to_numpy(), b.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero((np.diff(n) != 0) | (np.diff(kind) != 0)) + 1), len(b)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi == lo:
                        continue
                    if n[lo] != at:
                        yield from share.told()
                        at, share = n[lo], Share()
                    (share.meet if kind[lo] else share.ask)(b.slice(lo, hi - lo))
            yield from share.told()

        dealt = left.unionByName(right).repartition(int(shares), "share").sortWithinPartitions("share", "kind")
        return dealt.mapInArrow(sweep, "q string, e string, sim double")

    def search(self, queries: DataFrame, k: int, vector: str = "embedding", id_: str = "vec_id", same_table: bool = True, probes: int | None = None) -> DataFrame:
        """(q, r, sim, rank): the k most similar reference rows of each query, by similarity of six digits and then id.

        Exact; with ``probes`` only so many blocks are compared for each query,
        those of the best bounds.  A zero vector is similar to all rows by 0.
        Rows without id or vector take no part; vectors are of one length.  The
        result is written once; ``compared`` tells how many pairs of a query
        and a block there are and were compared in the last search.
        """
        rows = queries.select(F.col(id_).alias("q"), F.col(vector).alias("v")).filter("q is not null and v is not null")
        run = f"search-{uuid.uuid4().hex[:8]}"
        zero = ~F.exists("v", lambda x: x != 0)
        asking = self.save(rows.withColumn("k", named("v")), f"{run}-queries")
        asked = self.save(asking.filter(~zero).groupBy("k").agg(F.first("v").alias("v")).select(F.col("k").alias("q"), "v"), f"{run}-asked")  # equal vectors ask once
        depth = k + 1 if same_table else k  # one of them may be the query itself
        if self.one_block:
            ahead = asked.select("q", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("group"))
            found = self._compare(asked, ahead, depth)
        else:
            ahead, found = self._pruned(asked, depth, probes, run)
        self._asked, self._sent = asked, ahead
        return self._told(asking, zero, found, k, depth, same_table, run)

    def _pruned(self, asked: DataFrame, depth: int, probes: int | None, run: str) -> tuple[DataFrame | None, DataFrame]:
        """The (query, block) pairs that are compared, or none where all are, and the nearest entries that they give."""
        rings = F.broadcast(self.blocks) if self.blocks.count() <= 100_000 else self.blocks
        bound = F.greatest(F.col("lo") - F.col("d"), F.col("d") - F.col("hi"), F.lit(0.0))
        of = lambda cells: cells.join(rings, "cell").select("q", "cell", "group", (1 - bound * bound / 2).alias("most"), F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("d")).alias("off"))
        ahead = first_by(of(self._cells(asked.select("q", "v"), probes or FIRST)), ["q"], F.desc("most"), F.asc("off"), F.asc("cell"), F.asc("group"), n=probes or FIRST).select("q", "cell", "group")
        ahead = self.save(ahead, f"{run}-ahead")
        found = self.save(self._compare(asked, ahead, depth), f"{run}-near")
        if not probes:
            # The depth-th best of the first blocks is a bound: only blocks that may hold one as good are left.
            kth = first_by(found, ["q"], F.desc("sim"), n=depth, rank="place").filter(F.col("place") == depth).select("q", F.col("sim").alias("least"))
            wanted = asked.join(kth, "q", "left").select("q", "v", "least")
            some = self.save(wanted.orderBy(F.xxhash64("q", F.lit(3))).limit(ASKED), f"{run}-some")
            if self._cells(some).count() > WIDE * some.count() * len(self.centres):
                return None, self._swept(asked, depth)
            rest = of(self._cells(wanted)).join(kth, "q", "left").filter(F.col("least").isNull() | (F.col("most") >= F.col("least") - SLACK)).select("q", "cell", "group").join(ahead, ["q", "cell", "group"], "left_anti")
            rest = self.save(rest, f"{run}-rest")
            found = found.unionByName(self._compare(asked, rest, depth))
            ahead = ahead.unionByName(rest)
        return ahead, found

    def _told(self, asking: DataFrame, zero: Column, found: DataFrame, k: int, depth: int, same_table: bool, run: str) -> DataFrame:
        """The rows behind the entries found, and those that a zero vector on either side is similar to by 0."""
        # Of one entry the first k + 1 members by id are enough.
        members = first_by(self.members, ["e"], F.asc("id"), n=depth)
        best = first_by(found.join(members, "e").select("q", "id", "sim"), ["q"], F.desc("sim"), F.asc("id"), n=depth)
        near = asking.select(F.col("q").alias("own"), "k").join(best, F.col("k") == best["q"]).select("own", "id", "sim")
        every = F.broadcast(self.members.select("id").orderBy("id").limit(depth))  # k + 1 rows
        zeros = F.broadcast(self.zeros.orderBy("id").limit(depth))  # likewise
        nought = F.lit(0.0).alias("sim")
        near = near.unionByName(asking.filter(zero).select(F.col("q").alias("own")).join(every).select("own", "id", nought)).unionByName(asking.filter(~zero).select(F.col("q").alias("own")).join(zeros).select("own", "id", nought))
        near = near.filter(F.col("own") != F.col("id")) if same_table else near
        ranked = first_by(near, ["own"], F.desc("sim"), F.asc("id"), n=k, rank="rank")
        return self.save(ranked.select(F.col("own").alias("q"), F.col("id").alias("r"), "sim", "rank"), f"{run}-result")


    def compared(self) -> dict[str, int]:
        return {"possible": self._asked.count() * self.blocks.count(), "compared": self._sent.count() if self._sent else self._asked.count() * self.blocks.count()}


#: Blocks that give the first bound of a query.
FIRST = 3


def knn(queries: DataFrame, reference: DataFrame, k: int, vector: str = "embedding", id_: str = "vec_id", same_table: bool = True, block: int = BLOCK, probes: int | None = None) -> DataFrame:
    """(q, r, sim, rank): the k most similar reference rows of each query, ties by id; see NeighbourIndex."""
    return NeighbourIndex(queries.sparkSession, reference, vector, id_, block=block).search(queries, k, vector, id_, same_table, probes)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row (n, hits, recall): how many of the true (q, r) pairs were found."""
    x = true.select("q", "r").join(found.select("q", "r", F.lit(1).alias("hit")), ["q", "r"], "left")
    return x.agg(F.count("*").alias("n"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))


def vote(neighbours: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """(q, family, top_sim, purity, margin) by majority (ties: the family whose first neighbour is nearest), or by summed similarity.

    ``labels`` has r and family.  The margin is the best similarity less the
    best of another family than the winner, or 1 where there is none.
    """
    named = neighbours.join(labels, "r")
    per = named.groupBy("q", "family").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("sim").alias("best"), F.round(F.sum("sim"), 6).alias("weight"))
    order = [F.desc("weight"), F.asc("first")] if weighted else [F.desc("n"), F.asc("first")]
    won = first_by(per, ["q"], *order)
    asked = neighbours.groupBy("q").agg(F.count("*").alias("k"))  # neighbours without a label count, too
    rest = per.join(won.select("q", F.col("family").alias("won")), "q").groupBy("q").agg(F.max("best").alias("top_sim"), F.max(F.when(F.col("family") != F.col("won"), F.col("best"))).alias("other"))
    out = won.join(rest, "q").join(asked, "q")
    return out.select("q", "family", F.round("top_sim", 6).alias("top_sim"), F.round(F.col("n") / F.col("k"), 6).alias("purity"), F.round(F.when(F.col("other").isNull(), 1.0).otherwise(F.col("top_sim") - F.col("other")), 6).alias("margin"))


def centroids(df: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """(label, c): the mean of each label's unit vectors, made a unit vector again."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    parts = df.select(label, norm.alias("n"), F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("x").cast("double") / F.col("n"))).alias("x"))
    whole = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn("_l", length).select(label, F.when(F.col("_l") == 0, F.col("c")).otherwise(F.transform("c", lambda x: x / F.col("_l"))).alias("c"))


def nearest_centroid(df: DataFrame, cents: DataFrame, label: str, vector: str = "embedding", id_: str = "vec_id", limit: int = CENTRE_BYTES) -> DataFrame:
    """(id, family, sim, margin) by the nearest centroid, ties by family; a zero vector is similar to all by 0.

    Up to ``limit`` bytes of centroids travel as one matrix and are multiplied
    with batches of vectors; more are searched in an index of them.  Both give
    the same rows.  Rows without a vector have no family.
    """
    named = cents.select(F.col(label).cast("string").alias("vec_id"), F.col("c").alias("embedding")).filter("vec_id is not null")
    asked = df.select(F.col(id_).alias("id"), F.col(vector).alias("v"))
    none = lambda x: x.select("id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("double").alias("margin"))
    size = named.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"]:
        return none(asked)
    if size["n"] * size["d"] * 8 > limit:
        two = NeighbourIndex(df.sparkSession, named).search(asked, 2, "v", "id", same_table=False)
        by = two.groupBy(F.col("q").alias("id")).agg(F.max(F.when(F.col("rank") == 1, F.col("r"))).alias("family"), F.max("sim").alias("sim"), F.min("sim").alias("other"), F.count("*").alias("n"))
        found = by.select("id", "family", "sim", F.when(F.col("n") > 1, F.round(F.col("sim") - F.col("other"), 6)).otherwise(1.0).alias("margin"))
        return asked.select("id").join(found, "id", "left")
    rows = sorted(named.collect(), key=lambda r: r["vec_id"])  # within the limit
    families, m = pa.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, m.shape[1])
            sims = np.round((v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)) @ m.T, 6)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2]
            two = np.take_along_axis(sims, order, 1)
            margin = np.round(two[:, 0] - two[:, 1], 6) if len(families) > 1 else np.ones(len(v))
            yield pa.RecordBatch.from_arrays([b.column("id"), families.take(pa.array(order[:, 0])), pa.array(two[:, 0]), pa.array(margin)], names=["id", "family", "sim", "margin"])

    return asked.filter("v is not null").mapInArrow(best, f"id {df.schema[id_].dataType.simpleString()}, family string, sim double, margin double").unionByName(none(asked.filter("v is null")))
