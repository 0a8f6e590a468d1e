"""Density clusters of a neighbour graph: spanning forest by Borůvka rounds, cut where clusters are stable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch

#: Edges that one task may finish (at most 40 bytes each); what is left of a graph is counted first.
LIMIT = 1 << 18


class Steps:
    """Tables written one after the other, so that a round never depends on the plan of the rounds before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")


def meet(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are both shuffled: there are hundreds of them over the rounds, and each table that Spark chose to broadcast would go through the driver."""
    return a.join(b.hint("merge"), on, how)


def roots(up: DataFrame, steps: Steps) -> DataFrame:
    """(t, label): the end that each node of ``up`` (t, label) reaches by its pointers; an end points to itself.  Pointers double in each round."""
    while True:
        far = up.select(F.col("t").alias("label"), F.col("label").alias("far"))
        step = steps.save(meet(up, far, "label").select("t", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
        up = step.select("t", "label")
        if not step.filter("moved").limit(1).count():
            return up


class Sets:
    """Sets of the values of two columns, joined one by one; each is named by its smallest value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        self.x, self.y = at[: len(x)], at[len(x) :]
        self.up = list(range(len(self.names)))

    def end(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, order: np.ndarray) -> list[int]:
        """The places in ``order`` whose pairs joined two sets."""
        made = []
        for k, (i, j) in enumerate(zip(self.x[order].tolist(), self.y[order].tolist(), strict=True)):
            i, j = self.end(i), self.end(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                made.append(k)
        return made


def joined(edges: DataFrame) -> DataFrame:
    """(t, label) of the nodes of ``edges`` (a, b), at most LIMIT, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            t = pa.Table.from_batches(parts)
            sets = Sets(t["a"].to_numpy(), t["b"].to_numpy())
            sets.join(np.arange(len(t)))
            labels = sets.names[[sets.end(i) for i in range(len(sets.names))]]
            yield pa.RecordBatch.from_arrays([pa.array(sets.names), pa.array(labels)], names=["t", "label"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, f"t {kind}, label {kind}")


def without_cycles(edges: DataFrame, parts: int) -> DataFrame:
    """``edges`` (a, b, w, x, y) less those that close a cycle of lesser ones among a share of the edges, of which there are ``parts``.

    The greatest edge of a cycle is in no least spanning forest, so none of
    theirs goes; a share keeps fewer edges than there are trees.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            t = pa.Table.from_batches(held)
            a, b, w, x, y = (t[c].to_numpy() for c in ("a", "b", "w", "x", "y"))
            order = np.lexsort((b, a, w))
            yield from t.take(pa.array(order[Sets(x, y).join(order)])).combine_chunks().to_batches()

    return edges.repartition(parts).mapInArrow(run, edges.schema)


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    While more than LIMIT edges are left, each node joins its smallest
    neighbour, if smaller, and edges within a set go; one task joins the rest.
    """
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    left = steps.save(edges.filter("a <> b").select("a", "b"))
    labels = nodes.withColumn("label", F.col("node"))
    while True:
        small = left.limit(LIMIT + 1).count() <= LIMIT
        if small:
            step = steps.save(joined(left))
        else:
            step = roots(steps.save(left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("t")).agg(F.least(F.min("b"), F.first("a")).alias("label"))), steps)
        to = step.select(F.col("t").alias("label"), F.col("label").alias("to"))
        labels = steps.save(meet(labels, to, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        if small:
            return labels
        x, y = step.select(F.col("t").alias("a"), F.col("label").alias("x")), step.select(F.col("t").alias("b"), F.col("label").alias("y"))
        left = steps.save(meet(meet(left, x, "a"), y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def spanning_forest(edges: DataFrame, steps: Steps) -> DataFrame:
    """(a, b, w) of the least spanning forest of ``edges`` (a, b, w), equal weights by a and then b.

    In each Borůvka round every tree takes the least edge that leaves it, so
    trees at least halve in number; edges within a tree go.  A tree points to
    the one that its edge leads to; as no two edges are equal, pointers meet in
    one pair of trees that took the same edge, whose smaller one is the end.
    After a round, shares of the edges lose those that close cycles as long as
    that halves them, and once LIMIT or fewer are left one task does the rest.
    """
    left = steps.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    forest = []
    n = left.count()
    while n:
        e = F.struct("w", "a", "b", "x", "y").alias("e")
        best = left.select(F.col("x").alias("t"), e).unionAll(left.select(F.col("y").alias("t"), e)).groupBy("t").agg(F.min("e").alias("e"))
        best = steps.save(best.select("t", "e.a", "e.b", "e.w", F.when(F.col("t") == F.col("e.x"), F.col("e.y")).otherwise(F.col("e.x")).alias("up")))
        back = best.select(F.col("t").alias("up"), F.col("up").alias("back"))
        label = F.when(F.col("back") == F.col("t"), F.least("t", "up")).otherwise(F.col("up")).alias("label")
        taken = steps.save(meet(best, back, "up").select("t", label, "a", "b", "w"))
        forest.append(taken.filter("t <> label").select("a", "b", "w"))
        labels = roots(taken.select("t", "label"), steps)
        x, y = labels.select(F.col("t").alias("x"), F.col("label").alias("lx")), labels.select(F.col("t").alias("y"), F.col("label").alias("ly"))
        left = steps.save(meet(meet(left, x, "x"), y, "y").filter("lx <> ly").select("a", "b", "w", F.col("lx").alias("x"), F.col("ly").alias("y")))
        n, before = left.count(), 0
        while n > LIMIT and (not before or 2 * n <= before):
            left = steps.save(without_cycles(left, -(-n // LIMIT)))
            n, before = left.count(), n
        if 0 < n <= LIMIT:
            forest.append(steps.save(without_cycles(left, 1)).select("a", "b", "w"))
            break
    out = edges.select(*[F.col(c) for c in ("a", "b", "w")]).limit(0)
    for f in forest:
        out = out.unionAll(f)
    return out


def components_by_level(forest: DataFrame, levels: int, steps: Steps) -> DataFrame:
    """(j, node, label): the smallest node that each node of ``forest`` (a, b, j) reaches by edges of level j or below.

    Each edge is looked at once, in its own level, where it joins components of
    the level before.
    """
    labels = steps.save(forest.select(F.col("a").alias("node")).unionAll(forest.select("b")).distinct().withColumn("label", F.col("node")))
    out = []
    for j in range(levels):
        x, y = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        new = components(meet(meet(forest.filter(F.col("j") == j), x, "a"), y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")), steps)
        to = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = steps.save(meet(labels, to, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        out.append(labels.select(F.lit(j).alias("j"), "node", "label"))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionAll(x)
    return all_


def reachability(near: DataFrame, samples: int) -> DataFrame:
    """(a, b, w): mutual reachability of the neighbour graph ``near`` (q, r, sim, rank), whose distance is 1 - sim.

    The core distance of a row is that of the nearest one by which, itself
    counted, ``samples`` rows are reached (of its last neighbour, if it has
    fewer).  Distances are of six digits.
    """
    d = F.round(1 - F.col("sim"), 6)
    core = near.filter(F.col("rank") < samples).groupBy("q").agg(F.max(d).alias("core"))
    x, y = core.select("q", F.col("core").alias("cq")), core.select(F.col("q").alias("r"), F.col("core").alias("cr"))
    return meet(meet(near, x, "q", "left"), y, "r", "left").select(F.col("q").alias("a"), F.col("r").alias("b"), F.greatest(d, "cq", "cr").alias("w"))


def density_clusters(near: DataFrame, ids: DataFrame, id_: str, smallest: int = 5, samples: int = 5, levels: int = 12) -> DataFrame:
    """(id, label): the density cluster of each of ``ids``, named by its smallest id, or null for noise; ids are whole numbers.

    The hierarchy is that of single linkage over mutual reachability, read at
    ``levels`` distances, evenly from the least to the greatest edge of the
    spanning forest.  A component of ``smallest`` rows or more is a cluster; at
    the next distance it goes on as the same cluster while it swallows only
    smaller ones, and where two or more clusters meet a new one begins.  The
    stability of a cluster is the sum of rows times the fall of 1 / distance
    over the distances where it stands.  From the top, a cluster is taken if it
    is at least as stable as the best choice among those below it; a root that
    has clusters below is not taken.  All rows it ever held bear its name.
    """
    steps = Steps(near.sparkSession, "clusters")
    forest = steps.save(spanning_forest(steps.save(reachability(near, samples)), steps))
    span = forest.agg(F.min("w").alias("lo"), F.max("w").alias("hi")).first()
    out = ids.select(F.col(id_).alias("id"))
    if span["lo"] is None:
        return out.select("id", F.lit(None).cast("long").alias("label"))
    lo, hi = span["lo"], span["hi"]
    cuts = [round(lo + (hi - lo) * j / max(1, levels - 1), 9) for j in range(levels)]
    cuts = sorted(set(cuts))
    fall = [1 / max(d, 1e-6) - 1 / max(n, 1e-6) for d, n in zip(cuts, [*cuts[1:], 2 * cuts[-1]], strict=True)]
    # An edge stands in each level that reaches its weight.
    first = F.array_min(F.filter(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(j).alias("j")) for j, d in enumerate(cuts)]), lambda x: x["d"] >= F.col("w")))["j"]
    labels = components_by_level(steps.save(forest.select("a", "b", first.alias("j"))), len(cuts), steps)
    big = labels.groupBy("j", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, smallest))
    parents = labels.select((F.col("j") - 1).alias("j"), F.col("node").alias("label"), F.col("label").alias("parent"))  # a label is a node of its component
    big = steps.save(meet(big, parents, ["j", "label"], "left"))
    falls = F.element_at(F.array(*map(F.lit, fall)), F.col("j") + 1)
    big = big.withColumn("gain", F.round(F.col("n") * falls, 6))
    # Up: what each component is, and its stability so far; rows are components of ``smallest`` rows.
    state: list[DataFrame] = []
    for j in range(len(cuts)):
        here = big.filter(F.col("j") == j)
        if j:
            k = state[-1].groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("kids"), F.max("cluster").alias("c"), F.max("own").alias("o"), F.max("below").alias("b"), F.sum(F.greatest("own", "below")).alias("best"))
            here = meet(here, k, "label", "left")
        else:
            here = here.withColumns({"kids": F.lit(None).cast("long"), "c": F.lit(None).cast("string"), "o": F.lit(None).cast("double"), "b": F.lit(None).cast("double"), "best": F.lit(None).cast("double")})
        on = F.coalesce(F.col("kids") == 1, F.lit(False))
        state.append(steps.save(here.select("label", "parent", F.when(on, F.col("c")).otherwise(F.concat_ws("/", F.lit(j), "label")).alias("cluster"), F.round(F.when(on, F.col("o")).otherwise(0.0) + F.col("gain"), 6).alias("own"), F.when(on, F.col("b")).otherwise(F.coalesce("best", F.lit(0.0))).alias("below"))))
    # Down: a cluster is decided where it ends; below one that is taken nothing is.
    above: DataFrame | None = None
    taken = []
    for j in range(len(cuts) - 1, -1, -1):
        s = state[j]
        if above is not None:
            s = meet(s, above.select(F.col("label").alias("parent"), F.col("cluster").alias("pc"), F.col("open").alias("po")), "parent", "left")
        else:
            s = s.withColumns({"pc": F.lit(None).cast("string"), "po": F.lit(None).cast("boolean")})
        ends = F.col("pc").isNull() | (F.col("pc") != F.col("cluster"))
        root_of_more = F.col("pc").isNull() & (F.col("below") > 0)
        take = F.coalesce(F.col("po"), F.lit(True)) & ends & (F.col("own") >= F.col("below")) & ~root_of_more
        above = steps.save(s.select("label", "cluster", take.alias("take"), (F.coalesce(F.col("po"), F.lit(True)) & ~take).alias("open")))
        taken.append(above.filter("take").select(F.lit(j).alias("j"), "label"))
    chosen = taken[0]
    for x in taken[1:]:
        chosen = chosen.unionAll(x)
    named = meet(labels, steps.save(chosen), ["j", "label"]).select(F.col("node").alias("id"), "label")
    return meet(out, named, "id", "left")
