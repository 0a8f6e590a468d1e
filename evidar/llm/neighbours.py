"""Approximate nearest neighbours by cosine: cross-polytope hashing.

A vector is rotated by rounds of random signs and a fast Hadamard transform
and falls into the bucket of the nearest signed axis; each table has rotations
of its own.  A query probes the buckets of a table in the order of its own
rotated coordinates.  How many it probes is measured, not guessed: a bounded
sample of queries is compared with every row, and the fewest probes are taken
that find RECALL of their true neighbours.  What the probed buckets hold is
ranked by the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

TABLES = 2
#: Rotations of a table whose signed axes make one bucket, by the rows of the index: one, and two beyond ROWS_ONE.
ROWS_ONE = 1 << 20
#: The share of true neighbours that the measured sample must find, and the size of that sample.
RECALL, SAMPLE = 0.97, 256
#: Rows of a bucket that meet in one task: of the index, and of the queries.
BLOCK, QUERIES = 8192, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(v: np.ndarray, seed: int) -> np.ndarray:
    """Scores of the signed axes under pseudo-rotation ``seed``: (+axes, -axes) for each row; zeros fill up to a power of two."""
    d = 1 << max(0, v.shape[1] - 1).bit_length()
    x = np.zeros((len(v), d))
    x[:, : v.shape[1]] = v
    signs = np.random.RandomState(1000 + seed).randint(0, 2, (3, d)) * 2.0 - 1
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate([x, -x], 1)


def scores(v: np.ndarray, t: int, levels: int) -> np.ndarray:
    """The score of each bucket of table ``t``: of an axis, or the sum of one axis from each of two rotations."""
    one = rotated(v, 2 * t)
    return one if levels == 1 else (one[:, :, None] + rotated(v, 2 * t + 1)[:, None, :]).reshape(len(v), -1)


def bucket(v: np.ndarray, t: int, levels: int) -> np.ndarray:
    one = rotated(v, 2 * t).argmax(1)
    return one if levels == 1 else one * rotated(v[:1], 0).shape[1] + rotated(v, 2 * t + 1).argmax(1)


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column whose rows have ``dim`` values, in double precision."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def by_dimension(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.Table]]:
    rows = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    dims = np.array(rows["dim"].to_numpy())
    for d in np.unique(dims):
        part = rows.filter(pa.array(dims == d))
        yield int(d), part.set_column(part.schema.get_field_index(column), column, part[column].combine_chunks())


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v, dim) of the rows that take part, one for each id and vector: no null id, no null or empty vector, no null or non-finite component, not all zero."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{id_}`").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine.alias("fine")).withColumn("dim", F.size("v"))


def _first(df: DataFrame) -> DataFrame:
    """One row of each id, the one of the smallest vector; nothing is shuffled but ids where none stands twice."""
    twice = df.groupBy("id").count().filter("count > 1").limit(1).count()
    return df.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")) if twice else df


def _indexed(df: DataFrame, levels: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in by_dimension(b, "v"):
                u = unit(x["v"].combine_chunks(), d)
                codes = np.stack([bucket(u, t, levels) for t in range(TABLES)], 1).astype(np.int32)
                out = x.append_column("codes", pa.array(codes.tolist(), pa.list_(pa.int32())))
                yield from out.combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select("id", "v", "dim").mapInArrow(code, f"id {kinds['id']}, v {kinds['v']}, dim int, codes array<int>")


def _truth(index: DataFrame, sample: list, k: int) -> DataFrame:
    """(q, id, codes): the k nearest of every row to each of the sampled queries, by brute force."""
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r)
    asked = {d: (np.array([r["id"] for r in rows]), unit(pa.array([list(r["v"]) for r in rows], pa.list_(pa.float64())), d)) for d, rows in by_dim.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in by_dimension(b, "v"):
                if d not in asked:
                    continue
                q, m = asked[d]
                ids = np.array(x["id"].to_pylist())
                sims = m @ unit(x["v"].combine_chunks(), d).T
                sims[q[:, None] == ids[None, :]] = -2
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(sims[i, j]), pa.array(ids[j]), x["codes"].combine_chunks().take(pa.array(j))], names=["q", "s", "id", "codes"])

    kind = index.schema["id"].dataType.simpleString()
    rows = index.mapInArrow(near, f"q {kind}, s double, id {kind}, codes array<int>").filter("s > -2")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "id", "codes"))), 1, k)
    part = rows.groupBy("q", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")).agg(best.alias("x"))
    return part.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, k).alias("x")).select("q", F.explode("x").alias("x")).select("q", "x.id", "x.codes")


def probes_needed(index: DataFrame, queries: DataFrame, k: int, levels: int) -> int:
    """The fewest probes of each table that find RECALL of the true neighbours of SAMPLE queries (those whose ids hash lowest)."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    true = _truth(index, sample, k).collect()  # SAMPLE * k rows at most
    if not true:
        return 1
    by_id = {r["id"]: r for r in sample}
    need, places = [], {}
    for r in true:
        if r["q"] not in places:
            x = by_id[r["q"]]
            u = unit(pa.array([list(x["v"])], pa.list_(pa.float64())), x["dim"])
            places[r["q"]] = [np.argsort(np.argsort(-scores(u, t, levels)[0], kind="stable"), kind="stable") for t in range(TABLES)]
        need.append(min(int(p[c]) for p, c in zip(places[r["q"]], r["codes"], strict=True)) + 1)
    need.sort()
    return need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)]


def _probed(queries: DataFrame, probes: int | None, levels: int) -> DataFrame:
    """(id, v, dim, t, code): the buckets that each query looks into; all of table 0 where ``probes`` is None."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in by_dimension(b, "v"):
                u = unit(x["v"].combine_chunks(), d)
                for t in range(TABLES if probes else 1):
                    step = max(1, (1 << 22) // (2 << max(0, d - 1).bit_length()) ** levels)
                    for low in range(0, len(u), step):
                        s = scores(u[low : low + step], t, levels)
                        n = min(probes or s.shape[1], s.shape[1])
                        codes = np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)
                        part = x.slice(low, len(s))
                        out = part.append_column("t", pa.array(np.full(len(s), t, np.int32))).append_column("codes", pa.array(codes.tolist(), pa.list_(pa.int32())))
                        yield from out.combine_chunks().to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in queries.schema.fields}
    out = queries.select("id", "v", "dim").mapInArrow(probe, f"id {kinds['id']}, v {kinds['v']}, dim int, t int, codes array<int>")
    return out.select("id", "v", "dim", "t", F.explode("codes").alias("code"))


def _met(index: DataFrame, probed: DataFrame, k: int, tables: int) -> DataFrame:
    """(q, r, score): the k best of each block of a bucket for each query that probes it."""
    key = ["dim", "t", "code"]
    rows = index.select("id", "v", "dim", F.explode(F.slice(F.transform("codes", lambda c, t: F.struct(t.alias("t"), c.alias("code"))), 1, tables)).alias("x")).select("id", "v", "dim", "x.t", "x.code")
    blocks = lambda df, n: df.groupBy(*key).agg(F.ceil(F.count("*") / n).cast("int").alias("n"))
    nv, nq = blocks(rows, BLOCK).withColumnRenamed("n", "nv"), blocks(probed, QUERIES).withColumnRenamed("n", "nq")
    both = nv.join(nq, key)
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probed.join(both, key).select(*key, "id", "v", part("nq").alias("qb"), every("nv").alias("vb"))
    right = rows.join(both, key).select(*key, "id", "v", part("nv").alias("vb"), every("nq").alias("qb"))
    kind = index.schema["id"].dataType.simpleString()
    types = pa.schema([("q", pa.string() if kind == "string" else pa.int64()), ("r", pa.string() if kind == "string" else pa.int64()), ("score", pa.float64())])

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return types.empty_table()
        d = a["dim"][0].as_py()
        q, r = np.array(a["id"].to_pylist()), np.array(b["id"].to_pylist())
        order = np.argsort(r, kind="stable")  # equal scores then stand by id
        r, m = r[order], unit(b["v"].combine_chunks(), d)[order]
        u, out = unit(a["v"].combine_chunks(), d), []
        for low in range(0, len(q), 512):
            sims = np.clip(u[low : low + 512] @ m.T, -1, 1)
            sims[q[low : low + 512, None] == r[None, :]] = -2
            # All that come near the k-th best; a matrix product may differ in the last digits, so equals are told by the plain sum.
            least = np.partition(sims, -k, axis=1)[:, -k] if len(r) > k else np.full(len(sims), -1.5)
            i, j = np.nonzero((sims >= least[:, None] - 1e-12) & (sims > -2))
            s = np.empty(len(i))
            for x in range(0, len(i), 1 << 14):
                s[x : x + (1 << 14)] = (u[low + i[x : x + (1 << 14)]] * m[j[x : x + (1 << 14)]]).sum(axis=1)
            o = np.lexsort((j, -s, i))
            i, j, s = i[o], j[o], s[o]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            out.append((q[low + i[place < k]], r[j[place < k]], s[place < k]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=types)

    met = left.groupBy(*key, "qb", "vb").cogroup(right.groupBy(*key, "qb", "vb")).applyInArrow(best, f"q {kind}, r {kind}, score double")
    return met


def nearest(queries: DataFrame, rows: DataFrame, ws: Workspace, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest cosine found for each query, ties by the smaller id; never a row of the query's own id.

    Rows that are null, zero, or hold null or non-finite components take no
    part on either side; nor do rows without an id.  Of several vectors under
    one id the smallest (as an array) stands, so repeated rows count once.
    Vectors meet only those of the same length.  A query that finds fewer than
    k looks into every bucket, so it gets k wherever there are so many rows.
    Empty tables give no row; other columns are not looked at.  Ids are whole
    numbers or strings.

    A bucket of many rows or many queries is cut into blocks; only pairs of a
    block of queries and a block of rows are compared, and each keeps k.
    """
    index, asked = _first(usable(rows, id_, vector)), _first(usable(queries, id_, vector))
    levels = 1 if index.count() <= ROWS_ONE else 2
    index, asked = ws.save(_indexed(index, levels), "index"), ws.save(asked, "queries")
    probed = ws.save(_probed(asked, probes_needed(index, asked, k, levels), levels), "probed")
    met = ws.save(_met(index, probed, k, TABLES), "met")
    found = met.groupBy("q").agg(F.count_distinct("r").alias("n")).filter(F.col("n") >= k)
    short = ws.save(asked.join(found, asked.id == found.q, "left_anti"), "short")
    met = met.unionByName(_met(index, _probed(short, None, levels), k, 1))
    pairs = met.groupBy("q", "r").agg(F.max("score").alias("score"))
    top = pairs.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "r"))), 1, k).alias("x"))
    return top.select(F.col("q").alias("query_id"), F.posexplode("x").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.r").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.filter("vec_id % 50 = 0"), rows, Workspace(spark, "neighbours"))
