"""The neighbour index against brute force: zero vectors, copies, rows without a vector, cut blocks, pruning, and a bounded number of probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidar.operators import similarity as S

NAMES = "vec_id long, embedding array<double>"


def brute(rows, k, queries=None):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None]
    length = lambda v: np.linalg.norm(v) or 1.0
    out = {}
    for i, v in rows:
        if queries is None or i in queries:
            sims = sorted((-round(float(v @ w) / length(v) / length(w), 6) + 0.0, j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in sims[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append((r["r"], r["sim"]))
    return out


def clustered(n, d=12, groups=8, seed=0, spread=0.05):
    r = np.random.RandomState(seed)
    centres = r.randn(groups, d)
    return [(i, (centres[i % groups] + spread * r.randn(d)).tolist()) for i in range(n)]


def test_copies_zeros_and_gaps(spark):
    rows = clustered(120, d=5)
    rows = [(i, rows[0][1] if 40 <= i < 70 else [0.0] * 5 if 70 <= i < 78 else v) for i, v in rows] + [(500, None), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, NAMES)
    got, want = answers(S.knn(df, df, 6, block=8)), brute(rows, 6)
    assert got == want
    assert answers(S.knn(df.filter("vec_id % 7 = 0"), df, 3, block=8)) == brute(rows, 3, {i for i, _ in rows if i is not None and i % 7 == 0})
    none = df.filter("false")
    assert S.knn(df, none, 3).count() == 0


def test_two_tables_keep_equal_ids(spark):
    df = spark.createDataFrame(clustered(30, d=4), NAMES)
    near = answers(S.knn(df, df, 1, same_table=False, block=4))
    assert all(r[0] == (q, 1.0) for q, r in near.items())


def test_cells_are_pruned(spark):
    """Of well separated clusters, far blocks are never compared, and the answer is exact."""
    rows = clustered(600, groups=12, spread=0.02, seed=3)
    df = spark.createDataFrame(rows, NAMES)
    index = S.NeighbourIndex(spark, df, cells=24, block=16)
    got = index.search(df, 4)
    assert answers(got) == brute(rows, 4)
    assert (n := index.compared())["compared"] < 0.4 * n["possible"]
    few = index.search(df, 4, probes=2)
    assert index.compared()["compared"] <= 2 * 600
    assert S.recall(few, got).first()["recall"] > 0.5
    assert S.recall(got, got).first()["recall"] == 1.0


def test_probes_trade_recall(spark):
    r = np.random.RandomState(5)
    df = spark.createDataFrame([(i, r.randn(16).tolist()) for i in range(400)], NAMES)
    index = S.NeighbourIndex(spark, df, block=16)
    true = index.search(df, 5)
    found = [S.recall(index.search(df, 5, probes=p), true).first()["recall"] for p in (1, 8)]
    assert found[0] < found[1] <= 1.0


def test_what_is_not_pruned_is_swept(spark, monkeypatch):
    """Random vectors: entries stream past shares of the queries, ties and copies included, and no pair of a query and a block is sent."""
    r = np.random.RandomState(8)
    rows = [(i, r.randn(16).tolist()) for i in range(300)]
    rows = [(i, rows[i % 40][1] if i >= 200 else v) for i, v in rows]
    df = spark.createDataFrame(rows, NAMES)
    monkeypatch.setattr(S, "SHARES", 3)
    index = S.NeighbourIndex(spark, df, cells=6, block=16)
    assert answers(index.search(df, 5)) == brute(rows, 5)
    assert index._sent is None and index.compared()["compared"] == index.compared()["possible"]


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_nearest_centroid_by_matrix_and_by_index(spark, limit):
    rows = clustered(60, d=6, seed=2) + [(900, [0.0] * 6), (901, None)]
    df = spark.createDataFrame(rows, NAMES)
    c = spark.createDataFrame([(f"f{i}", v) for i, v in clustered(9, d=6, seed=2)] + [("f0 copy", clustered(9, d=6, seed=2)[0][1])], "family string, c array<double>")
    got = {r["id"]: tuple(r)[1:] for r in S.nearest_centroid(df, c, "family", limit=limit).collect()}
    cents = [(r["family"], np.array(r["c"])) for r in c.collect()]
    for i, v in rows:
        if v is None:
            assert got[i] == (None, None, None)
            continue
        v = np.array(v)
        sims = sorted((-round(float(v @ w) / np.linalg.norm(w) / (np.linalg.norm(v) or 1), 6) + 0.0, f) for f, w in cents)
        assert got[i] == (sims[0][1], -sims[0][0], round(sims[1][0] - sims[0][0], 6))
    one = S.nearest_centroid(df, c.limit(1), "family", limit=limit).filter(F.col("id") == 0).first()
    assert one["margin"] == 1.0
