"""Spanning forests and density clusters against plain Python."""

import random

import numpy as np

from evidar.operators import clusters as C
from evidar.operators import similarity as S


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def kruskal(edges):
    edges = sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b})
    best = {}
    for w, a, b in edges:
        best.setdefault((a, b), w)
    parent = {x: x for e in best for x in e}
    out = set()
    for w, a, b in sorted((w, a, b) for (a, b), w in best.items()):
        if find(parent, a) != find(parent, b):
            parent[find(parent, a)] = find(parent, b)
            out.add((a, b, w))
    return out


def parts(edges):
    """The components of some edges, each by its smallest node."""
    parent = {x: x for a, b in edges for x in (a, b)}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    out = {}
    for x in parent:
        out.setdefault(find(parent, x), set()).add(x)
    return out


def brute_clusters(near, ids, smallest, samples, levels):
    """The same definition, by recursion over sets of rows."""
    core = {}
    for q, _, sim, rank in near:
        if rank < samples:
            core[q] = max(core.get(q, 0), round(1 - sim, 6))
    forest = kruskal([(q, r, max(round(1 - sim, 6), core[q], core[r])) for q, r, sim, _ in near])
    lo, hi = min(w for *_, w in forest), max(w for *_, w in forest)
    cuts = sorted({round(lo + (hi - lo) * j / (levels - 1), 9) for j in range(levels)})
    fall = [1 / max(d, 1e-6) - 1 / max(n, 1e-6) for d, n in zip(cuts, [*cuts[1:], 2 * cuts[-1]])]
    at = [{k: v for k, v in parts([(a, b) for a, b, w in forest if w <= d]).items() if len(v) >= smallest} for d in cuts]

    def cluster(j, label):
        """(own, below, clusters below it, rows) of the cluster that ends at level j with this component."""
        own, rows = 0.0, at[j][label]
        while True:
            own += round(len(at[j][label]) * fall[j], 6)
            kids = [k for k in at[j - 1] if k in at[j][label]] if j else []
            if len(kids) == 1:
                j, label = j - 1, kids[0]
                continue
            below = [cluster(j - 1, k) for k in kids]
            return round(own, 6), sum(max(b[0], b[1]) for b in below), below, rows

    labels = {}

    def choose(c, root):
        own, below, kids, rows = c
        if own >= below and not (root and kids):
            labels.update(dict.fromkeys(rows, min(rows)))
        else:
            for k in kids:
                choose(k, False)

    for label in at[-1]:
        choose(cluster(len(cuts) - 1, label), True)
    return {i: labels.get(i) for i in ids}


def test_forest_equals_kruskal(spark):
    r = random.Random(0)
    edges = [(r.randrange(60), r.randrange(60), float(r.randint(1, 9))) for _ in range(200)] + [(100 + i, 101 + i, 1.0) for i in range(30)]
    got = C.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"), C.Steps(spark, "t")).collect()
    assert {tuple(x) for x in got} == kruskal(edges) and len(got) == len(kruskal(edges))


def test_clusters_equal_brute_force(spark):
    r = np.random.RandomState(1)
    centres = r.randn(4, 6) * 2
    rows = [(i, (centres[i % 4] + r.randn(6) * (0.15 + 0.2 * (i % 4))).tolist()) for i in range(90)] + [(200 + i, r.randn(6).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = S.knn(df, df, 8)
    ids = [i for i, _ in rows]
    got = {x["id"]: x["label"] for x in C.density_clusters(near, df, "vec_id", smallest=6, samples=4, levels=8).collect()}
    want = brute_clusters([tuple(x) for x in near.select("q", "r", "sim", "rank").collect()], ids, 6, 4, 8)
    assert got == want
    assert 2 <= len(set(got.values()) - {None}) and None in got.values()


def test_no_rows_and_no_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in C.density_clusters(S.knn(df, df, 3), df, "vec_id").collect()] == [(1, None)]
    near = spark.createDataFrame([], "q long, r long, sim double, rank int")
    assert C.density_clusters(near, df.filter("false"), "vec_id").count() == 0


def test_no_round_sends_a_table_through_the_driver(spark):
    """Tables of the rounds are shuffled however small they look; a broadcast of one would pass the driver in every round."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = lambda: {x.apply(i).executionId(): x.apply(i).physicalPlanDescription() for x in [store.executionsList()] for i in range(x.size())}
    before = set(runs())
    edges = [(i, i + 1 + i % 3, float(i % 5)) for i in range(40)]
    steps = C.Steps(spark, "t")
    assert {tuple(x) for x in C.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"), steps).collect()} == kruskal(edges)
    assert {x["label"] for x in C.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long"), steps).collect()} == {1, 7}
    made = [plan for i, plan in runs().items() if i not in before]
    assert len(made) > 5 and any("SortMergeJoin" in x for x in made)
    assert not any("BroadcastExchange" in x for x in made)


def test_shares_and_the_last_task_give_the_same_forest_and_sets(spark, monkeypatch):
    """With a small limit the rounds and shares do most of the work, with a large one the last task does."""
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80), float(r.randint(1, 9))) for _ in range(400)] + [(200 + i, 201 + i, 1.0) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    want = {(k, x) for k, v in parts([(a, b) for a, b, _ in edges]).items() for x in v}
    for limit in (8, 100, 1 << 18):
        monkeypatch.setattr(C, "LIMIT", limit)
        steps = C.Steps(spark, "t")
        got = C.spanning_forest(df, steps).collect()
        assert {tuple(x) for x in got} == kruskal(edges) and len(got) == len(kruskal(edges))
        assert {(x["label"], x["node"]) for x in C.components(df, steps).collect()} == want
    cut = C.without_cycles(df.selectExpr("a", "b", "w", "a as x", "b as y"), 3).collect()
    assert kruskal([(x["a"], x["b"], x["w"]) for x in cut]) == kruskal(edges) and len(cut) < len(edges)


def test_components_by_level_take_each_edge_once(spark):
    r = random.Random(5)
    edges = [(i, r.randrange(i), r.randrange(4)) for i in range(1, 120)]
    got = C.components_by_level(spark.createDataFrame(edges, "a long, b long, j int"), 4, C.Steps(spark, "t")).collect()
    for j in range(4):
        want = {x: k for k, v in parts([(a, b) for a, b, i in edges if i <= j]).items() for x in v}
        assert {x["node"]: x["label"] for x in got if x["j"] == j} == {x: want.get(x, x) for x in range(120)}
    assert len(got) == 480


def test_long_chains_take_few_jobs(spark):
    """One task names a small graph; by rounds alone a chain of 500 took 94 jobs."""
    spark.sparkContext.setJobGroup("chain", "chain")
    df = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    assert {x["label"] for x in C.components(df, C.Steps(spark, "t")).collect()} == {0}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 20, jobs
