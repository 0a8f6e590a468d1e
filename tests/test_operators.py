"""Operators against plain Python, with ties and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidar.functions import annotation as A
from evidar.operators import evidence, folds, intervals, metrics, relational, similarity


def one(spark, expr, **values):
    return spark.range(1).select(expr(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first()["x"]


@pytest.mark.parametrize(("cell", "families"), [("GH13_31(12-390)", ["GH13"]), ("CBM48(20-70)+GH9(80-820)", ["CBM48", "GH9"]), ("gh5+GH5", ["GH5"]), ("", [])])
def test_families_in_cell(spark, cell, families):
    assert one(spark, lambda c: A.families_in_cell(c), c=cell) == families


def test_null_tokens_differ_by_dialect(spark):
    assert one(spark, lambda c: A.cleaned(c, "overview"), c="na") == "na"
    assert one(spark, lambda c: A.cleaned(c, "advanced"), c=" NaN ") is None
    assert one(spark, lambda c: A.whole(c), c="3.0") == 3
    assert one(spark, lambda c: A.whole(c), c="nan") is None


def test_sequence_functions(spark):
    assert one(spark, lambda c: A.sequons(c), c="NASNNTS") == 3 and one(spark, lambda c: A.sequons(c, False), c="NASNNTS") == 2
    assert one(spark, lambda c: A.sequons(c), c="NPSNAT") == 1
    assert one(spark, lambda c: A.sanitized(c), c="mkU*") == "MKX"
    assert one(spark, lambda c: A.wrapped(c, 3), c="abcdefg") == "abc\ndef\ng"
    assert abs(one(spark, lambda c: A.gravy(c), c="AR") - (1.8 - 4.5) / 2) < 1e-9
    assert one(spark, lambda c: A.signal_window(c, width=3), c="AAAIIIAIII").asDict() == {"start": 4, "mean": 4.5}
    assert one(spark, lambda c: A.signal_window(c), c="AAX") is None and one(spark, lambda c: A.has_signal(c), c="AA") is False
    # The best window counts, and it starts too late here, though one before it would be high enough.
    assert one(spark, lambda c: A.has_signal(c), c="M" + "A" * 15 + "I" * 9) is False and one(spark, lambda c: A.has_signal(c), c="MK" + "I" * 9) is True
    assert one(spark, lambda a, b: A.ec_agreement(a, b), a="EC:3.2.1.4", b="3.2.1.4") == "exact"
    assert one(spark, lambda a, b: A.ec_agreement(a, b), a="", b="3.2.1.4") == "incomparable" and one(spark, lambda a, b: A.ec_agreement(a, b), a="-", b="3.2") == "different"
    assert one(spark, lambda c: A.confidence_band(c.try_cast("double")), c="x") is None and one(spark, lambda c: A.confidence_band(c), c=0.05) == "LOW"
    assert one(spark, lambda c: A.location(c, F.lit(1234), F.lit(5678), F.lit(None).cast("string")), c="c1") == "c1:1,234-5,678 (.)"
    assert one(spark, lambda c: A.family_link(c), c="gh5_4").endswith("/gh5_4.html") and one(spark, lambda c: A.family_link(c), c="dockerin1") and one(spark, lambda c: A.family_link(c), c="PF1") is None
    assert one(spark, lambda c: A.resistance_link(c), c="aro:3000001").endswith("/3000001") and one(spark, lambda c: A.signature_link(c, F.lit("G3D:1")), c="Gene3D").endswith("/cathgene3d/G3D:1/")
    assert one(spark, lambda a, b: A.ec_agreement(a, b), a="3.2.1.4", b="3.2.1.8") == "class3"


def test_evidence_scores(spark):
    assert one(spark, lambda e, c: evidence.saturating(e, c), e=1e-20, c=2.0) == pytest.approx(1.0)
    assert one(spark, lambda e: evidence.saturating(e, F.lit(None).cast("double")), e=1e-20) == 0.0


def test_overlapping_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), i, s := rng.randint(0, 300), s + rng.randint(0, 90)) for i in range(120)]
    got = intervals.overlapping_pairs(spark.createDataFrame(rows, "k int, i int, s int, e int"), "k", "i", "s", "e").collect()
    want = {(k, a, b) for k, a, s, e in rows for q, b, x, y in rows if k == q and a < b and s <= y and x <= e}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_ranking_metrics_with_ties(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auroc(df, "s", F.col("y")).first()[0] == pytest.approx(want)
    ap, tp, k = 0.0, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        p = pos.count(s)
        tp, k = tp + p, k + p + neg.count(s)
        ap += p * tp / k
    assert metrics.average_precision(df, "s", F.col("y")).first()[0] == pytest.approx(ap / len(pos))


def test_conformal_quantile_takes_the_higher(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "s double")
    want = float(np.quantile([1, 2, 3, 4], min(np.ceil(5 * 0.5) / 4, 1.0), method="higher"))
    assert metrics.conformal_quantile(df, "s", [0.5]).first()["quantile"] == want


def test_knn_and_vote(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(60, 8))
    labels = rng.randint(0, 3, 60)
    df = spark.createDataFrame([(i, v.tolist(), str(c)) for i, (v, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, family string")
    near = similarity.knn(df, df, 5, block=16)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    got = {}
    for r in near.collect():
        got.setdefault(r["q"], []).append((r["rank"], r["r"]))
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [r for _, r in sorted(got[i])] == order
    votes = {r["q"]: r["family"] for r in similarity.vote(near, df.select(F.col("vec_id").alias("r"), "family")).collect()}
    for i in range(60):
        names = [str(labels[j]) for _, j in sorted(got[i])]
        assert votes[i] == max(names, key=lambda f: (names.count(f), -names.index(f)))


def test_consensus_denominators(spark):
    votes = spark.createDataFrame([(1, "a", "X", 0.8), (1, "b", None, 0.9), (2, "a", "X", 0.5), (2, "b", "Y", 0.5)], "id int, method string, family string, confidence double")
    present = {r["id"]: r for r in evidence.consensus(votes, {"a": 0.5, "b": 0.5}, True, 0.3).collect()}
    all_ = {r["id"]: r for r in evidence.consensus(votes, {"a": 0.5, "b": 0.5}, False, 0.3).collect()}
    assert (present[1]["score"], all_[1]["score"]) == (0.8, 0.4)
    assert present[2]["family"] is None and present[2]["score"] == 0.25


def test_overlap_resolution_and_lanes(spark):
    rows = [("p", 1, 1, 100, 0.1), ("p", 2, 40, 140, 0.2), ("p", 3, 90, 200, 0.3), ("q", 4, 5, 9, 0.0)]
    df = spark.createDataFrame(rows, "k string, i int, s int, e int, w double")
    assert {r["i"] for r in intervals.resolve_overlaps(df, "k", "i", "s", "e", "w").collect()} == {1, 3, 4}
    assert {r["i"]: r["lane"] for r in intervals.pack_lanes(df, "k", "i", "s", "e").collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


def test_sampling_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    a = folds.stratified_sample(df.repartition(7), "g", "id", 10, "s").collect()
    b = folds.stratified_sample(df.coalesce(1), "g", "id", 10, "s").collect()
    assert sorted(r["id"] for r in a) == sorted(r["id"] for r in b) and len(a) == 30
    assert folds.quota_sample(df, "g", "id", {}, 20, "s").count() == 20
    assert sorted(spark.range(1).select(folds.shuffled_letters(F.lit("AABC")).alias("x")).first()["x"]) == list("AABC")


def test_containing_finds_items_of_any_length(spark):
    from evidar.operators import search

    texts = ["a b c d e f, g", "xa b c", "one", " lead word here", "", "the whole thing in one", "aXb cYd"]
    items = ["a b c d e f", "b", "", "a b", " lead", "one", "n", "X", "b c", None, "word here", "e whole thing in on"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    its = spark.createDataFrame([*enumerate(items), (50, "one")], "item_id long, text string")
    for few in (1000, 0):
        got = sorted(map(tuple, search.containing(docs, its, "doc_id", "item_id", few=few).collect()))
        assert got == sorted((i, j) for i, t in enumerate(texts) for j, x in [*enumerate(items), (50, "one")] if x is not None and x in t)


def test_folds_at_islands_equal_folds_of_whole_keys(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 2), i, s := rng.randint(0, 3000), s + rng.randint(0, 60), rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, s int, e int, w double")
    kept, lanes = set(), {}
    for k in range(3):
        own, ends = [], []
        for _, i, s, e, w in sorted((r for r in rows if r[0] == k), key=lambda r: (r[4], r[1])):
            if all(min(e, y) - max(s, x) + 1 <= 0.5 * min(e - s + 1, y - x + 1) for x, y in own):
                own.append((s, e))
                kept.add(i)
        for _, i, s, e, w in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            lane = next((n for n, x in enumerate(ends) if s > x + 8), len(ends))
            ends[lane : lane + 1] = [e]
            lanes[i] = lane
    assert {r["i"] for r in intervals.resolve_overlaps(df, "k", "i", "s", "e", "w").collect()} == kept
    assert {r["i"]: r["lane"] for r in intervals.pack_lanes(df, "k", "i", "s", "e").collect()} == lanes
    touching = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 18, 20), (1, 3, 19, 30)], "k int, i int, s int, e int")
    assert {r["i"]: r["lane"] for r in intervals.pack_lanes(touching, "k", "i", "s", "e").collect()} == {1: 0, 2: 1, 3: 0}


def test_headers_helices_and_lookups(spark):
    f = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, lambda c: A.header_id(f("A1", "x1", "g.fasta", "GH5")), c="") == "x1" and one(spark, lambda c: A.header_id(f("A1", "GH5")), c="") == "A1"
    assert one(spark, lambda c: A.header_id(f("g.fasta", "GH5")), c="") == "g.fasta"
    assert one(spark, lambda c: A.header_families(f("A1", "GH5_4", "GH5_4", "XX1", "CBM1")), c="") == ["GH5_4", "CBM1"]
    rng = random.Random(3)
    for n in (0, 17, 18, 19, 120):
        seq = "".join(rng.choice("AILVKDEGST") for _ in range(n))
        want, i = [], 0
        while i < len(seq) - 18:
            if sum(c in "AILMFVWC" for c in seq[i : i + 18]) >= 8:
                want.append(i + 1)
                i += 18
            else:
                i += 1
        assert one(spark, lambda c: A.hydrophobic_helices(c, least=8), c=seq) == want


def test_logistic_models(spark):
    from evidar.operators import models

    rng = np.random.RandomState(1)
    v = rng.normal(size=(200, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = (v[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, v[i].tolist(), int(y[i])) for i in range(200)], "i long, v array<double>, y int")
    m = models.gate(df, "v", "y")
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(v @ w + b)))
    # At the optimum of the sum of losses plus half the squared weights the gradient is zero.
    assert np.abs(v.T @ (p - y) + w).max() < 0.05 and abs((p - y).sum()) < 0.05
    assert np.allclose([r["score"] for r in models.gate_scores(m, df, "i", "v").orderBy("i").collect()], p)
    x = df.select("i", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"), "y")
    out = models.novelty_scores(x, "i", ["a", "b"], "y").collect()
    s = np.array([r["score"] for r in sorted(out, key=lambda r: r["i"])])
    assert len(out) == 200 and np.mean((s > 0.5) == y) > 0.75 and len({r["fold"] for r in out}) == 5
