"""Interval joins, overlap resolution and lanes against plain loops."""

import random

from evidar.operators import intervals as I
from evidar.operators import relational as R

NAMES = "k string, i long, s long, e long, w double"


def drawn(n, seed, keys="ab", reach=300, lengths=(1, 2, 5, 20, 90, 400, 5000)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randint(-reach, reach)
        out.append((r.choice(keys), i, s, s + r.randint(0, r.choice(lengths)), float(r.randint(0, 9))))
    return out


def kept(rows, share=0.5):
    out = set()
    for key in {r[0] for r in rows}:
        mine = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[4] is None, r[4] or 0, r[1])):
            _, i, s, e, _ = r
            odd = s is None or e is None or s > e
            if odd or not any(min(e, y) - max(s, x) + 1 > share * min(e - s + 1, y - x + 1) for x, y in mine):
                out.add(i)
                if not odd:
                    mine.append((s, e))
    return out


def lanes(rows, gap=8):
    out = {}
    for key in {r[0] for r in rows}:
        ends = []
        for _, i, s, e, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is None or r[3] is None, r[2] or 0, r[1])):
            if s is None or e is None:
                out[i] = None
                continue
            lane = next((n for n, x in enumerate(ends) if s > x + gap), len(ends))
            ends[lane : lane + 1] = [e]
            out[i] = lane
    return out


ODD = [("a", 900, None, 5, 1.0), ("a", 901, 5, None, 1.0), (None, 902, 1, 50, 3.0), (None, 903, 2, 51, 2.0), ("a", 904, 3, 60, None)]
CASES = {"dense": drawn(150, 1), "random": drawn(200, 2, reach=4000), "short": drawn(150, 3, keys="abc", lengths=(1, 3)), "chain": [("a", i, 10 * i, 10 * i + 25, float(i % 3)) for i in range(60)], "long over short": [("a", i, 50 * i, 50 * i + 9, float(i % 7)) for i in range(60)] + [("a", 100 + i, 7 * i, 2900 + i, 3.5 if i else 0.5) for i in range(20)]}


def test_rounds_equal_the_fold(spark):
    """All cases at once, each with keys of its own; equal rows and an empty table besides."""
    rows = [(f"{case} {k}", 10_000 * n + i, s, e, w) for n, (case, found) in enumerate(CASES.items()) for k, i, s, e, w in found] + ODD
    df = spark.createDataFrame([*rows, ("twice", 1, 1, 9, 0.0), ("twice", 1, 1, 9, 0.0), ("twice", 2, 30, 20, 0.0)], NAMES)
    got = [(r["k"], r["i"]) for r in I.resolve_overlaps(df, "k", "i", "s", "e", "w").collect()]
    assert sorted(i for k, i in got if k == "twice") == [1, 2]
    assert {i for k, i in got if k != "twice"} == kept(rows) and len(got) == len(kept(rows)) + 2
    assert {r["i"]: r["lane"] for r in I.pack_lanes(df.filter("k <> 'twice' or k is null"), "k", "i", "s", "e").collect()} == lanes(rows)
    empty = df.filter("false")
    assert I.resolve_overlaps(empty, "k", "i", "s", "e", "w").count() == 0 and I.pack_lanes(empty, "k", "i", "s", "e").count() == 0


def test_another_share(spark):
    rows = drawn(80, 7)
    assert {r["i"] for r in I.resolve_overlaps(spark.createDataFrame(rows, NAMES), "k", "i", "s", "e", "w", share=0.9).collect()} == kept(rows, 0.9)


def test_a_round_sends_an_open_row_to_few_bins(spark, moved):
    """Rows of about the same length: what is shuffled is some records for each row, not a dozen for each row and round."""
    r = random.Random(3)
    rows = [(f"k{i % 40}", i, s := r.randint(0, 2_000_000), s + 21_600 + 3600 * (i % 7), float(r.randint(0, 200))) for i in range(2_000)]
    df = spark.createDataFrame(rows, NAMES)
    got = []
    n = moved(lambda: got.extend(I.resolve_overlaps(df, "k", "i", "s", "e", "w").collect()))
    assert {x["i"] for x in got} == kept(rows)
    assert n < 25 * len(rows), n / len(rows)


def test_pairs_are_found_once(spark):
    rows = drawn(150, 20) + [("a", 500, -(10**12), 10**12, 0.0), ("b", 501, 10**15, 10**15, 0.0)] + ODD[:2]
    df = spark.createDataFrame(rows, NAMES)
    got = [(r["a"], r["b"]) for r in I.overlapping_pairs(df, "k", "i", "s", "e").collect()]
    fine = [r for r in rows if r[2] is not None and r[3] is not None and r[2] <= r[3]]
    want = {(a[1], b[1]) for a in fine for b in fine if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_interval_is_one_row(spark):
    """No side of the join has more than three rows for each row and level of the other side."""
    rows = [("a", 0, 0, 10**9, 0.0)] + [("a", i, i * 1000, i * 1000 + 3, 0.0) for i in range(1, 400)]
    df = spark.createDataFrame(rows, NAMES)
    pairs = I.overlapping_pairs(df, "k", "i", "s", "e")
    assert pairs.count() == 399
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_many_focal_rows_on_one_contig(spark):
    rows = drawn(200, 31, keys="a")
    df = spark.createDataFrame(rows, NAMES)
    focal = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows[:40]], "k string, focal_id long, focal_start long, focal_end long")
    got = [(r["focal_id"], r["i"], r["place"]) for r in R.neighbourhood(df, focal, ["k"], "s", "e", "i", 25, 7).collect()]
    want = []
    for f in rows[:40]:
        near = sorted((r[2], r[1]) for r in rows if r[3] >= f[2] - 25 and r[2] <= f[3] + 25)[:7]
        want += [(f[1], i, n) for n, (_, i) in enumerate(near, 1)]
    assert sorted(got) == sorted(want)
