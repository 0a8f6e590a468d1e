"""Redundancy reduction: what goes is like what stands for it, by a plain edit distance."""

import random

import pytest

from evidar.operators import redundancy as D

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutated(s, share, r):
    return "".join(r.choice(LETTERS) if r.random() < share else x for x in s if r.random() > share / 4)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for f in range(12):
        base = "".join(r.choice(LETTERS) for _ in range(r.randint(40, 90)))
        out += [base] + [mutated(base, 0.08, r) for _ in range(5)] + [base[: len(base) // 2]]
    out += [out[0], out[0], "AC", "AC", "", ""] + ["".join(r.choice(LETTERS) for _ in range(60)) for _ in range(10)]
    return list(enumerate(out))


def test_what_goes_is_like_its_representative(spark, rows):
    df = spark.createDataFrame([*rows, (900, None), (None, "ACD")], "id long, s string")
    got = {r["id"]: r for r in D.reduce_redundancy(df, "id", "s", identity=0.7, coverage=0.8, k=4, keys=20).collect()}
    text = dict(rows)
    assert set(got) == set(text)
    kept = {i for i, r in got.items() if r["rep"] == i}
    for i, r in got.items():
        a, b = text[i], text[r["rep"]]
        assert r["rep"] in kept
        assert (-len(b), r["rep"]) <= (-len(a), i)
        assert len(a) >= 0.8 * len(b) and edits(a, b) <= 0.3 * len(b) + 1e-9
        assert r["identity"] == pytest.approx(1 - edits(a, b) / max(1, len(b)), abs=1e-6)
    # Copies never stand side by side, and families of near copies are one or few.
    assert len({text[i] for i in kept}) == len(kept)
    like = sum(edits(text[a], text[b]) <= 0.3 * max(len(text[a]), len(text[b])) and min(len(text[a]), len(text[b])) >= 0.8 * max(len(text[a]), len(text[b])) for a in kept for b in kept if a < b)
    assert like <= 2 and len(kept) < 50


def test_one_key_for_all_makes_no_pairs(spark):
    """A word that all sequences share gives each of them one candidate, not all the others."""
    r = random.Random(1)
    rows = [(i, "MKV" * 5 + "".join(r.choice(LETTERS) for _ in range(30 + i % 7))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s string").selectExpr("id", "s", "char_length(s) as n")
    assert D.candidates(df, 4, 20, 0).count() <= 20 * 300
    hot = df.selectExpr("id", "'MKVMKV' as s", "6 as n")
    assert D.candidates(hot, 4, 20, 0).count() == 299
    assert D.reduce_redundancy(df.filter("false"), "id", "s").count() == 0


def test_keys_are_made_once_and_by_pieces(spark):
    """The written keys are read twice; the words of a piece are those of the whole sequence."""
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, "".join(r.choice(LETTERS + "äß€") for _ in range(n))) for i, n in enumerate([0, 1, 3, 4, 5, 63, 64, 66, 67, 68, 69, 127, 128, 131, 132, 300])]
    df = spark.createDataFrame(rows, "id long, s string").selectExpr("id", "s", "char_length(s) as n")
    words = F.expr("transform(sequence(1, greatest(char_length(s) - 3, 1)), i -> xxhash64(7, substring(s, i, 4)))")
    for x in df.select(D.kmer_keys("s", 4, 20, 7).alias("got"), F.slice(F.array_sort(F.array_distinct(words)), 1, 20).alias("want")).collect():
        assert x["got"] == x["want"]
    plan = D.candidates(df, 4, 20, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
