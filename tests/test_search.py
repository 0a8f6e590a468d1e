"""Texts within texts against Python's own search."""

import random

import pytest

from evidar.operators import search as S


@pytest.mark.parametrize("few", [S.FEW, 0])
def test_containing_equals_in(spark, monkeypatch, few):
    monkeypatch.setattr(S, "PIECE", 64)
    r = random.Random(3)
    words = ["alpha", "beta", "é", "😀", "x", "gamma delta", "  ", "\n", "aaaa"]
    docs = [(i, "".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (7, "two texts under one id: alphabeta"), (7, "x"), (7, "x"), (None, "alphabeta é")]
    items = [(1, "alpha"), (2, "é"), (3, "alphabeta"), (4, ""), (5, None), (6, "zz"), (7, docs[3][1]), (8, docs[5][1][3:70]), (9, "aaaaaaaaaaaa"), (10, "alpha"), (11, "x"), (12, docs[9][1][-20:] or "none"), (13, "not there at all, " * 5)]
    got = S.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", few=few).collect()
    want = [(d, i) for d, t in docs if t is not None for i, s in items if s is not None and s in t]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_rows(spark):
    docs, items = spark.createDataFrame([(1, "text")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert S.containing(docs, items, "doc_id", "item_id").count() == 0
    assert S.containing(docs.filter("false"), spark.createDataFrame([(1, "t")], "item_id long, text string"), "doc_id", "item_id").count() == 0
