"""Counters with a sample: a table, and a stream that goes on."""

import hashlib

from pyspark.sql import functions as F

from evidar.streaming import counters

ROWS = [(i, "ab"[i % 3 == 0]) for i in range(300)] + [(300, None), (7, "a"), (7, "a")]


def brute(rows, k):
    out = {}
    for i, c in rows:
        out.setdefault(c or "", []).append((hashlib.md5(f"{i}|0".encode()).hexdigest(), str(i)))
    return {c: (len(x), [i for _, i in sorted(x)[:k]]) for c, x in out.items()}


def as_dict(df):
    return {r["class"]: (r["n"], r["sample"]) for r in df.collect()}


def test_counters_of_a_table(spark):
    df = spark.createDataFrame(ROWS, "id long, kind string")
    assert as_dict(counters.counters(df, "kind", "id", 5)) == brute(ROWS, 5)
    assert counters.counters(df.limit(0), "kind", "id", 5).count() == 0


def test_counters_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, kind string")
    take = lambda: counters.count_stream(spark, f"{tmp_path}/in", df.schema.simpleString()[7:-1].replace(":", " "), f"{tmp_path}/out", "kind", "id", 5)
    df.filter("id < 100").write.mode("append").parquet(f"{tmp_path}/in")
    assert as_dict(take()) == brute([r for r in ROWS if r[0] < 100], 5)
    df.filter(F.col("id") >= 100).write.mode("append").parquet(f"{tmp_path}/in")
    assert as_dict(take()) == brute(ROWS, 5)
    assert as_dict(take()) == brute(ROWS, 5)
