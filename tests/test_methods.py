"""The dimension of methods: names, flags and readers by a row."""

import json

from pyspark.sql import functions as F

from evidar.functions import methods as M
from evidar.sources import readers


def test_unknown_and_missing_tools(spark):
    df = spark.createDataFrame([("SaProt",), ("saprot",), ("mine",), (None,)], "tool string")
    got = {r["tool"]: (r["method_display"], r["method_family"], r["is_advanced"], r["method_place"]) for r in M.with_methods(df, "tool", M.registry(spark, [("mine", "Mine", "advanced", "hmm", "sequence", "#000000", 30, "q", "f", "c", ["x"])])).collect()}
    assert got == {"SaProt": ("SaProt", "advanced", True, 24), "saprot": ("saprot", "unknown", False, 999), "mine": ("Mine", "advanced", True, 30), None: ("—", "unknown", False, 999)}
    assert M.feature_tools(spark).count() == 8


def test_a_new_method_is_one_row(spark, tmp_path):
    (tmp_path / "new.tsv").write_text('q\tf\tc\tx\ty\nP1\tGH5;GH7\t0.25\t[1, 2]\t9\nP2\t-\t\t007\t9\n-\tGH1\t1\t\t9\nP3\tGH9\tn/a\tnote "a"\t9\n')
    methods = M.registry(spark, [("mine", "Mine", "advanced", "hmm", "sequence", "#000000", 30, "q", "f", "c", ["x", "absent"])])
    got = {r["protein_id"]: r for r in readers.method_predictions(spark, str(tmp_path / "new.tsv"), "mine", methods).collect()}
    assert {k: (r["family"], r["confidence"], r["all_families"]) for k, r in got.items()} == {"P1": ("GH5", 0.25, "GH5,GH7"), "P2": (None, None, None), "P3": ("GH9", None, None)}
    assert {k: json.loads(r["extra"]) for k, r in got.items()} == {"P1": {"x": [1, 2]}, "P2": {"x": 7}, "P3": {"x": 'note "a"'}}
    over = readers.method_predictions(spark, str(tmp_path / "new.tsv"), "not registered", methods, id_="q", family="y", confidence="c").filter("protein_id = 'P1'").first()
    assert (over["family"], over["confidence"], over["extra"]) == ("9", 0.25, "{}")


def test_json_values(spark):
    cells = ['{"a": 1}', "[1", "12", "-3", "0.50", "1e3", "nan", "Infinity", "x y", 'say "no"', "", "-", None, "é\t"]
    got = [r["v"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", M.json_value(F.col("c")).alias("v")).orderBy("i").collect()]
    assert [None if v is None else json.loads(v) for v in got] == [{"a": 1}, "[1", 12, -3, 0.5, 1000.0, "nan", "Infinity", "x y", 'say "no"', None, None, None, "é\t"]
