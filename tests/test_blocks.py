"""Evidence reports: missing blocks, first rows, odd cells, and one shuffle for all tables."""

import json

from pyspark.sql import functions as F

from evidar.operators import blocks as B


def test_nested_report(spark, tmp_path):
    knn = spark.createDataFrame([("p1", 'G"H1', 0.5, 1.0, None, 2), ("p1", "late", 0.1, 0.0, 0.0, 9), ("p2", "GH2", 1.0, 1.0, 0.25, 1), (None, "GH3", 1.0, 1.0, 1.0, 1)], "id string, family string, confidence double, purity double, margin double, pos int")
    domain = spark.createDataFrame([("p1", "PF2", "Two", 50, 90, "1e-3", 8.5), ("p1", "PF1", "One", 5, 40, "1e-9", 20.0), ("p9", "PF1", "One", 5, 40, "1e-9", 20.0)], "id string, acc string, name string, start int, end int, evalue string, score double")
    fusion = spark.createDataFrame([("p1", 'G"H1', 0.2, 1, "not json")], "id string, family string, confidence double, agreement int, votes string")
    out = B.reports({"knn": knn, "domain": domain, "fusion": fusion}, '{"v":1}')
    got = {r["id"]: json.loads(r["report"]) for r in out.collect()}
    assert set(got) == {"p1", "p2"}  # a domain alone makes no report
    e = got["p1"]["evidence"]
    assert list(e) == ["cazyme_calls", "pfam_domains", "ec_prediction", "structure", "topology_secretion", "localization", "physicochem", "tool_provenance"]
    assert e["cazyme_calls"]["esm_c_heads"] == {"knn": {"predicted_family": 'G"H1', "confidence": 0.5, "neighborhood_purity": 1, "margin": None}}
    assert e["pfam_domains"]["architecture"] == "One - Two" and [d["seq_start"] for d in e["pfam_domains"]["domains"]] == [5, 50]
    f = e["cazyme_calls"]["fusion"]
    assert (f["abstain"], f["agreement"], f["per_method_votes"], f["candidate_families"], f["signals"]) == (True, "1/4", {}, [], [])
    assert got["p1"]["annotation_summary"]["review_level"] == "review" and got["p2"]["annotation_summary"]["review_level"] == "clean"
    assert got["p2"]["evidence"]["pfam_domains"] is None and e["tool_provenance"] == {"v": 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    B.write_reports(out, f"{tmp_path}/reports")
    assert {json.loads(x)["protein_id"] for f in (tmp_path / "reports").glob("part-*") for x in f.read_text().splitlines()} == {"p1", "p2"}


def test_numbers_have_no_exponent(spark):
    """From ten million on, and below a thousandth, as the other engine writes them."""
    cases = {10000000.5: "10000000.5", -90450049.5: "-90450049.5", 123456789012.0625: "123456789012.0625", 4503599627370495.5: "4503599627370495.5", 0.000125: "0.000125", 0.00012345678901234567: "0.00012345678901234567", 12.25: "12.25", 2e7: "20000000", -0.5: "-0.5"}
    got = spark.createDataFrame([(x,) for x in cases], "x double").select("x", B.number(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in got} == cases
