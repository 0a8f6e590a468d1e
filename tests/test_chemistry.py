"""Chemistry against published values of a sequence, and localization of single cases."""

from pyspark.sql import functions as F

from evidar.functions import chemistry as C
from evidar.operators import localization as L

SEQUENCE = "KVFGRCELAAAMKRHGLDNYRGYSLGNWVCAAKFESNFNTQATNRNTDGSTDYGILQINSRWWCNDGRTPGSRNLCNIPCSALLSSDITASVNCAKKIVSDGNGMNAWVAWRNRCKGTDVQAWIRGCRL"  # lysozyme of the hen
UBIQUITIN = "MQIFVKTLTGKTITLEVEPSDTIENVKAKIQDKEGIPPDQQRLIFAGKQLEDGRTLSDYNIQKESTLHLVLRLRGG"
GLUCAGON = "HSQGTFTSDYSKYLDSRRAQDFVQWLMNT"


def test_published_values(spark):
    df = spark.createDataFrame([(1, SEQUENCE), (2, SEQUENCE.lower() + " *-x"), (3, ""), (4, None), (5, "G"), (6, UBIQUITIN), (7, GLUCAGON)], "i int, s string")
    got = {r["i"]: r for r in C.with_chemistry(df, "s").collect()}
    for i in (1, 2):
        assert abs(got[i]["mass"] - 14313.14) < 0.2 and (round(got[i]["pi"], 2), got[i]["n_residues"]) == (9.32, 129)
        assert got[i]["aromaticity"] == sum(map(SEQUENCE.count, "FWY")) / 129
        assert got[i]["composition"]["L"] == round(100 * SEQUENCE.count("L") / 129, 2)
    # Published masses differ in the second place by the table of masses.
    assert abs(got[6]["mass"] - 8564.8) < 0.2 and round(got[6]["pi"], 2) == 6.56 and abs(got[7]["mass"] - 3482.8) < 0.2
    assert got[3]["mass"] is got[3]["pi"] is got[4]["mass"] is got[4]["composition"] is None
    assert abs(got[5]["mass"] - 75.0666) < 1e-9


def test_instability_of_pairs(spark):
    df = spark.createDataFrame([(1, "AAAC"), (2, "A"), (3, "")], "i int, s string")
    w = spark.createDataFrame([("AA", 2.0)], "pair string, weight double")
    got = {r["id"]: r["instability"] for r in C.instability(df, "i", "s", w).collect()}
    assert got == {1: 10 / 4 * 5.0, 2: 0.0}


def test_localization_ties_conflicts_and_lifting(spark):
    proteins = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None), (5, False)], "id long, s boolean")
    cc = "cellular_component"
    terms = spark.createDataFrame([(1, "GO:0005634", cc), (2, "GO:0005634", cc), (2, "GO:0005737", cc), (5, "X", "Cellular_Component"), (5, "GO:0005634", "molecular_function"), (3, "GO:0", cc)], "id long, term string, category string")
    parents = spark.createDataFrame([("X", "Y"), ("X", "Z"), ("Y", "X"), ("Z", "GO:0005739"), ("GO:0005739", "GO:0005737")], "term string, parent string")
    flat = {r["id"]: (r["localization"], r["confidence"], r["n_terms"]) for r in L.localize(proteins, "id", "s", terms, L.compartments(spark)).collect()}
    assert flat == {1: ("Nucleus", "medium", 1), 2: ("Cytoplasm", "medium", 2), 3: (L.SECRETED, "medium", 0), 4: ("Undetermined", "none", 0), 5: ("Undetermined", "none", 0)}
    up = {r["id"]: r["localization"] for r in L.localize(proteins, "id", "s", terms, L.compartments(spark), parents).collect()}
    assert up[5] == "Mitochondrion" and up[2] == "Cytoplasm"
    assert L.lifted(terms.select("term").filter(F.lit(False)), L.compartments(spark), parents).count() == 0


def test_instability_needs_no_group_of_pairs(spark):
    """Every sequence is weighed where it is read: one row each, also of equal ids, and no shuffle of pairs."""
    df = spark.createDataFrame([(1, "AAC"), (1, "ACA"), (2, "A"), (3, None), (4, "")], "i long, s string")
    w = spark.createDataFrame([("AA", 2.0), ("AC", None)], "pair string, weight double")
    out = C.instability(df, "i", "s", w)
    assert sorted((r["id"], round(r["instability"], 6)) for r in out.collect()) == [(1, 6.666667), (1, 10.0), (2, 0.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(id" not in plan


def test_terms_below_a_chain_do_not_climb_one_by_one(spark, moved):
    """An edge is followed once, however many terms stand below it; cycles end, and the nearest ancestors win, all of them."""
    chain = [(f"C{i}", f"C{i + 1}") for i in range(8)] + [("C8", "GO:0005634")]
    edges = chain + [(f"L{i}", "C0") for i in range(400)] + [("X", "Y"), ("Y", "X"), ("Z", "GO:0005739"), ("Z", "GO:0005764"), ("Z", "C8"), ("GO:0005634", "GO:0005777")]
    parents = spark.createDataFrame(edges, "term string, parent string")
    terms = spark.createDataFrame([(f"L{i}",) for i in range(400)] + [("X",), ("Z",), ("GO:0005634",)], "term string")
    got = []
    n = moved(lambda: got.extend(map(tuple, L.lifted(terms, L.compartments(spark), parents).collect())))
    assert sorted(got) == sorted([(f"L{i}", "Nucleus") for i in range(400)] + [("Z", "Mitochondrion"), ("Z", "Lysosome/Vacuole"), ("GO:0005634", "Nucleus")])
    assert n < 30 * len(edges), n / len(edges)
