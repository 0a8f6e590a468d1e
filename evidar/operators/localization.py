"""Where a protein works, derived from terms of an ontology and a signal peptide call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import Steps

#: Terms of cellular components and the compartments that they stand for.
COMPARTMENTS = {
    "GO:0005576": "Extracellular",
    "GO:0005615": "Extracellular",
    "GO:0005737": "Cytoplasm",
    "GO:0005634": "Nucleus",
    "GO:0016020": "Cell membrane",
    "GO:0005886": "Cell membrane",
    "GO:0005739": "Mitochondrion",
    "GO:0005783": "Endoplasmic reticulum",
    "GO:0005794": "Golgi apparatus",
    "GO:0005764": "Lysosome/Vacuole",
    "GO:0005773": "Lysosome/Vacuole",
    "GO:0005777": "Peroxisome",
    "GO:0009986": "Cell membrane",
    "GO:0031012": "Extracellular",
}
SECRETED = "Extracellular (secretory pathway)"


def compartments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMPARTMENTS.items()), "term string, compartment string")


def descended(mapped: DataFrame, parents: DataFrame) -> DataFrame:
    """(term, compartment): of each term of the ontology its own compartments, or those of its nearest ancestors that have one.

    ``parents`` is (term, parent).  Compartments go down, one step a round, to
    the terms that have none yet; a term takes all that reach it in the first
    round that any does, and its edges then go.  So each edge is followed in
    one round only, however many terms stand below it, and cycles end.
    """
    steps = Steps(mapped.sparkSession, "lifted")
    at = steps.save(mapped.filter("term is not null and compartment is not null").select("term", "compartment").distinct())
    left, found = parents.select("term", "parent").filter("term is not null and parent is not null"), []
    while at.limit(1).count():
        found.append(at)
        left = steps.save(left.join(at.select("term").distinct(), "term", "left_anti"))
        at = steps.save(left.join(at.withColumnRenamed("term", "parent"), "parent").select("term", "compartment").distinct())
    out = found[0] if found else at
    for x in found[1:]:
        out = out.unionAll(x)
    return steps.save(out)


def lifted(terms: DataFrame, mapped: DataFrame, parents: DataFrame) -> DataFrame:
    """(term, compartment) of those of ``terms`` that have one, their own or that of their nearest ancestors."""
    return descended(mapped, parents).join(terms.select("term"), "term", "left_semi")


def localize(proteins: DataFrame, id_: str, signal: str, terms: DataFrame, mapped: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(id, localization, confidence, basis, signal, n_terms) of every row of ``proteins`` (id, signal: boolean).

    ``terms`` is (id, term, category); only cellular components count, each row
    once for every compartment of its term.  The most frequent compartment wins
    over the signal peptide, ties go to the first by name.  Without one a
    signal peptide means the secretory pathway; without either nothing is said.
    """
    cc = terms.filter(F.lower("category") == "cellular_component").select(F.col(id_).alias("_id"), "term")
    of = mapped.select("term", "compartment") if parents is None else descended(mapped, parents)
    votes = cc.join(of, "term").groupBy("_id", "compartment").agg(F.count("*").alias("n"))
    best = votes.groupBy("_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "compartment")).alias("b"), F.sum("n").alias("n_terms"))
    x = proteins.join(best, F.col(id_) == F.col("_id"), "left")
    s, cc_call = F.coalesce(F.col(signal), F.lit(False)), F.col("b.compartment")
    known = cc_call.isNotNull()
    confidence = F.when(known, F.when(s | (F.col("n_terms") > 1), "medium").otherwise("low")).when(s, "medium").otherwise("none")
    basis = F.when(known & s, "GO cellular-component terms + signal peptide").when(known, "GO cellular-component terms").when(s, "N-terminal signal peptide (no GO-CC available)").otherwise("no signal peptide and no GO cellular-component evidence")
    call = F.coalesce(cc_call, F.when(s, SECRETED), F.lit("Undetermined"))
    return x.select(id_, call.alias("localization"), confidence.alias("confidence"), basis.alias("basis"), s.alias("signal"), F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"))
