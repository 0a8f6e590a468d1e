"""Evidence reports: all blocks of an item from its tables, nested, one JSON object for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.annotation import confidence_band, signal_span
from .report import ABSTAIN, corrected, review


def text(c: Column) -> Column:
    """A JSON string, or null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def number(c: Column) -> Column:
    """A JSON number, without a fraction where it is whole and without an exponent from 0.0001 on; null where there is none."""
    d = c.cast("double")
    shortest = F.regexp_extract(F.to_json(F.struct(d.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    # A double with a fraction has at most 16 digits before the point; below 0.001 and from 10 million on its shortest form has an exponent.
    plain = F.regexp_replace(shortest.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    return F.when(d.isNull() | F.isnan(d), F.lit("null")).when(d == F.floor(d), F.floor(d).cast("string")).when((F.abs(d) >= 1e-4) & shortest.contains("E"), F.coalesce(plain, shortest)).otherwise(shortest)


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def raw(c: Column, otherwise: str) -> Column:
    """JSON that a cell holds already; what is missing or does not parse becomes ``otherwise``."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.lit(otherwise))


def array(c: Column) -> Column:
    """A JSON array of an array of JSON values."""
    return F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))


def words(c: Column) -> Column:
    """A JSON array of the parts of a comma-joined cell, empty without one."""
    return F.when(c.isNull() | (c == ""), F.lit("[]")).otherwise(array(F.transform(F.split(c, ","), text)))


def obj(fields: dict[str, Column]) -> Column:
    """A JSON object; a null column is a missing block and is written as null."""
    parts = [x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(f'{"," if i else ""}"{k}":'), F.coalesce(v, F.lit("null")))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def col(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _baseline(x):
    called = F.col("recommend").isNotNull() & ~F.col("recommend").isin("", "-")
    return obj({"call": F.when(called, text(F.col("recommend"))).otherwise(F.lit('"no CAZyme call"')), "n_tools_supporting": number(F.col("n_tools")), "dbCAN_hmm": text(F.col("hmm")), "dbCAN_sub": text(F.col("sub")), "DIAMOND": text(F.col("diamond")), "baseline_missed": flag(~called)}), F.when(called, F.col("recommend"))


def _fusion(x):
    n = F.col("agreement")
    return obj({
        "final_family": text(F.col("family")), "confidence": number(F.col("confidence")), "abstain": flag(F.coalesce(F.col("confidence") < ABSTAIN, F.lit(False))), "abstain_threshold": F.lit(str(ABSTAIN)),
        "agreement": F.when(n.isNull(), "null").otherwise(F.concat(F.lit('"'), n.cast("string"), F.lit('/4"'))), "agreement_count": number(n), "candidate_families": words(col(x, "all_families")), "per_method_votes": raw(col(x, "votes"), "{}"), "signals": raw(col(x, "signals"), "[]"),
    }), F.col("family")


def _contrastive(x):
    sub = lambda have, fields: F.when(have.isNotNull() & (have != ""), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]))
    knn = sub(col(x, "knn_pred"), {"contrastive_knn_pred": text(col(x, "knn_pred")), "contrastive_knn_purity": number(col(x, "knn_purity"))})
    cent = sub(col(x, "cent_pred"), {"contrastive_centroid_pred": text(col(x, "cent_pred")), "contrastive_centroid_margin": number(col(x, "cent_margin"))})
    both = F.concat_ws(",", knn, cent)
    signals = F.when(both != "", F.concat(F.lit("{"), both, F.lit("}")))
    return obj({"predicted_family": text(F.col("family")), "confidence": number(F.col("confidence")), "primary_signal": F.lit('"classifier"'), "retrieval_sub_signals": signals}), F.col("family")


def _structure(x):
    y = corrected(F.col("plddt").cast("double"), col(x, "checked_plddt").cast("double"))
    length = F.when(y["stale"], F.coalesce(col(x, "checked_length").cast("double"), F.col("length").cast("double"))).otherwise(F.col("length").cast("double"))
    return obj({"tool": text(F.coalesce("source", F.lit("ESMFold"))), "model": text(col(x, "model")), "mean_plddt": number(y["value"]), "plddt_scale": F.lit('"0-100"'), "length_aa": number(length), "record_was_stale": flag(y["stale"]), "foldseek": raw(col(x, "foldseek"), "null")}), None


def _topology(x):
    span = signal_span(F.col("topology"))
    signal = F.col("has_signal")
    call = F.when(F.coalesce(signal, F.lit(False)), "classically secreted (signal peptide, 0 TM helices)").otherwise("no signal peptide (globular / non-secretory-pathway)")
    at = F.when(span.isNotNull(), F.concat(F.lit("["), span["start"].cast("string"), F.lit(","), span["end"].cast("string"), F.lit("]")))
    return obj({"tool": text(F.coalesce(col(x, "tool"), F.lit("DeepTMHMM"))), "prediction": text(F.col("prediction")), "n_tm_helices": number(F.col("n_tm")), "has_signal_peptide": flag(signal), "signal_peptide_span": at, "topology": text(F.coalesce("topology", F.lit(""))), "secretion_call": text(call)}), None


def _physicochem(x):
    inst = F.col("instability").cast("double")
    stable = F.when(inst < 40, '"stable"').when(inst.isNotNull(), '"unstable"')
    return obj({"molecular_weight_da": number(F.col("mw_da")), "theoretical_pi": number(F.col("pi")), "instability_index": number(inst), "instability_class": stable, "gravy": number(F.col("gravy")), "aromaticity": number(F.col("aromaticity")), "n_glycosylation_sequons": number(col(x, "n_sequons"))}), None


def _plain(**fields):
    """A block whose fields are columns of its table, each as text or as a number ("n:")."""

    def build(x):
        cell = lambda c: number(col(x, c[2:])) if c.startswith("n:") else text(col(x, c))
        return obj({k: cell(c) for k, c in fields.items()}), col(x, "family")

    return build


#: How the row of a table becomes a block: (its JSON, the call that it makes).
BLOCKS = {
    "curated": lambda x: (obj({"curated_families": words(F.col("families")), "novelty_bucket": text(F.col("novelty"))}), None),
    "baseline": _baseline,
    "diamond": lambda x: (obj({"call": text(F.col("family")), "top_percent_identity": number(F.col("identity")), "top_evalue": text(F.col("evalue")), "exact_match_vs_curated": flag(F.coalesce(F.col("exact") == 1, F.lit(False))), "overlap_match_vs_curated": flag(F.coalesce(F.col("overlap") == 1, F.lit(False)))}), None),
    "knn": _plain(predicted_family="family", confidence="n:confidence", neighborhood_purity="n:purity", margin="n:margin"),
    "centroid": _plain(predicted_family="family", confidence="n:confidence", margin="n:margin"),
    "contrastive": _contrastive,
    "fusion": _fusion,
    "domain": lambda x: (obj({"pfam_accession": text(F.col("acc")), "name": text(F.col("name")), "seq_start": number(F.col("start")), "seq_end": number(F.col("end")), "evalue": text(F.col("evalue")), "bitscore": number(F.col("score")), "hmm_coverage": number(col(x, "hmm_coverage"))}), F.col("name")),
    "ec": lambda x: (obj({"ec_number": text(F.col("ec_number")), "confidence": number(F.col("confidence")), "confidence_band": F.when(F.col("confidence").isNotNull(), text(confidence_band(F.col("confidence").cast("double")))), "confidence_type": text(col(x, "confidence_type")), "rank": number(F.col("rank")), "tool": text(F.col("tool"))}), None),
    "structure": _structure,
    "topology": _topology,
    "localization": _plain(localization="localization", confidence="confidence", method="method", basis="basis", sp_prediction="sp_prediction"),
    "physicochem": _physicochem,
}
#: Tables that make an item: it has a report if one of these has it.
CORE = ("knn", "centroid", "contrastive", "fusion")


def reports(tables: dict[str, DataFrame], provenance: str = "{}") -> DataFrame:
    """(id, report): the evidence of every item in one nested JSON object.

    ``tables`` are by the names of BLOCKS, each with ``id``, the block's columns
    and, if the order of equal ids matters, ``pos``: but for domains, which
    stand by start and then pos, the first row of an id is its block.  A table
    that is not given is a block that nobody has.  Rows without an id go.

    Every row becomes its block's JSON where it is read; all tables then meet
    in one shuffle by id, whatever their number, and one aggregation picks or
    gathers the blocks.
    """
    rows = None
    for name, df in tables.items():
        body, call = BLOCKS[name](df)
        at = F.col("pos").cast("double") if "pos" in df.columns else F.lit(0.0)
        first = F.col("start").cast("double") if name == "domain" else F.lit(0.0)
        part = df.select(F.col("id").cast("string").alias("id"), F.lit(name).alias("block"), F.coalesce(first, F.lit(0.0)).alias("a"), at.alias("b"), body.alias("body"), (F.lit(None) if call is None else call).cast("string").alias("call"), col(df, "confidence").cast("double").alias("confidence"), col(df, "agreement").cast("int").alias("agreement"))
        rows = part if rows is None else rows.unionAll(part)
    of = lambda b: F.when(F.col("block") == b, F.struct("a", "b", "body", "call", "confidence", "agreement"))
    known = rows.filter("id is not null").groupBy("id").agg(*[F.min(of(b)).alias(b) for b in BLOCKS if b != "domain"], F.array_sort(F.collect_list(of("domain"))).alias("domain"))
    known = known.filter(" or ".join(f"{b} is not null" for b in CORE))
    body = lambda b: F.col(f"{b}.body")
    n = F.size("domain")
    architecture = F.array_join(F.transform("domain", lambda d: d["call"]), " - ")
    domains = F.when(n > 0, obj({"architecture": text(architecture), "n_domains": n.cast("string"), "domains": array(F.transform("domain", lambda d: d["body"]))}))
    verdict = review([F.col(f"{h}.call") for h in ("knn", "centroid", "contrastive")], F.col("fusion.call"), F.col("fusion.confidence"), F.col("fusion.agreement"), n, F.col("baseline.call"))
    known = known.withColumn("v", verdict)
    some = lambda names: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), body(b)) for k, b in names.items()]), F.lit("}"))  # noqa: E731  blocks that are there
    calls = obj({"sequence_baselines": some({"dbcan3_standalone": "baseline", "diamond_2025ref": "diamond"}), "esm_c_heads": some({h: h for h in ("knn", "centroid", "contrastive")}), "fusion": body("fusion")})
    evidence = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"curated_reference":'), body("curated"), F.lit(",")), F.lit("")), F.lit('"cazyme_calls":'), calls, F.lit(","), *[x for k, v in {"pfam_domains": domains, "ec_prediction": body("ec"), "structure": body("structure"), "topology_secretion": body("topology"), "localization": body("localization"), "physicochem": body("physicochem")}.items() for x in (F.lit(f'"{k}":'), F.coalesce(v, F.lit("null")), F.lit(","))], F.lit(f'"tool_provenance":{provenance}}}'))
    summary = obj({"review_level": text(F.col("v.level")), "majority_family": text(F.col("v.majority")), "n_majority": F.col("v.n_majority").cast("string"), "reasons": array(F.transform("v.reasons", text))})
    return known.select("id", obj({"protein_id": text(F.col("id")), "evidence": evidence, "annotation_summary": summary}).alias("report"))


def write_reports(df: DataFrame, path: str) -> None:
    """One line for each item."""
    df.select(F.col("report").alias("value")).write.mode("overwrite").text(path)
