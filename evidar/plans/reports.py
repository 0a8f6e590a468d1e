"""The evidence report of every order, from tables that are made of the orders, their lines and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks
from ..tables import table as t
from .registry import query

#: Rows of each block: a condition, and its columns by expressions that both engines read; k is the order, c its customer.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "curated": ("k % 9 = 0", {"families": "case when k % 2 = 0 then 'GH1,GH2' end", "novelty": "concat('n', k % 3)"}),
    "baseline": ("k % 2 = 0", {"recommend": "case when k % 8 = 0 then '-' else concat('GH', c % 4) end", "n_tools": "k % 4", "hmm": "concat('GH', c % 4, '(1-9)')", "sub": "case when k % 3 > 0 then 'GH1_e1' end", "diamond": "'say \"x\"'"}),
    "diamond": ("k % 7 > 0", {"family": "concat('GH', c % 5)", "identity": "cast(k % 100 as double) / 8", "evalue": "'1e-30'", "exact": "k % 2", "overlap": "1"}),
    "knn": ("k % 5 > 0", {"family": "concat('GH', c % 4)", "confidence": "cast(c % 8 as double) / 8", "purity": "cast(c % 4 as double) / 4", "margin": "0.25"}),
    "centroid": ("k % 4 > 0", {"family": "concat('GH', c % 3)", "confidence": "cast(k % 8 as double) / 8", "margin": "cast(k % 2 as double)"}),
    "contrastive": ("k % 3 > 0", {"family": "concat('GH', k % 4)", "confidence": "0.5", "knn_pred": "case when k % 2 = 0 then 'GH1' end", "knn_purity": "0.5", "cent_pred": "case when k % 5 = 0 then 'GH9' else '' end", "cent_margin": "0.125"}),
    "fusion": ("k % 6 > 0", {"family": "concat('GH', c % 4)", "confidence": "cast(k % 16 as double) / 16", "agreement": "k % 5", "all_families": "case when k % 2 = 1 then 'GH1,GH2' end", "votes": "case when k % 3 > 0 then '{\"knn\":\"GH1\"}' else 'broken' end", "signals": "case when k % 2 > 0 then '[\"sequence\",\"structure\"]' end"}),
    "ec": ("k % 5 = 1", {"ec_number": "concat('3.2.1.', c)", "confidence": "cast(k % 8 as double) / 8", "rank": "1", "tool": "'CLEAN'"}),
    "structure": ("k % 2 = 1", {"source": "case when k % 3 = 0 then 'AFDB' end", "plddt": "cast(c % 100 as double)", "length": "300", "checked_plddt": "case when k % 5 = 0 then cast(c % 100 as double) + 0.5 end", "checked_length": "301"}),
    "topology": ("k % 4 < 2", {"prediction": "'SP'", "n_tm": "k % 3", "topology": "case when k % 2 = 0 then 'signal:1-20|outside:21-90' else 'outside:1-9' end", "has_signal": "k % 2 = 0"}),
    "localization": ("k % 3 = 1", {"localization": "'Extracellular'", "confidence": "'0.9'", "method": "'derived-from-SP'", "basis": "'signalp'", "sp_prediction": "case when k % 2 = 0 then 'SP' end"}),
    "physicochem": ("k % 5 < 3", {"mw_da": "cast(c as double) * 100.5", "pi": "5.25", "instability": "cast(k % 80 as double)", "gravy": "-0.5", "aromaticity": "0.125", "n_sequons": "k % 4"}),
}
DOMAIN = {"acc": "concat('PF', l_partkey)", "name": "concat('D', l_suppkey)", "start": "l_partkey", "end": "l_partkey + 99", "evalue": "'1e-5'", "score": "l_quantity + 0.5", "hmm_coverage": "0.75"}
PROVENANCE = '{"pipeline":"evidence","tools":["a","b"]}'


def num(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST(CAST({c} AS DOUBLE) AS VARCHAR) END"


def txt(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR) END"


def yes(c: str) -> str:
    return f"CASE WHEN {c} THEN 'true' ELSE 'false' END"


def lst(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '[]' ELSE CAST(to_json(string_split({c}, ',')) AS VARCHAR) END"


def obj(**fields: str) -> str:
    return "('{' || " + " || ',' || ".join(f"'\"{k}\":' || coalesce({v}, 'null')" for k, v in fields.items()) + " || '}')"


BODY = {
    "curated": obj(curated_families=lst("families"), novelty_bucket=txt("novelty")),
    "baseline": obj(call="CASE WHEN recommend = '-' THEN '\"no CAZyme call\"' ELSE " + txt("recommend") + " END", n_tools_supporting=num("n_tools"), dbCAN_hmm=txt("hmm"), dbCAN_sub=txt("sub"), DIAMOND=txt("diamond"), baseline_missed=yes("recommend = '-'")),
    "diamond": obj(call=txt("family"), top_percent_identity=num("identity"), top_evalue=txt("evalue"), exact_match_vs_curated=yes("exact = 1"), overlap_match_vs_curated=yes("overlap = 1")),
    "knn": obj(predicted_family=txt("family"), confidence=num("confidence"), neighborhood_purity=num("purity"), margin=num("margin")),
    "centroid": obj(predicted_family=txt("family"), confidence=num("confidence"), margin=num("margin")),
    "contrastive": obj(predicted_family=txt("family"), confidence=num("confidence"), primary_signal="'\"classifier\"'", retrieval_sub_signals="CASE WHEN knn_pred IS NOT NULL OR cent_pred <> '' THEN '{' || concat_ws(',', CASE WHEN knn_pred IS NOT NULL THEN '\"contrastive_knn_pred\":' || " + txt("knn_pred") + " || ',\"contrastive_knn_purity\":' || " + num("knn_purity") + " END, CASE WHEN cent_pred <> '' THEN '\"contrastive_centroid_pred\":' || " + txt("cent_pred") + " || ',\"contrastive_centroid_margin\":' || " + num("cent_margin") + " END) || '}' END"),
    "fusion": obj(final_family=txt("family"), confidence=num("confidence"), abstain=yes("confidence < 0.35"), abstain_threshold="'0.35'", agreement="'\"' || agreement || '/4\"'", agreement_count=num("agreement"), candidate_families=lst("all_families"), per_method_votes="CASE WHEN votes = 'broken' THEN '{}' ELSE votes END", signals="coalesce(signals, '[]')"),
    "ec": obj(ec_number=txt("ec_number"), confidence=num("confidence"), confidence_band="CASE WHEN confidence >= 0.5 THEN '\"HIGH\"' WHEN confidence >= 0.05 THEN '\"LOW\"' ELSE '\"VERY_LOW\"' END", confidence_type="'null'", rank=num("rank"), tool=txt("tool")),
    "structure": obj(tool=txt("coalesce(source, 'ESMFold')"), model="'null'", mean_plddt=num("coalesce(checked_plddt, plddt)"), plddt_scale="'\"0-100\"'", length_aa=num("CASE WHEN checked_plddt IS NULL THEN length ELSE checked_length END"), record_was_stale=yes("checked_plddt IS NOT NULL"), foldseek="'null'"),
    "topology": obj(tool="'\"DeepTMHMM\"'", prediction=txt("prediction"), n_tm_helices=num("n_tm"), has_signal_peptide=yes("has_signal"), signal_peptide_span="CASE WHEN has_signal THEN '[1,20]' END", topology=txt("topology"), secretion_call="CASE WHEN has_signal THEN '\"classically secreted (signal peptide, 0 TM helices)\"' ELSE '\"no signal peptide (globular / non-secretory-pathway)\"' END"),
    "localization": obj(localization=txt("localization"), confidence=txt("confidence"), method=txt("method"), basis=txt("basis"), sp_prediction=txt("sp_prediction")),
    "physicochem": obj(molecular_weight_da=num("mw_da"), theoretical_pi=num("pi"), instability_index=num("instability"), instability_class="CASE WHEN instability < 40 THEN '\"stable\"' ELSE '\"unstable\"' END", gravy=num("gravy"), aromaticity=num("aromaticity"), n_glycosylation_sequons=num("n_sequons")),
}
ITEMS = ", ".join(f"t_{b} AS (SELECT k, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM o WHERE {where}), b_{b} AS (SELECT k, {BODY[b]} AS {b} FROM t_{b})" for b, (where, cols) in TABLES.items())
GIVEN = lambda name, b: f"CASE WHEN {b} IS NOT NULL THEN '\"{name}\":' || {b} END"
SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), {ITEMS},
d AS (SELECT l_orderkey AS k, count(*) AS n, string_agg(name, ' - ' ORDER BY start, pos) AS arch, '[' || string_agg({obj(pfam_accession=txt("acc"), name=txt("name"), seq_start=num("start"), seq_end=num('"end"'), evalue=txt("evalue"), bitscore=num("score"), hmm_coverage="'0.75'")}, ',' ORDER BY start, pos) || ']' AS body FROM (SELECT l_orderkey, l_linenumber * 1000 + l_suppkey AS pos, {', '.join(f'{e} AS "{c}"' for c, e in DOMAIN.items())} FROM lineitem WHERE l_linenumber < 4) GROUP BY 1),
j AS (SELECT o.k, {', '.join(f'b_{b}.{b} AS {b}' for b in TABLES)}, n, arch, d.body AS domains, list_filter([t_knn.family, t_centroid.family, t_contrastive.family], lambda x: x IS NOT NULL) AS heads, t_fusion.family AS ff, t_fusion.confidence AS fc, t_fusion.agreement AS fa, CASE WHEN recommend <> '-' THEN recommend END AS base FROM o LEFT JOIN d ON d.k = o.k {' '.join(f'LEFT JOIN b_{b} ON b_{b}.k = o.k' for b in TABLES)} LEFT JOIN t_knn ON t_knn.k = o.k LEFT JOIN t_centroid ON t_centroid.k = o.k LEFT JOIN t_contrastive ON t_contrastive.k = o.k LEFT JOIN t_fusion ON t_fusion.k = o.k LEFT JOIN t_baseline ON t_baseline.k = o.k
  WHERE b_knn.k IS NOT NULL OR b_centroid.k IS NOT NULL OR b_contrastive.k IS NOT NULL OR b_fusion.k IS NOT NULL),
m AS (SELECT *, list_sort(list_distinct(heads)) AS ds, coalesce(list_max(list_transform(list_distinct(heads), lambda v: len(list_filter(heads, lambda w: w = v)))), 0) AS nm FROM j),
v AS (SELECT *, list_filter(ds, lambda v: len(list_filter(heads, lambda w: w = v)) = nm)[1] AS mf FROM m),
r AS (SELECT *, list_filter([CASE WHEN fc < 0.35 THEN 'abstains' END, CASE WHEN len(heads) >= 3 AND len(ds) = len(heads) THEN 'heads_all_differ' END, CASE WHEN fa <= 2 THEN 'low_agreement' END, CASE WHEN nm >= 2 AND ff <> mf THEN 'against_majority' END], lambda x: x IS NOT NULL) AS strong, list_filter([CASE WHEN len(ds) > 1 THEN 'not_unanimous' END, CASE WHEN fc < 0.9 THEN 'below_high_confidence' END, CASE WHEN n > 1 THEN 'several_domains' END, CASE WHEN base <> ff THEN 'baseline_disagrees' END], lambda x: x IS NOT NULL) AS weak FROM v)
SELECT CAST(k AS VARCHAR) AS id, '{{"protein_id":"' || k || '","evidence":{{' || coalesce('"curated_reference":' || curated || ',', '') || '"cazyme_calls":{{"sequence_baselines":{{' || concat_ws(',', {GIVEN('dbcan3_standalone', 'baseline')}, {GIVEN('diamond_2025ref', 'diamond')}) || '}},"esm_c_heads":{{' || concat_ws(',', {GIVEN('knn', 'knn')}, {GIVEN('centroid', 'centroid')}, {GIVEN('contrastive', 'contrastive')}) || '}},"fusion":' || coalesce(fusion, 'null') || '}},"pfam_domains":' || CASE WHEN n > 0 THEN '{{"architecture":"' || arch || '","n_domains":' || n || ',"domains":' || domains || '}}' ELSE 'null' END
|| ',"ec_prediction":' || coalesce(ec, 'null') || ',"structure":' || coalesce(structure, 'null') || ',"topology_secretion":' || coalesce(topology, 'null') || ',"localization":' || coalesce(localization, 'null') || ',"physicochem":' || coalesce(physicochem, 'null') || ',"tool_provenance":{PROVENANCE}}},"annotation_summary":{{"review_level":"' || CASE WHEN len(strong) > 0 THEN 'review' WHEN len(weak) > 0 THEN 'attention' ELSE 'clean' END || '","majority_family":' || coalesce('"' || mf || '"', 'null') || ',"n_majority":' || nm || ',"reasons":' || CAST(to_json(list_concat(strong, weak)) AS VARCHAR) || '}}}}' AS report FROM r"""


@query("evidence_reports", SQL)
def evidence_reports(spark, d):
    """Thirteen tables meet in one shuffle; the whole nested JSON is compared."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    tables = {b: o.filter(where).select(F.col("k").alias("id"), *[F.expr(e).alias(c) for c, e in cols.items()]) for b, (where, cols) in TABLES.items()}
    tables["domain"] = t(spark, d, "lineitem").filter("l_linenumber < 4").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("pos"), *[F.expr(e).alias(c) for c, e in DOMAIN.items()])
    return blocks.reports(tables, PROVENANCE)
