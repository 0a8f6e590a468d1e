"""Chemistry of sequences and where proteins work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotation as A
from ..functions import chemistry as C
from ..operators import localization as L
from ..tables import table as t
from .registry import query

N = {k: f"(length(s) - length(replace(s, '{k}', '')))" for k in C.LETTERS}
ENDS = {"f": (C.N_ENDS, C.N_END, "left(s, 1)"), "l": (C.C_ENDS, C.C_END, "right(s, 1)")}
END = {k: f"CASE {where} " + " ".join(f"WHEN '{x}' THEN {v}" for x, v in m.items()) + f" ELSE {other} END::DOUBLE" for k, (m, other, where) in ENDS.items()}


def charge(ph: str) -> str:
    up = lambda pk: f"1 / (1 + pow(10.0::DOUBLE, {ph} - {pk}))"
    down = lambda pk: f"1 / (1 + pow(10.0::DOUBLE, {pk} - {ph}))"
    return "(" + " + ".join([up("f"), *(f"n{k} * {up(v)}" for k, v in C.POSITIVE.items())]) + " - " + " - ".join([down("l"), *(f"n{k} * {down(v)}" for k, v in C.NEGATIVE.items())]) + ")"


CHARGED = ", ".join(f"{N[k]} AS n{k}" for k in [*C.POSITIVE, *C.NEGATIVE])
LETTER_CLASS = f"'[^{C.LETTERS}]'"
CHEMISTRY = f"""WITH RECURSIVE x AS (SELECT doc_id, regexp_replace(translate(text, '{C.LOWER}', '{C.LOWER.upper()}'), {LETTER_CLASS}, '', 'g') AS s FROM documents),
c AS (SELECT doc_id, s, {END['f']} AS f, {END['l']} AS l, {CHARGED} FROM x WHERE length(s) > 0),
h AS (SELECT *, {C.FIRST}::DOUBLE AS ph, {C.LOW}::DOUBLE AS lo, {C.HIGH}::DOUBLE AS hi FROM c
UNION ALL SELECT * REPLACE ((a + b) / 2 AS ph, a AS lo, b AS hi) FROM (SELECT * EXCLUDE (u, a, b), CASE WHEN u > 0 THEN ph ELSE lo END AS a, CASE WHEN u > 0 THEN hi ELSE ph END AS b FROM (SELECT *, {charge('ph')} AS u, 0 AS a, 0 AS b FROM h WHERE hi - lo > {C.WIDTH})) z)
SELECT x.doc_id, length(x.s) AS n_residues, round(CASE WHEN length(x.s) > 0 THEN {' + '.join(f"{N[k].replace('(s', '(x.s')} * {v}::DOUBLE" for k, v in C.MASS.items())} - (length(x.s) - 1) * {C.WATER}::DOUBLE END, 2) AS mass, round(({'+'.join(N[k].replace('(s', '(x.s') for k in 'FWY')}) / nullif(length(x.s), 0), 4) AS aromaticity, round(p.ph, 2) AS pi
FROM x LEFT JOIN (SELECT doc_id, ph FROM h WHERE hi - lo <= {C.WIDTH}) p ON p.doc_id = x.doc_id"""
# Columns a and b stand twice in the recursion above only to be replaced.
CHEMISTRY = CHEMISTRY.replace("SELECT * REPLACE ((a + b) / 2 AS ph, a AS lo, b AS hi) FROM (SELECT * EXCLUDE (u, a, b), CASE", "SELECT * EXCLUDE (a, b) REPLACE ((a + b) / 2 AS ph, a AS lo, b AS hi) FROM (SELECT * EXCLUDE (u), CASE").replace(" AS u, 0 AS a, 0 AS b FROM h", " AS u FROM h")


@query("sequence_chemistry", CHEMISTRY)
def sequence_chemistry(spark, d):
    x = C.with_chemistry(t(spark, d, "documents").select("doc_id", F.col("text").alias("seq")), "seq")
    return x.select("doc_id", F.col("n_residues").cast("long").alias("n_residues"), F.round("mass", 2).alias("mass"), F.round("aromaticity", 4).alias("aromaticity"), F.round("pi", 2).alias("pi"))


@query("dipeptide_instability", """WITH w AS (SELECT chr(CAST(65 + p_partkey % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey // 26) % 26 AS INTEGER)) AS pair, min(p_size) / 8.0::DOUBLE AS weight FROM part GROUP BY 1),
x AS (SELECT c_custkey AS id, regexp_replace(translate(c_name || c_mktsegment, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM customer), y AS (SELECT id, s, unnest(generate_series(1, length(s) - 1)) AS i FROM x)
SELECT id, round(10 / length(s) * sum(coalesce(weight, 1.0)), 4) AS instability FROM y LEFT JOIN w ON pair = substr(s, i, 2) GROUP BY id, s""")
def dipeptide_instability(spark, d):
    """The weights are made of a table here; a user gives the published one."""
    letter = lambda x: F.char((65 + F.floor(x) % 26).cast("long"))
    w = t(spark, d, "part").groupBy(F.concat(letter(F.col("p_partkey")), letter(F.col("p_partkey") / 26)).alias("pair")).agg((F.min("p_size") / 8.0).alias("weight"))
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.residues(F.concat("c_name", "c_mktsegment")).alias("s"))
    return C.instability(x, "id", "s", w).select("id", F.round("instability", 4).alias("instability"))


@query("localization_by_evidence", f"""WITH RECURSIVE m(term, compartment) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in L.COMPARTMENTS.items())}),
mm AS (SELECT term, compartment, row_number() OVER (ORDER BY term) - 1 AS i FROM m),
e AS (SELECT 'T' || p_partkey AS term, CASE WHEN p_partkey % 3 = 0 THEN (SELECT term FROM mm WHERE i = p_size % 14) ELSE 'T' || (p_partkey // 2) END AS parent FROM part WHERE p_partkey % 5 > 0),
g AS (SELECT l_orderkey AS id, 'T' || l_partkey AS term, CASE WHEN l_returnflag = 'R' THEN 'molecular_function' ELSE 'Cellular_Component' END AS category FROM lineitem),
up AS (SELECT DISTINCT term, term AS here, 0 AS h FROM g WHERE category <> 'molecular_function' UNION SELECT up.term, e.parent, h + 1 FROM up JOIN e ON e.term = up.here WHERE h < 40),
first AS (SELECT up.term, min(h) AS h FROM up JOIN m ON m.term = up.here GROUP BY up.term),
lift AS (SELECT DISTINCT up.term, m.compartment FROM up JOIN first USING (term, h) JOIN m ON m.term = up.here),
v AS (SELECT id, compartment, count(*) AS n FROM g JOIN lift USING (term) WHERE category <> 'molecular_function' GROUP BY ALL),
b AS (SELECT id, arg_min(compartment, (-n, compartment)) AS c, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY id), p AS (SELECT o_orderkey AS id, o_orderpriority LIKE '1%' AS s FROM orders)
SELECT p.id, coalesce(c, CASE WHEN s THEN 'Extracellular (secretory pathway)' ELSE 'Undetermined' END) AS localization, CASE WHEN c IS NOT NULL THEN CASE WHEN s OR n > 1 THEN 'medium' ELSE 'low' END WHEN s THEN 'medium' ELSE 'none' END AS confidence, s AS signal, coalesce(n, 0) AS n_terms FROM p LEFT JOIN b ON b.id = p.id""")
def localization_by_evidence(spark, d):
    """Terms that stand for no compartment climb to their nearest ancestors that do."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in sorted(L.COMPARTMENTS)])
    parent = F.when(k % 3 == 0, F.element_at(names, (F.col("p_size") % 14 + 1).cast("int"))).otherwise(F.concat(F.lit("T"), F.floor(k / 2).cast("string")))
    edges = t(spark, d, "part").filter("p_partkey % 5 > 0").select(F.concat(F.lit("T"), k.cast("string")).alias("term"), parent.alias("parent"))
    terms = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("term"), F.when(F.col("l_returnflag") == "R", "molecular_function").otherwise("Cellular_Component").alias("category"))
    proteins = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").like("1%").alias("s"))
    return L.localize(proteins, "id", "s", terms, L.compartments(spark), edges).drop("basis")


@query("sequence_marks", "WITH x AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents) SELECT doc_id, md5(upper(s)) AS digest, round(length(regexp_replace(s, '[^aeiou]', '', 'g')) / nullif(length(s), 0), 6) AS vowels FROM x")
def sequence_marks(spark, d):
    """The digest of a sequence and the share of some letters in it."""
    s = F.regexp_replace("text", "[^A-Za-z]", "")
    return t(spark, d, "documents").select("doc_id", A.sequence_key(s).alias("digest"), F.round(A.share_of(s, "aeiou"), 6).alias("vowels"))
