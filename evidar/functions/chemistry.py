"""Chemistry of protein sequences in column expressions: mass, charge and isoelectric point, aromaticity, composition, instability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Average masses of free amino acids and of the water that each bond loses.
MASS = {"A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885}
WATER = 18.0153
#: Dissociation constants of side chains and ends (Bjellqvist), and of ends that depend on their residue.
POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_END, C_END = 7.5, 3.55
N_ENDS = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_ENDS = {"D": 4.55, "E": 4.75}
#: The interval that is halved, its first point, and the width at which halving ends.
LOW, FIRST, HIGH, WIDTH = 4.05, 7.775, 12.0, 0.0001
LETTERS = "".join(sorted(MASS))
LOWER = "abcdefghijklmnopqrstuvwxyz"


def residues(sequence: Column) -> Column:
    """The standard amino acids of a sequence in upper case; white space, gaps, stops and other letters go."""
    return F.regexp_replace(F.translate(sequence, LOWER, LOWER.upper()), f"[^{LETTERS}]", "")


def counts(clean: Column) -> dict[str, Column]:
    return {k: F.char_length(clean) - F.char_length(F.regexp_replace(clean, k, "")) for k in LETTERS}


def with_chemistry(df: DataFrame, sequence: str) -> DataFrame:
    """``df`` with residues, n_residues, mass, aromaticity, pi and composition (a map of letter to percent); null where no residue is left.

    The isoelectric point is found by halving: the charge at a pH is a sum over
    the counts of a few residues, so each step costs the same for any length.
    """
    x = df.withColumn("residues", residues(F.col(sequence))).withColumn("n_residues", F.char_length("residues"))
    x = x.withColumn("_n", F.create_map(*[v for k, c in counts(F.col("residues")).items() for v in (F.lit(k), c)]))
    n = lambda k: F.col("_n")[k]
    some = F.col("n_residues") > 0
    mass = sum((n(k) * v for k, v in MASS.items()), F.lit(0.0)) - (F.col("n_residues") - 1) * WATER
    chain = F.create_map(*[F.lit(v) for kv in N_ENDS.items() for v in kv])
    tail = F.create_map(*[F.lit(v) for kv in C_ENDS.items() for v in kv])
    x = x.withColumn("_first", F.coalesce(F.try_element_at(chain, F.left("residues", F.lit(1))), F.lit(N_END))).withColumn("_last", F.coalesce(F.try_element_at(tail, F.right("residues", F.lit(1))), F.lit(C_END)))

    def charge(ph: Column) -> Column:
        up = lambda pk: 1 / (1 + F.pow(F.lit(10.0), ph - pk))
        down = lambda pk: 1 / (1 + F.pow(F.lit(10.0), pk - ph))
        return sum((n(k) * up(F.lit(v)) for k, v in POSITIVE.items()), up(F.col("_first"))) - sum((n(k) * down(F.lit(v)) for k, v in NEGATIVE.items()), down(F.col("_last")))

    def halve(s: Column, _: Column) -> Column:
        lo, hi = F.when(s["c"] > 0, s["ph"]).otherwise(s["lo"]), F.when(s["c"] > 0, s["hi"]).otherwise(s["ph"])
        mid = (lo + hi) / 2
        return F.when(s["hi"] - s["lo"] > WIDTH, F.struct(mid.alias("ph"), lo.alias("lo"), hi.alias("hi"), charge(mid).alias("c"))).otherwise(s)

    start = F.struct(F.lit(FIRST).alias("ph"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), charge(F.lit(FIRST)).alias("c"))
    pi = F.aggregate(F.sequence(F.lit(1), F.lit(18)), start, halve)["ph"]  # the interval is below WIDTH after 17 halvings
    share = F.transform_values("_n", lambda _, v: F.round(100.0 * v / F.col("n_residues"), 2))
    found = {"mass": mass, "aromaticity": (n("F") + n("W") + n("Y")) / F.col("n_residues"), "pi": pi, "composition": share}
    return x.withColumns({k: F.when(some, v) for k, v in found.items()}).drop("_n", "_first", "_last")


def instability(df: DataFrame, id_: str, residues_: str, weights: DataFrame) -> DataFrame:
    """(id, instability): 10 / length times the sum of the weights of neighbouring residues.

    ``weights`` (pair, weight) is the published table of 400 dipeptides, which
    is given, not kept here; a pair that it lacks weighs 1.  The table travels
    as one row, so each sequence is weighed where it is read.
    """
    n = F.char_length(residues_)
    pairs = weights.filter("char_length(pair) = 2").groupBy("pair").agg(F.sum(F.coalesce("weight", F.lit(1.0)).cast("double")).alias("weight"))  # two letters: 400 pairs of residues
    # One row: the letters of the pairs, and the weights by the places of their two letters in it.
    letters = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("pair", ""))))), "")
    known = pairs.agg(letters.alias("_letters"), F.map_from_entries(F.collect_list(F.struct("pair", "weight"))).alias("m"))
    each = F.filter(F.split("_letters", ""), lambda x: x != "")
    table = known.select("_letters", F.flatten(F.transform(each, lambda x: F.transform(each, lambda y: F.coalesce(F.try_element_at("m", F.concat(x, y)), F.lit(1.0))))).alias("_weights"))
    place = lambda i: F.call_function("instr", F.col("_letters"), F.substring(F.col(residues_), i, F.lit(1)))
    # The place of the letter before goes with the sum, so each letter is looked up once.
    start = F.struct(F.lit(0.0).cast("double").alias("s"), place(F.lit(1)).alias("p"))
    weight = lambda x, y: F.when((x > 0) & (y > 0), F.get("_weights", (x - 1) * F.char_length("_letters") + y - 1)).otherwise(1.0)
    total = F.aggregate(F.sequence(F.lit(2), n), start, lambda a, i: F.struct((a["s"] + weight(a["p"], place(i))).alias("s"), place(i).alias("p")))["s"]
    return df.filter(n > 0).join(F.broadcast(table)).select(F.col(id_).alias("id"), (10 / n * F.when(n > 1, total).otherwise(0.0)).alias("instability"))
