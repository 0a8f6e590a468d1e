"""Redundancy reduction: the longest sequences stand for those that are like them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import Steps


#: Words that are cut out of one piece of a sequence; a place in a string is found by reading up to it.
PIECE = 64


def kmer_keys(sequence: str, k: int, keys: int, salt: int):
    """The ``keys`` lowest hashes of the words of k letters; a shorter sequence is one word."""
    last = F.floor((F.greatest(F.char_length(sequence) - k, F.lit(0))) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda p: F.substring(sequence, p * PIECE + 1, F.lit(PIECE + k - 1)))
    words = F.transform(pieces, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(salt), F.substring(x, i, F.lit(k)))))
    return F.slice(F.sort_array(F.array_distinct(F.flatten(words))), 1, keys)


def candidates(rows: DataFrame, k: int, keys: int, salt: int, steps: Steps | None = None) -> DataFrame:
    """(id, rep): each sequence with the longest one of each of its keys, which stands before it in the order (length descending, id).

    A key has one centre, found by a partial aggregation, so a key that many
    sequences share makes a row for each of them and no pairs.  The keys are
    written, for they are read twice.
    """
    keyed = (steps or Steps(rows.sparkSession, "keys")).save(rows.select("id", "n", F.explode(kmer_keys("s", k, keys, salt)).alias("key")))
    centre = keyed.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("c"), F.count("*").alias("m")).filter("m > 1").select("key", F.col("c.id").alias("rep"))
    return keyed.join(centre, "key").filter("id <> rep").select("id", "rep").distinct()


def alike(pairs: DataFrame, rows: DataFrame, identity: float, coverage: float) -> DataFrame:
    """``pairs`` whose shorter sequence has ``coverage`` of the longer one's length, and whose edit distance leaves ``identity`` of it.

    Most pairs fail by length; others end as soon as the distance is too large.
    """
    a, b = rows.select("id", F.col("s").alias("a"), F.col("n").alias("na")), rows.select(F.col("id").alias("rep"), F.col("s").alias("b"), F.col("n").alias("nb"))
    x = pairs.join(rows.select("id", F.col("n").alias("na")), "id").join(rows.select(F.col("id").alias("rep"), F.col("n").alias("nb")), "rep").filter(F.col("na") >= coverage * F.col("nb")).select("id", "rep")
    x = x.join(a, "id").join(b, "rep")
    # An identity of t of n letters leaves floor((1 - t) n) edits; a guard keeps a product that is whole from falling below it.
    most = F.floor((1 - identity) * F.col("nb") + 1e-9).cast("int")
    distance = F.call_function("levenshtein", "a", "b", most)
    return x.filter(distance >= 0).select("id", "rep", F.round(1 - distance / F.greatest("nb", F.lit(1)), 6).alias("identity"))


def reduce_redundancy(df: DataFrame, id_: str, sequence: str, identity: float = 0.5, coverage: float = 0.8, k: int = 5, keys: int = 20, passes: int = 3) -> DataFrame:
    """(id, rep, identity): every sequence with the one that stands for it, itself where it is kept.

    Read in the order of length (longest first) and then id, a sequence goes if
    one before it that is kept shares a low k-mer key with it and confirms:
    shorter / longer length at least ``coverage``, and 1 - edits / longer length
    at least ``identity``.  Of several that confirm, the most alike stands for
    it (ties by id).  Decisions go by rounds: a sequence whose earlier
    candidates have all gone is kept.  The kept ones are read again with other
    keys, up to ``passes`` times or until none goes; a sequence whose
    representative goes later passes to no other, for it need not be like it,
    so it is read again, too.

    Each sequence that goes is like its representative; two kept ones may be
    alike where they share no low key with a common centre.  Rows with a null
    id or sequence are left out; ids are unique.
    """
    steps = Steps(df.sparkSession, "redundancy")
    rows = steps.save(df.select(F.col(id_).alias("id"), F.col(sequence).alias("s"), F.char_length(sequence).alias("n")).filter("id is not null and s is not null"))
    left, gone = rows, []
    for turn in range(passes):
        pairs = steps.save(alike(candidates(left, k, keys, turn, steps), left, identity, coverage))
        open_, kept = pairs, None
        dropped = []
        while open_.limit(1).count():
            # A candidate that is itself open may still go; one with no open pair of its own is kept.
            waits = open_.select(F.col("id").alias("rep")).distinct().withColumn("waits", F.lit(True))
            marked = steps.save(open_.join(waits, "rep", "left"))
            go = steps.save(marked.filter("waits is null").groupBy("id").agg(F.min(F.struct((-F.col("identity")).alias("i"), "rep")).alias("x")).select("id", "x.rep", (-F.col("x.i")).alias("identity")))
            dropped.append(go)
            ids = go.select("id")
            open_ = steps.save(marked.drop("waits").join(ids, "id", "left_anti").join(ids.withColumnRenamed("id", "rep"), "rep", "left_anti"))
        if not dropped:
            break
        new = dropped[0]
        for x in dropped[1:]:
            new = new.unionAll(x)
        new = steps.save(new)
        ids = new.select("id")
        # Those whose representative has gone now are read again in the next pass.
        orphans = [g.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi").select("id") for g in gone]
        gone = [steps.save(g.join(ids.withColumnRenamed("id", "rep"), "rep", "left_anti").select("id", "rep", "identity")) for g in gone] + [new]
        left = left.join(ids, "id", "left_anti")
        for o in orphans:
            left = left.unionAll(rows.join(o, "id", "left_semi"))
        left = steps.save(left)
    out = left.select("id", F.col("id").alias("rep"), F.lit(1.0).alias("identity"))
    for g in gone:
        out = out.unionAll(g.select("id", "rep", "identity"))
    return out
