"""Evidence per item: tiers, best hits, consensus of methods, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_by


def saturating(e_value: Column, coverage: Column, full: float = 20.0) -> Column:
    """-log10 of an e-value, saturated and scaled to 0..1, times the coverage; 0 where either is missing."""
    strength = F.least(F.greatest(-F.log10(F.greatest(e_value, F.lit(1e-300))), F.lit(0.0)), F.lit(full)) / full
    return F.when(e_value.isNull() | coverage.isNull(), F.lit(0.0)).otherwise(strength * F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0)))


def tier(n_tools: Column) -> Column:
    """By the number of tools that call an item, whatever the evidence."""
    return F.when(n_tools >= 2, "positive").when(n_tools == 1, "gray").otherwise("negative")


def subtier(n_tools: Column, evidence: Column) -> Column:
    """Three tools or two; a single call with more evidence or less; none."""
    return F.when(n_tools >= 3, "1A").when(n_tools == 2, "1B").when((n_tools == 1) & (evidence >= 0.5), "2A").when(n_tools == 1, "2B").otherwise("3")


def triage(agreement: Column, confidence: Column, *heads: Column) -> Column:
    """(score, tier) from the share of votes that agree, the confidence of the call, and the confidences of the heads.

    Disagreement, lack of confidence, and how far the call falls short of the
    most confident head add up; more is worse.
    """
    collapse = F.least(F.greatest(F.greatest(*heads) - confidence, F.lit(0.0)), F.lit(1.0))
    score = F.round(0.40 * (1 - agreement) + 0.35 * (1 - confidence) + 0.25 * collapse, 9)
    return F.struct(score.alias("score"), F.when(score > 0.35, "FLAG").when(score > 0.15, "WATCH").otherwise("ACCEPT").alias("tier"))


def majority(*calls: Column) -> Column:
    """How many of a few calls are the most frequent one."""
    votes = F.array(*calls)
    return F.array_max(F.transform(votes, lambda v: F.size(F.filter(votes, lambda w: w == v))))


def compare_methods(df: DataFrame, group: list[str], tool: str, advanced: Column, fusion: Column, placeholder: Column) -> DataFrame:
    """Per group: baseline and advanced tools, and whether only advanced methods make the call with enough support."""
    named = df.withColumn("_adv", advanced).withColumn("_fus", fusion).withColumn("_ph", placeholder)
    advanced_set = F.collect_set(F.when(F.col("_adv"), F.col(tool)))
    out = named.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("_adv"), F.col(tool)))), ",").alias("baseline_tools"),
        F.array_join(F.array_sort(advanced_set), ",").alias("advanced_tools"),
        F.size(advanced_set).cast("long").alias("n_adv"),
        F.bool_or(~F.col("_adv")).alias("_base"),
        F.bool_or(F.col("_adv") & F.col("_fus")).alias("_fusion"),
        F.bool_or("_ph").alias("_placeholder"),
    )
    only = ~F.col("_base") & ~F.col("_placeholder") & (F.col("_fusion") | (F.col("n_adv") >= 2))
    return out.withColumn("advanced_only", only).drop("_base", "_fusion", "_placeholder")


def best_at_cutoffs(df: DataFrame, key: str, value: str, cutoffs: list[float], *order: Column) -> DataFrame:
    """The best row of each key among the rows that reach each cut-off."""
    each = df.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs)))).filter(F.col(value) >= F.col("cutoff"))
    return first_by(each, [key, "cutoff"], *order)


def consensus(votes: DataFrame, weights: dict[str, float], over_present: bool, abstain_below: float) -> DataFrame:
    """Weighted consensus of ``votes`` (id, method, family, confidence; a null family abstains).

    A family's score is the sum of weight times confidence of its voters over
    the weights of the methods that voted (``over_present``), or else of all
    methods with a row.  The best family wins, ties by name; below
    ``abstain_below`` the answer is null.
    """
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    voted = votes.withColumn("w", w[F.col("method")])
    counted = F.when(F.col("family").isNotNull(), F.col("w")) if over_present else F.col("w")
    base = voted.withColumn("all_w", F.sum(counted).over(Window.partitionBy("id")))
    scores = base.filter("family is not null").groupBy("id", "family", "all_w").agg(F.sum(F.col("w") * F.col("confidence")).alias("s"), F.count("*").alias("n_agree"))
    scores = scores.withColumn("score", F.round(F.col("s") / F.col("all_w"), 8))
    best = first_by(scores, ["id"], F.desc("score"), F.asc("family"))
    ids = votes.select("id").distinct()
    kept = F.col("score") >= abstain_below
    return ids.join(best, "id", "left").select("id", F.when(kept, F.col("family")).alias("family"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_agree", F.lit(0)).cast("long").alias("n_agree"))


def min_max(c: str) -> Column:
    """A column scaled by its range over the whole table; use on small summaries."""
    everything = Window.partitionBy(F.lit(1))
    lo, hi = F.min(c).over(everything), F.max(c).over(everything)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)


def vote_details(votes: DataFrame, weights: dict[str, float], parent: Column) -> DataFrame:
    """(id, family, agree_frac, all_families, voters) of ``votes`` (id, method, family, confidence; a null family abstains).

    The family is that of the largest weighted confidence, the first by name of
    equals; agree_frac is the share of voting methods whose ``parent`` (an
    expression of family) is that of the winner; all families stand by falling
    score; voters are the methods that voted, sorted.
    """
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    cast = votes.filter("family is not null").withColumn("parent", parent)
    per = cast.groupBy("id", "family", "parent").agg(F.round(F.sum(w[F.col("method")] * F.col("confidence")), 8).alias("s"), F.collect_list("method").alias("m"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "family", "parent", "m")))
    g = per.groupBy("id").agg(listed.alias("v")).withColumn("top", F.get("v", F.lit(0))["parent"])
    n = F.aggregate("v", F.lit(0), lambda a, x: a + F.size(x["m"]))
    same = F.aggregate("v", F.lit(0), lambda a, x: a + F.when(x["parent"] == F.col("top"), F.size(x["m"])).otherwise(0))
    return g.select("id", F.get("v", F.lit(0))["family"].alias("family"), F.round(same / n, 6).alias("agree_frac"), F.array_join(F.transform("v", lambda x: x["family"]), ",").alias("all_families"), F.array_join(F.array_sort(F.flatten(F.transform("v", lambda x: x["m"]))), ",").alias("voters"))
