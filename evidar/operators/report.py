"""Report blocks of an item: review verdict, votes, corrected values, ordered children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Below the first a call abstains, below the second it is not of high confidence.
ABSTAIN, HIGH = 0.35, 0.90


def review(heads: list[Column], family: Column, confidence: Column, agreement: Column, n_domains: Column, baseline: Column) -> Column:
    """(level, majority, n_majority, reasons) of an item: clean, attention or review.

    ``heads`` are calls, null where a head has none.  The majority is the most
    frequent call, the alphabetically first of equals.  Reasons are short names;
    those for review stand before those for attention.
    """
    calls = F.filter(F.array(*heads), lambda c: c.isNotNull() & (c != ""))
    distinct = F.array_sort(F.array_distinct(calls))
    counted = F.transform(distinct, lambda v: F.struct(F.size(F.filter(calls, lambda c: c == v)).alias("n"), v.alias("v")))
    top = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    named = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    strong = F.array_compact(
        F.array(
            named("abstains", confidence < ABSTAIN),
            named("heads_all_differ", (F.size(calls) >= 3) & (F.size(distinct) == F.size(calls))),
            named("low_agreement", agreement <= 2),
            named("against_majority", (top["n"] >= 2) & (family != "") & (family != top["v"])),
        )
    )
    weak = F.array_compact(
        F.array(
            named("not_unanimous", F.size(distinct) > 1),
            named("below_high_confidence", confidence < HIGH),
            named("several_domains", n_domains > 1),
            named("baseline_disagrees", (baseline != "") & (family != "") & (baseline != family)),
        )
    )
    level = F.when(F.size(strong) > 0, "review").when(F.size(weak) > 0, "attention").otherwise("clean")
    return F.struct(level.alias("level"), top["v"].alias("majority"), top["n"].alias("n_majority"), F.concat(strong, weak).alias("reasons"))


def self_vote(votes: Column, family: Column, name: str = "fusion") -> Column:
    """(votes, agreement): a map of votes with the call's own added unless it is there, and how many are for the call."""
    own = F.map_contains_key(votes, F.lit(name))
    all_ = F.when(own, votes).otherwise(F.map_concat(votes, F.create_map(F.lit(name), family)))
    return F.struct(all_.alias("votes"), F.size(F.filter(F.map_values(all_), lambda v: v == family)).alias("agreement"))


def corrected(value: Column, authority: Column, within: float = 0.05) -> Column:
    """(value, stale): the authority's value where both are known and further apart than ``within``."""
    stale = F.coalesce(F.abs(authority - value) > within, F.lit(False))
    return F.struct(F.when(stale, authority).otherwise(value).alias("value"), stale.alias("stale"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``parents`` with an array of their children's other columns in ``order``, empty for a parent without any."""
    rest = [c for c in children.columns if c != key and c not in order]
    kept = children.join(parents.select(key).distinct(), key, "left_semi")
    lists = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    out = parents.join(lists, key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def page_of(df: DataFrame, page: int, size: int = 50) -> DataFrame:
    """One row: how many rows and pages there are, and the page asked for, kept within them."""
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long")
    return df.agg(F.count("*").alias("total")).select("total", pages.alias("pages"), F.greatest(F.least(F.lit(page).cast("long"), pages), F.lit(1)).cast("long").alias("page"))
