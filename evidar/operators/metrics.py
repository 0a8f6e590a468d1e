"""Evaluation: ranking metrics, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_score(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Positives and negatives of each different score: ranking metrics need no more."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(1)).alias("n"))


BINS = 256


def running(s: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """``s`` with ``<c>_before`` for each column: its sum over lower (or, descending, higher) scores.

    Different scores are dealt into at most BINS ranges of about equal numbers,
    however they crowd: sums of whole ranges come from a table of as many rows,
    the rest from a window within one range.
    """
    cuts = s.agg(F.percentile_approx(F.col("score").cast("double"), [i / BINS for i in range(1, BINS)], 20_000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    binned = s.withColumn("_bin", F.size(F.filter(cuts, lambda c: c < F.col("score"))))
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    over = Window.orderBy(order("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = binned.groupBy("_bin").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    whole = whole.select("_bin", *[F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_bin").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(F.broadcast(whole), "_bin")  # at most BINS rows
    for c in columns:
        out = out.withColumn(f"{c}_before", F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out


def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve where tied scores share their rank."""
    s = running(per_score(df, score, positive), ["n"])
    return s.agg((F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auroc"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Step-wise average precision."""
    s = running(per_score(df, score, positive), ["p", "n"], descending=True)
    tp = F.col("p_before") + F.col("p")
    return s.agg((F.sum(F.col("p") * tp / (tp + F.col("n_before") + F.col("n"))) / F.sum("p")).alias("average_precision"))


def precision_recall_curve(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, precision, recall) at every different score, score at least; and the end of the curve, precision 1 and recall 0, without a threshold."""
    s = running(per_score(df, score, positive), ["p", "n"], descending=True)
    tp, fp = F.col("p_before") + F.col("p"), F.col("n_before") + F.col("n")
    total = per_score(df, score, positive).agg(F.sum("p").alias("all"))
    points = s.join(F.broadcast(total)).select(F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.coalesce(F.try_divide(tp, F.col("all")), F.lit(1.0)).alias("recall"))  # one row
    return points.unionAll(df.sparkSession.range(1).select(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0)))


def operating_points(df: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at thresholds (score at least)."""
    each = df.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.col(score).alias("s"), positive.alias("y"))
    hit = F.col("s") >= F.col("threshold")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    m = each.groupBy("threshold").agg(count(hit & F.col("y")).alias("tp"), count(hit & ~F.col("y")).alias("fp"), count(~hit & F.col("y")).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return m.select("threshold", "tp", "fp", "fn", F.round(F.coalesce(p, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(r, F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("f1"))


def purity_threshold(df: DataFrame, score: str, positive: Column, grid: list[float], purity: float, fallback: float) -> DataFrame:
    """The last threshold of the grid below which the share of negatives is at least ``purity``."""
    each = df.select(F.explode(F.array(*map(F.lit, grid))).alias("t"), F.col(score).alias("s"), positive.alias("y")).filter("s < t")
    pure = each.groupBy("t").agg(F.avg(F.when(F.col("y"), 0.0).otherwise(1.0)).alias("purity"))
    return pure.agg(F.coalesce(F.max(F.when(F.col("purity") >= purity, F.col("t"))), F.lit(fallback)).alias("threshold"))


def conformal_quantile(df: DataFrame, score: str, alphas: list[float]) -> DataFrame:
    """Split-conformal quantiles by the 'higher' rule, without interpolation."""
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("k"))
    n = F.lit(counts.agg(F.sum("k")).first()[0] or 0)
    each = running(counts, ["k"]).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    level = F.least(F.ceil((n + 1) * (1 - F.col("alpha"))) / n, F.lit(1.0))
    at = F.ceil(F.round(level * (n - 1), 9))
    return each.filter((F.col("k_before") <= at) & (at < F.col("k_before") + F.col("k"))).select("alpha", F.col("score").alias("quantile"))


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, ece_part) over right-closed bins; 0 is in the lowest."""
    b = F.greatest(F.ceil(F.round(F.col(confidence) * bins, 9)), F.lit(1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(correct.cast("double")).alias("a"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select("bin", "n", F.round("c", 6).alias("mean_confidence"), F.round("a", 6).alias("accuracy"), F.round(F.col("n") / total * F.abs(F.col("c") - F.col("a")), 6).alias("ece_part"))


def confusion(df: DataFrame, truth: str, predicted: str, support: int) -> DataFrame:
    """(truth, predicted, n) with classes of less support gathered as "other"."""
    enough = df.groupBy(F.col(truth).alias("k")).count().filter(F.col("count") >= support).select("k")
    named = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p"))
    for c in ("t", "p"):
        named = named.join(enough.select(F.col("k").alias(c), F.lit(1).alias("_ok")), c, "left").withColumn(c, F.when(F.col("_ok").isNull(), "other").otherwise(F.col(c).cast("string"))).drop("_ok")
    return named.groupBy(F.col("t").alias("truth"), F.col("p").alias("predicted")).agg(F.count("*").alias("n"))


def threshold_grid(df: DataFrame, bucket: str, confidence: str, exact: Column, overlap: Column, thresholds: list[float]) -> DataFrame:
    """Per bucket, and overall, at each threshold: confident and abstaining rows, and how many of all and of the confident are right."""
    named = df.select(F.explode(F.array(F.lit("overall"), F.col(bucket))).alias("bucket"), F.col(confidence).alias("c"), exact.alias("x"), overlap.alias("o"))
    each = named.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    sure = F.col("c") >= F.col("threshold")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g = each.groupBy("bucket", "threshold").agg(F.count("*").alias("n"), count(sure).alias("confident"), count(sure & F.col("x")).alias("n_x"), count(sure & F.col("o")).alias("n_o"))
    part = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))
    return g.select("bucket", "threshold", "n", "confident", part(F.col("n") - F.col("confident"), F.col("n")).alias("abstain_share"), part(F.col("n_x"), F.col("confident")).alias("exact_of_confident"), part(F.col("n_o"), F.col("confident")).alias("overlap_of_confident"), part(F.col("n_x"), F.col("n")).alias("exact_of_all"), part(F.col("n_o"), F.col("n")).alias("overlap_of_all"))


def menu(calls: DataFrame, id_: str, family: str, confidence: str) -> DataFrame:
    """(id, menu): each family that a head calls, with its highest confidence."""
    best = calls.filter(F.col(family).isNotNull()).groupBy(id_, family).agg(F.max(confidence).alias("c"))
    return best.groupBy(id_).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(family, "c")))).alias("menu"))


def prediction_set(menu: Column, quantile: float | Column) -> Column:
    """The families whose nonconformity is within the quantile."""
    q = quantile if isinstance(quantile, Column) else F.lit(quantile)
    return F.map_keys(F.map_filter(menu, lambda _, c: F.round(1 - c, 9) <= q))


def energy(df: DataFrame, directions: dict[str, int], fitted_on: DataFrame | None = None) -> DataFrame:
    """``df`` with ``energy``: the mean of signals scaled by their range, those of direction -1 turned round.

    The ranges come from ``fitted_on`` (one row is broadcast); values outside
    go beyond 0 and 1.  A signal that does not vary is scaled by 1.
    """
    source = df if fitted_on is None else fitted_on
    ends = source.agg(*[f(c).alias(f"_{c}_{k}") for c in directions for k, f in (("lo", F.min), ("hi", F.max))])
    part = {c: (F.col(c) - F.col(f"_{c}_lo")) / F.when(F.col(f"_{c}_hi") > F.col(f"_{c}_lo"), F.col(f"_{c}_hi") - F.col(f"_{c}_lo")).otherwise(1.0) for c in directions}
    total = sum((part[c] if way > 0 else 1 - part[c] for c, way in directions.items()), F.lit(0.0))
    return df.join(F.broadcast(ends)).withColumn("energy", total / len(directions)).select(*df.columns, "energy")


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, top, share): the most frequent value of each key, the first by name of equals, and its share of the key's rows."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    g = n.groupBy(key).agg(F.max(F.col("n")).alias("m"), F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"))).alias("x"))
    return g.select(key, F.col("x.v").alias("top"), (F.col("m") / F.col("all")).alias("share"))


def class_accuracy(df: DataFrame, label: str, exact: Column, overlap: Column, kind: str, support: int = 5) -> DataFrame:
    """Per class of enough support: rows, shares that are right, and its kind, or "mixed"."""
    g = df.groupBy(label).agg(F.count("*").alias("n"), F.avg(exact.cast("double")).alias("exact"), F.avg(overlap.cast("double")).alias("overlap"), F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("mixed").alias("kind"))
    return g.filter(F.col("n") >= support)


def summary(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per key: rows, mean, and percentiles by linear interpolation."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), *[F.round(F.percentile(value, F.lit(p)), 6).alias(name) for name, p in shares.items()])


def mean_of_available(*parts: Column) -> Column:
    """The mean of the parts that are there; 0 where none is."""
    have = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)).otherwise(0.0)


def top_with_other(df: DataFrame, column: str, n: int) -> DataFrame:
    """(column, n) of the n most frequent values, ties by name, and of the rest together as "other"."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    top = counts.filter(F.col(column).isNotNull()).orderBy(F.desc("n"), F.asc(column)).limit(n).select(column, F.lit(True).alias("_top"))
    named = counts.join(F.broadcast(top), column, "left").withColumn(column, F.when(F.col("_top"), F.col(column)).otherwise("other"))  # n rows
    return named.groupBy(column).agg(F.sum("n").alias("n"))
