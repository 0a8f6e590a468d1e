"""Mixing by soft membership.

A classifier trained on the labelled table gives each document posteriors over
domains.  Nonnegative rates, one for each document, are then fitted so that the
expected tokens of each domain meet their targets: least squares by projected
gradient steps from rate 1.  A step needs only the totals of the domains and
their second moments, one aggregation over the narrow table of posteriors, so
the rate of a document is a short expression of its posteriors and the steps.
Every step lies in the span of the posteriors, so among the solutions the one
near rate 1 is found.

The classifier may be fitted on a bounded sample (``TRAIN_ROWS``); posteriors,
totals and rates cover all documents.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

DOMAINS = ("good", "toxic", "low")
TARGETS = {"good": 0.90, "toxic": 0.04, "low": 0.06}
TRAIN_ROWS = 8_000
FEATURES = 1 << 14
STEPS = 25
CLOSE = 1e-6

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 0, 2.0).when(F.col("quality") == 1, 0.0)


def tokens(text: Column) -> DataFrame:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_n`` (its words) and ``_x``: hashed words, and coarse shares of symbols, capitals and repeated words."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    d = docs.withColumn("_w", tokens(t)).withColumn("_n", F.size("_w").cast("long"))
    size = F.char_length(t) + 1

    def share(name: str, x: Column) -> Column:
        return F.concat(F.lit(f"\x00{name}"), F.least(F.floor(F.log2(1 + 64 * x)), F.lit(6)).cast("string"))

    marks = [
        share("symbols", (size - F.char_length(F.translate(t, SYMBOLS, ""))) / size),
        share("capitals", (size - F.char_length(F.translate(t, UPPER, ""))) / size),
        share("repeats", 1 - F.size(F.array_distinct("_w")) / F.greatest(F.col("_n"), F.lit(1))),
        share("short", F.lit(8.0) / (F.col("_n") + 1)),
    ]
    d = d.withColumn("_w", F.concat("_w", F.array(*marks)))
    return HashingTF(inputCol="_w", outputCol="_x", numFeatures=FEATURES, binary=True).transform(d).drop("_w")


@dataclass
class Mixture:
    model: LogisticRegressionModel | None
    steps: list[list[float]]


def fit_classifier(docs: DataFrame, labels: DataFrame, ws: Workspace, rows: int = TRAIN_ROWS) -> LogisticRegressionModel | None:
    """None without two domains among the labels; of labels that disagree on an id the highest domain counts."""
    named = labels.withColumn("_label", domain_of_labels()).filter("_label is not null and doc_id is not null")
    chosen = named.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).select("_x", "_label")  # at most ``rows`` narrow rows
    train = ws.save(train, "train")
    if train.select("_label").distinct().count() < 2:
        return None
    return LogisticRegression(featuresCol="_x", labelCol="_label", family="multinomial", regParam=0.002, maxIter=30, standardization=False).fit(train)


def with_posteriors(docs: DataFrame, model: LogisticRegressionModel | None) -> DataFrame:
    """``docs`` with ``_n`` and ``_p``; without a model every document is in the first domain."""
    if model is None:
        x = docs.withColumn("_n", F.size(tokens(F.coalesce(F.col("text"), F.lit("")))).cast("long"))
        return x.withColumn("_p", F.array(*[F.lit(float(k == 0)) for k in range(len(DOMAINS))]))
    x = model.setProbabilityCol("_v").setRawPredictionCol("").setPredictionCol("").transform(features(docs))
    p = vector_to_array("_v")
    return x.withColumn("_p", F.array(*[F.coalesce(F.round(F.get(p, F.lit(k)), 6), F.lit(0.0)) for k in range(len(DOMAINS))])).drop("_x", "_v")


def rate(p: Column, steps: list[list[float]]) -> Column:
    out = F.lit(1.0)
    for v in steps:
        out = F.greatest(F.lit(0.0), out - sum((F.get(p, F.lit(k)) * float(x) for k, x in enumerate(v)), F.lit(0.0)))
    return out


def fit_rates(posteriors: DataFrame, targets: dict[str, float], budget: float = 1.0) -> list[list[float]]:
    """Steps after which the expected tokens of each domain are ``targets`` of ``budget`` times all tokens.

    A domain that no document belongs to cannot be met; the targets of the others are scaled up.
    """
    k = len(DOMAINS)
    steps: list[list[float]] = []
    while len(steps) < STEPS:
        r = posteriors.select("_n", rate(F.col("_p"), steps).alias("r"), *[F.get("_p", F.lit(i)).alias(f"p{i}") for i in range(k)])
        sums = [F.sum(F.col("_n") * F.col("r") * F.col(f"p{i}")) for i in range(k)]
        moments = [F.sum(F.when(F.col("r") > 0, F.col("_n") * F.col(f"p{i}") * F.col(f"p{j}"))) for i in range(k) for j in range(i, k)]
        row = [float(x or 0) for x in r.agg(F.sum("_n"), *sums, *[F.sum(F.col("_n") * F.col(f"p{i}")) for i in range(k)], *moments).first()]
        total, now, all_, second = row[0], np.array(row[1 : 1 + k]), np.array(row[1 + k : 1 + 2 * k]), row[1 + 2 * k :]
        if not total:
            return steps
        want = np.array([targets[d] if a > 0 else 0.0 for d, a in zip(DOMAINS, all_, strict=True)])
        gap = (now - budget * total * want / max(want.sum(), 1e-12)) / total
        if np.abs(gap).max() < CLOSE:
            return steps
        g = np.zeros((k, k))
        for (i, j), x in zip([(i, j) for i in range(k) for j in range(i, k)], second, strict=True):
            g[i, j] = g[j, i] = x / total
        steps.append((np.linalg.pinv(g, rcond=1e-9) @ gap).tolist())
    warnings.warn(f"after {STEPS} steps a domain is still {np.abs(gap).max():.4f} of all tokens from its target", stacklevel=2)
    return steps


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, targets: dict[str, float] = TARGETS) -> tuple[Mixture, DataFrame]:
    model = fit_classifier(docs, labels, ws)
    posteriors = ws.save(with_posteriors(docs.select("doc_id", "text"), model).select("doc_id", "_n", "_p"), "posteriors")
    return Mixture(model, fit_rates(posteriors, targets)), posteriors


def copies(r: Column) -> Column:
    """A whole number of copies whose mean over ids is the rate: the part after the point is drawn by a hash of the id."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), F.col("doc_id")), F.lit(1 << 20)) / (1 << 20)
    return (F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)).cast("int")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents.  Null and empty texts have no tokens, and posteriors like any text without words."""
    mix, posteriors = fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), Workspace(spark, "op10"))
    out = posteriors.withColumn("rate", rate(F.col("_p"), mix.steps))
    return out.select("doc_id", F.col("_n").alias("n_tokens"), *[F.get("_p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], F.round("rate", 6).alias("rate"), copies(F.col("rate")).alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, with its own columns, whatever their names.

    Rows that repeat an id have the rate of their own text, and copies by the
    same draw.  Null and empty texts are rated like any text without words.
    """
    ws = Workspace(spark, "stage10")
    model = fit_classifier(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ws)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), "doc_id", "text")
    posteriors = ws.save(with_posteriors(rows, model).select("_own", "doc_id", "_n", "_p"), "posteriors")
    steps = fit_rates(posteriors.select("_n", "_p"), TARGETS)
    rated = posteriors.withColumn("_c", copies(rate(F.col("_p"), steps)))
    return rated.filter("_c > 0").select("_own", F.explode(F.sequence(F.lit(1), F.col("_c")))).select("_own.*")
