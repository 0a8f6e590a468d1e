"""Logistic models over unit vectors and over evidence signals."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import scratch


def gate(df: DataFrame, vector: str, label: str, c: float = 1.0, steps: int = 2000) -> LogisticRegressionModel:
    """A logistic gate on unit vectors; ``c`` is the inverse strength of regularisation over the sum of losses."""
    x = df.select(array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x"), F.col(label).cast("double").alias("y")).persist()
    try:
        return LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (c * max(1, x.count())), standardization=False, maxIter=steps).fit(x)
    finally:
        x.unpersist()


def gate_scores(model: LogisticRegressionModel, df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, score) by the probability of label 1."""
    x = df.select(id_, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("x"))
    return model.transform(x).select(id_, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def novelty_scores(df: DataFrame, id_: str, signals: list[str], label: str, folds: int = 5) -> DataFrame:
    """(id, fold, score): each row is scored by a model of the other folds, on standardised signals, with classes of equal weight.

    Folds are even within each class: a row's fold is its place in a hash order
    of its class.
    """
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(label, F.pmod(F.xxhash64(id_), F.lit(64))).orderBy(F.xxhash64(id_, F.lit("fold")), id_))
    x = VectorAssembler(inputCols=signals, outputCol="raw").transform(df.select(id_, *[F.col(s).cast("double").alias(s) for s in signals], F.col(label).cast("double").alias("y"), F.pmod(place + F.xxhash64(id_), F.lit(folds)).cast("int").alias("fold")))
    path = f"{scratch(df.sparkSession, 'novelty')}/rows"
    x.write.parquet(path)  # the folds are read once for each model and once more by whoever reads the scores
    x = df.sparkSession.read.schema(x.schema).parquet(path)
    out = None
    for k in range(folds):
        train = x.filter(F.col("fold") != k)
        n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            raise ValueError("both classes must stand in every training part")
        total = sum(n.values())
        train = train.withColumn("w", F.when(F.col("y") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(train)
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / total, standardization=False, maxIter=1000).fit(scaler.transform(train))
        part = model.transform(scaler.transform(x.filter(F.col("fold") == k))).select(id_, "fold", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out = part if out is None else out.union(part)
    return out
