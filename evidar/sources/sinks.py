"""Sinks: exports of result tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotation import wrapped


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Arrays become sorted, distinct, ";"-joined cells."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    df.select(*[F.array_join(F.array_sort(F.array_distinct(c)), ";").alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"')


def write_fasta(df: DataFrame, path: str, id_: str = "id", sequence: str = "sequence") -> None:
    df.filter(F.col(sequence).isNotNull()).select(F.concat(F.lit(">"), id_, F.lit("\n"), wrapped(F.col(sequence))).alias("value")).write.mode("overwrite").text(path)


def write_gene_fasta(genes: DataFrame, path: str, gene: str | None = None, sample: str | None = None) -> None:
    """Proteins of a search (all of ``genes``), of one gene or of one sample: the header has gene, sample and product; genes without a sequence are left out.

    ``genes`` has gene_key, sample_key, product and protein_seq.
    """
    of = genes.filter(F.col("gene_key") == gene) if gene is not None else genes.filter(F.col("sample_key") == sample) if sample is not None else genes
    header = F.trim(F.concat_ws(" ", "gene_key", "sample_key", F.coalesce("product", F.lit(""))))
    write_fasta(of.filter("protein_seq <> ''").select(header.alias("id"), F.col("protein_seq").alias("sequence")), path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns])).alias("value")).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, extra: list[str]) -> None:
    """The normalised table: id, family and confidence to four places, missing values as "-", the other columns as one JSON cell."""
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("-")).alias(c)
    conf = F.coalesce(F.format_string("%.4f", F.col("confidence").cast("double")), F.lit("-"))
    conf = F.when(F.col("confidence").isNull(), "-").otherwise(conf).alias("confidence")
    out = df.select(text("protein_id"), text("family"), conf, F.to_json(F.struct(*extra)).alias("extra"))
    out.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"')


def write_manifest(spark, path: str, sample: str, predictions: dict[str, str], features: dict[str, tuple[str, str]], **about: str) -> None:
    """A manifest that names the files of a sample: tool -> path, and path -> (feature type, tool)."""
    entry = {"sample_key": sample, "cazyme_predictions": [{"tool": k, "path": v} for k, v in predictions.items()], "protein_features": [{"feature_type": f, "tool": tool, "path": p} for p, (f, tool) in features.items()]}
    spark.createDataFrame([(json.dumps({**about, "samples": [entry]}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_summary(df: DataFrame, root: str, keys: list[str]) -> None:
    """Counts by ``keys`` as a table and as JSON lines, and all rows as a compressed table."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    write_csv(counts, f"{root}/summary", sep="\t")
    write_json(counts, f"{root}/summary_json")
    df.write.mode("overwrite").option("compression", "gzip").csv(f"{root}/detail", sep="\t", header=True)
