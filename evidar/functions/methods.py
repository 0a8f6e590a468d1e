"""The methods that make calls or features, as one table: a row for each says how it is named, shown, weighed and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GREY = "#64748b"

#: Key, display, family, kind, signal, colour, place; then the columns of its table: id, family, confidence, extra.
METHODS = [
    ("HMMER", "HMMER", "baseline", "hmm", "sequence", GREY, 10, None, None, None, []),
    ("dbCAN_sub", "dbCAN_sub", "baseline", "dbcan_sub", "sequence", GREY, 11, None, None, None, []),
    ("DIAMOND", "DIAMOND", "baseline", "diamond", "sequence", GREY, 12, None, None, None, []),
    ("ESM-C-kNN", "ESM-C · kNN", "advanced", "sequence-plm", "sequence", "#2563eb", 20, "query_id", "knn_pred", "knn_conf", ["knn_purity", "knn_margin"]),
    ("ESM-C-centroid", "ESM-C · centroid", "advanced", "sequence-plm", "sequence", "#7c3aed", 21, "query_id", "cent_pred", "cent_conf", ["cent_margin"]),
    ("ESM-C-contrastive", "ESM-C · contrastive", "advanced", "sequence-plm", "sequence", "#c026d3", 22, "query_id", "clf_pred", "clf_conf", ["contr_cent_pred", "contr_cent_margin", "contr_knn_pred", "contr_knn_purity"]),
    ("Foldseek-CAZyme3D", "Foldseek · CAZyme3D", "advanced", "structure", "structure", "#059669", 23, "protein_id", "family", "prob", ["target", "tmscore", "lddt"]),
    ("SaProt", "SaProt", "advanced", "structure", "structure", "#0d9488", 24, "protein_id", "family", "cosine", ["nn_id"]),
    ("fusion", "Fusion (consensus)", "advanced", "fusion", "fusion", "#ea580c", 25, "protein_id", "family", "confidence", ["votes", "agreement", "signals"]),
]
SCHEMA = "key string, display string, family string, kind string, signal string, colour string, place int, id_column string, family_column string, confidence_column string, extra array<string>"

#: Key, display, feature type, status, colour.
FEATURE_TOOLS = [
    ("Pfam/hmmscan", "Pfam · hmmscan", "domain", "real_tool", "#3a5bd0"),
    ("ESMFold", "ESMFold", "structure", "real_tool", "#059669"),
    ("Foldseek-CAZyme3D", "Foldseek · CAZyme3D", "structure_hit", "real_tool", "#0d9488"),
    ("DeepTMHMM", "DeepTMHMM", "tm_topology", "real_tool", "#7c3aed"),
    ("SignalP6", "SignalP 6.0", "signal_peptide", "scaffold", "#b25c00"),
    ("CLEAN", "CLEAN", "ec_prediction", "real_tool", "#c026d3"),
    ("Biopython", "Biopython", "physicochem", "real_tool", "#2563eb"),
    ("DeepLoc", "DeepLoc-2.0", "localization", "scaffold", "#b25c00"),
]
#: What stands for the columns of a method that is not registered.
COLUMNS = {"id_column": "protein_id", "family_column": "family", "confidence_column": "confidence"}


def registry(spark: SparkSession, more: list[tuple] | None = None) -> DataFrame:
    """The dimension of methods; ``more`` are further rows, which is all that a new method takes."""
    return spark.createDataFrame([*METHODS, *(more or [])], SCHEMA)


def feature_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURE_TOOLS, "key string, display string, feature_type string, status string, colour string")


def with_methods(df: DataFrame, tool: str, methods: DataFrame) -> DataFrame:
    """``df`` with method_display, method_family, method_kind, method_signal, method_colour, method_place and is_advanced.

    Keys are exact.  An unknown tool is of family "unknown", shown by its own
    name in grey, after all others; a missing one is shown as a dash.
    """
    m = methods.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("display", "family", "kind", "signal", "colour", "place")])
    out = df.join(F.broadcast(m), F.col(tool) == F.col("_key"), "left")  # a row for each method
    named = [F.coalesce("_display", F.col(tool), F.lit("—")).alias("method_display"), F.coalesce("_family", F.lit("unknown")).alias("method_family"), F.col("_kind").alias("method_kind"), F.col("_signal").alias("method_signal"), F.coalesce("_colour", F.lit(GREY)).alias("method_colour"), F.coalesce("_place", F.lit(999)).alias("method_place")]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *named, F.coalesce(F.col("_family") == "advanced", F.lit(False)).alias("is_advanced"))


def json_value(c: Column) -> Column:
    """A cell as a JSON value: objects and arrays as they are, whole and decimal numbers as numbers, else as text; null and empty cells stay null."""
    t = F.trim(c)
    text = F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    number = t.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    plain = F.to_json(F.struct(t.try_cast("double").alias("x")))
    return (
        F.when(t.isNull() | t.isin("", "-"), None)
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), t)
        .when(t.rlike(r"^-?[0-9]+$"), F.regexp_replace(t, r"^(-?)0+(?=[0-9])", "$1"))
        .when(number, F.regexp_extract(plain, r"^\{\"x\":(.*)\}$", 1))
        .otherwise(text)
    )


def json_object(values: dict[str, Column]) -> Column:
    """A JSON object of the cells that have a value, in the given order."""
    parts = [F.concat(F.lit(f'"{k}":'), json_value(v)) for k, v in values.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")) if parts else F.lit("{}")


def primary_family(cell: Column) -> tuple[Column, Column]:
    """(the first family of a cell of families joined by commas or semicolons, all of them joined by commas or null where there is one)."""
    parts = F.filter(F.transform(F.split(cell, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    several = cell.rlike("[,;]")
    return F.when(several, F.get(parts, F.lit(0))).otherwise(cell), F.when(several & (F.size(parts) > 0), F.array_join(parts, ","))
