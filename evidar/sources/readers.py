"""Readers: annotation files to DataFrames.  Every reader takes a path or glob that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.annotation import cleaned, families_in_cell, whole
from ..functions.methods import COLUMNS, json_object, primary_family
from ..operators.relational import first_by


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of each file; ``pos`` orders the lines of a file, which is read in splits."""
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), pos.alias("pos"), F.rtrim("value", F.lit("\r")).alias("line"))


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """All columns as text; both quoting styles of embedded JSON are read."""
    return spark.read.csv(path, sep=sep, header=header, escape='"', quote='"')


def column_like(df: DataFrame, *names: str) -> str | None:
    """The column with one of these names, or else the first whose name has one of them in it; case does not count."""
    lower = {c.strip().lstrip("#").lower(): c for c in df.columns}
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    return next((c for n in names for k, c in lower.items() if n.lower() in k), None)


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features with their attributes as a map; reading stops at ##FASTA, rows that do not parse are left out."""
    all_ = lines(spark, path)
    stop = all_.filter(F.col("line").startswith("##FASTA")).groupBy("path").agg(F.min("pos").alias("stop"))
    c = F.split("line", "\t")
    rows = all_.join(stop, "path", "left").filter(F.col("stop").isNull() | (F.col("pos") < F.col("stop"))).filter(~F.col("line").startswith("#") & (F.size(c) >= 9))
    pairs = F.filter(F.split(F.get(c, F.lit(8)), ";"), lambda x: x.contains("="))
    decode = lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.trim(F.substring_index(x, "=", 1))), F.create_map(F.trim(F.substring_index(x, "=", 1)), decode(F.substr(x, F.instr(x, "=") + 1)))))
    out = rows.select("path", "pos", F.get(c, F.lit(0)).alias("contig"), F.get(c, F.lit(2)).alias("feature_type"), F.get(c, F.lit(3)).try_cast("int").alias("start"), F.get(c, F.lit(4)).try_cast("int").alias("end"), F.when(F.get(c, F.lit(6)).isin("+", "-"), F.get(c, F.lit(6))).alias("strand"), last.alias("attributes"))
    out = out.filter("start is not null and end is not null")
    named = lambda k: F.nullif(F.try_element_at("attributes", F.lit(k)), F.lit(""))
    key = F.coalesce(named("locus_tag"), named("ID"), F.concat_ws("", "contig", F.lit(":"), "start", F.lit("-"), "end"))
    return out.withColumn("gene_key", key).withColumn("product", F.try_element_at("attributes", F.lit("product"))).withColumn("length", F.col("end") - F.col("start") + 1)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, header, sequence); lines join, repeated ids of a file concatenate in order, empty ones go.

    A record ends where a line begins with ">", so a file is read in splits.
    What stands before the first header of a file is left out.
    """
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    records = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), pos.alias("pos"), F.col("value").alias("r"))
    first = records.groupBy("path").agg(F.min("pos").alias("first"))
    records = records.join(first, "path").filter((F.col("pos") != F.col("first")) | F.col("r").startswith(">")).withColumn("r", F.when(F.col("pos") == F.col("first"), F.substring("r", 2, 1 << 30)).otherwise(F.col("r")))
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace(F.substr("r", F.instr("r", "\n") + 1), r"\s", "")
    body = F.when(F.instr("r", "\n") > 0, body).otherwise("")
    one = records.select("path", "pos", F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), F.trim(F.rtrim(head, F.lit("\r"))).alias("header"), body.alias("s"))
    whole_ = one.groupBy("path", "id").agg(F.min_by("header", "pos").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "").alias("sequence"))
    return whole_.filter("id <> '' and sequence <> ''")


def overview(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, tool, family, ec_number, n_tools): a row for each gene, tool and family."""
    df = delimited(spark, path)
    gene, ec, n = column_like(df, "gene id", "gene_id"), column_like(df, "ec#", "ec"), column_like(df, "#oftools", "oftools")
    tools = {t: c for t in ("HMMER", "dbCAN_sub", "DIAMOND") if (c := next((x for x in df.columns if x.strip().lower() == t.lower()), None))}
    if gene is None or not tools:
        raise ValueError(f"{path}: no gene column, or no tool column, among {df.columns}")
    number = lambda c, f: f(F.col(f"`{c}`")) if c else F.lit(None)
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), F.col(f"`{c}`").alias("cell")) for t, c in tools.items()]))
    rows = df.select(F.trim(F.col(f"`{gene}`")).alias("gene_id"), number(ec, lambda x: cleaned(x, "ec")).cast("string").alias("ec_number"), number(n, lambda x: x.try_cast("int")).cast("int").alias("n_tools"), cells.alias("x"))
    return rows.select("gene_id", F.col("x.tool").alias("tool"), F.explode(families_in_cell(cleaned(F.col("x.cell"), "overview"))).alias("family"), "ec_number", "n_tools")


def domains(spark: SparkSession, path: str) -> DataFrame:
    """Positional domain hits of at least 11 columns, with GO terms as an array."""
    c = F.split("line", "\t")
    rows = lines(spark, path).filter(F.size(c) >= 11).select("path", "pos", c.alias("c"))
    at = lambda i: cleaned(F.get("c", F.lit(i)), "domain")
    go = F.array_distinct(F.filter(F.transform(F.split(at(13), r"\|"), lambda x: F.regexp_extract(x, r"(GO:\d{7})", 1)), lambda x: x != ""))
    return rows.select("path", "pos", at(0).alias("protein_id"), at(3).alias("analysis"), at(4).alias("signature_acc"), at(5).alias("signature_desc"), at(6).try_cast("int").alias("start"), at(7).try_cast("int").alias("end"), at(8).try_cast("double").alias("evalue"), at(11).alias("interpro_acc"), at(12).alias("interpro_desc"), F.coalesce(go, F.array().cast("array<string>")).alias("go_terms"))


def gene_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Members of gene clusters; columns are found by parts of their names."""
    df = delimited(spark, path)
    find = {"cluster_key": ("cgc#", "cgc"), "gene_type": ("gene type",), "contig": ("contig",), "protein_id": ("protein id",), "start": ("gene start", "start"), "end": ("gene stop", "stop", "end"), "family": ("protein family", "family")}
    cols = {k: column_like(df, *v) for k, v in find.items()}
    out = df.select(*[(F.trim(F.col(f"`{c}`")) if c else F.lit(None).cast("string")).alias(k) for k, c in cols.items()])
    return out.withColumn("start", whole(F.col("start"))).withColumn("end", whole(F.col("end")))


def substrates(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_key, substrate, score); the last row of a cluster counts."""
    c = F.split("line", "\t")
    rows = lines(spark, path).filter("line <> ''").select("path", "pos", c.alias("c"))
    head = rows.groupBy("path").agg(F.min("pos").alias("top"), F.min_by("c", "pos").alias("h")).select("path", "top", F.transform("h", lambda x: F.lower(F.ltrim(x, F.lit("#")))).alias("h"))
    j = rows.join(head, "path").filter("pos <> top")
    place = lambda n: F.array_position(F.transform("h", lambda x: x.contains(n)), F.lit(True)).cast("int") - 1
    got = lambda n: F.when(place(n) >= 0, F.get("c", place(n)))
    named = j.select("path", "pos", F.trim(got("cluster")).alias("cluster_key"), cleaned(got("substrate"), "substrate").alias("substrate"), got("score").try_cast("double").alias("score"))
    return named.groupBy("path", "cluster_key").agg(F.max_by(F.struct("substrate", "score"), "pos").alias("x")).select("path", "cluster_key", "x.*")


def resistance(spark: SparkSession, path: str) -> DataFrame:
    """Resistance hits; the sample is the file name up to its first point, percent signs go."""
    df = delimited(spark, path)
    find = {"file": ("input_file_name",), "protein_id": ("input_protein_id",), "gene_symbol": ("gene_symbol",), "accession": ("reference_accession", "accession"), "drug_class": ("drug_class",), "mechanism": ("resistance_mechanism", "mechanism"), "identity": ("sequence_identity", "identity"), "coverage": ("coverage_percentage", "coverage"), "tool": ("analysis_software_name",), "reference_db": ("reference_database_name", "reference_database")}
    cols = {k: column_like(df, *v) for k, v in find.items()}
    out = df.select(*[(cleaned(F.col(f"`{c}`"), "advanced") if c else F.lit(None).cast("string")).alias(k) for k, c in cols.items()])
    for c in ("identity", "coverage"):
        out = out.withColumn(c, F.rtrim(F.col(c), F.lit("%")).try_cast("double"))
    return out.withColumn("sample", F.substring_index(F.element_at(F.split("file", "/"), -1), ".", 1)).drop("file")


def predictions(spark: SparkSession, path: str, id_: str = "protein_id", family: str = "family", confidence: str = "confidence", abstentions: bool = False) -> DataFrame:
    """(protein_id, family, confidence, extra): columns by name, the others as a map.

    Rows without a family abstain and are left out, unless ``abstentions`` asks
    for them; rows without an id always go.
    """
    df = delimited(spark, path)
    if id_ not in df.columns:
        raise ValueError(f"{path}: no column {id_} among {df.columns}")
    rest = [c for c in df.columns if c not in (id_, family, confidence)]
    extra = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), cleaned(F.col(f"`{c}`"), "advanced"))]), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    conf = cleaned(F.col(f"`{confidence}`"), "advanced").try_cast("double") if confidence in df.columns else F.lit(None).cast("double")
    fam = cleaned(F.col(f"`{family}`"), "advanced") if family in df.columns else F.lit(None).cast("string")
    out = df.select(cleaned(F.col(f"`{id_}`"), "advanced").alias("protein_id"), fam.alias("family"), conf.alias("confidence"), extra.alias("extra")).filter("protein_id is not null")
    return out if abstentions else out.filter("family is not null")


def profile_hits(spark: SparkSession, path: str, e_value: float | None = 1e-15, coverage: float | None = 0.35, query_is_profile: bool = True, coordinates: str = "envelope") -> DataFrame:
    """Whitespace-separated profile search output.

    The searched profile is the query (its length in column 5) or the target
    (column 2); coordinates on the sequence are those of the envelope or of the
    alignment.  Without limits every hit is returned.
    """
    c = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).filter(~F.col("line").startswith("#") & (F.size(c) >= 22)).select("path", "pos", c.alias("c"))
    num = lambda i: F.get("c", F.lit(i)).try_cast("double")
    at = {"envelope": 19, "alignment": 17}[coordinates]
    profile, protein, length = (3, 0, 5) if query_is_profile else (0, 3, 2)
    cov = (num(16) - num(15) + 1) / F.greatest(num(length), F.lit(1.0))
    out = rows.select("path", "pos", F.get("c", F.lit(profile)).alias("profile"), F.get("c", F.lit(profile + 1)).alias("accession"), F.get("c", F.lit(protein)).alias("protein_id"), num(12).alias("i_evalue"), num(13).alias("score"), num(at).cast("int").alias("start"), num(at + 1).cast("int").alias("end"), cov.alias("coverage"))
    out = out.filter("i_evalue is not null and start is not null and end is not null")
    if e_value is not None:
        out = out.filter(F.col("i_evalue") <= e_value)
    return out if coverage is None else out.filter(F.col("coverage") >= coverage)


def embeddings(df: DataFrame, vector: Column) -> DataFrame:
    """``df`` with unit vectors in double precision; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("_n", F.when(norm == 0, 1.0).otherwise(norm)).withColumn("unit", F.transform(vector, lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def embedding_shards(spark: SparkSession, path: str, vector: str = "emb") -> DataFrame:
    """The rows of all shards with ``shard`` (the file's name) and ``place`` in it, whose order is that of the shards joined by name; vectors as units."""
    df = spark.read.parquet(path).withColumns({"shard": F.col("_metadata.file_name"), "place": F.col("_metadata.row_index")})
    return embeddings(df, F.col(vector))


# Where a result folder has its overview tables and its coordinates.
OVERVIEWS, COORDINATES = "/cazyme/dbcan/cazyme_annotation/[^/]+_overview[.]tsv$", "/annotation/prokka/.*[.]gff$"


def samples(spark: SparkSession, root: str) -> DataFrame:
    """(sample, overview, gff) of a result folder: samples by their overview table, joined with those that have coordinates."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    over = files.filter(F.col("path").rlike(OVERVIEWS)).select(F.regexp_extract("path", "/([^/]+)_overview[.]tsv$", 1).alias("sample"), F.col("path").alias("overview"))
    gff = files.filter(F.col("path").rlike(COORDINATES)).select(F.regexp_extract("path", "/([^/]+)/[^/]+[.]gff$", 1).alias("sample"), "path")
    own = F.when(F.regexp_extract("path", "/([^/]+)[.]gff$", 1) == F.col("sample"), 0).otherwise(1)
    best = gff.groupBy("sample").agg(F.min(F.struct(F.when(F.col("path").contains("/prokka/all/"), 0).otherwise(1).alias("a"), own.alias("b"), "path"))["path"].alias("gff"))
    return over.join(best, "sample", "full").orderBy("sample")


def manifest(spark: SparkSession, path: str, tools: list[str]) -> DataFrame:
    """(base, sample_key, kind, tool, feature_type, path, id_col, family_col, confidence_col): a row for each file of a manifest; a tool that is not known is an error."""
    text = "string"
    prediction = f"array<struct<tool:{text},path:{text},id_col:{text},family_col:{text},confidence_col:{text}>>"
    feature = f"array<struct<tool:{text},path:{text},feature_type:{text}>>"
    m = spark.read.schema(f"samples array<struct<sample_key:string,cazyme_predictions:{prediction},protein_features:{feature}>>").json(path, multiLine=True)
    s = m.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("base"), F.explode("samples").alias("s"))
    p = s.select("base", "s.sample_key", F.lit("prediction").alias("kind"), F.explode("s.cazyme_predictions").alias("f")).select("base", "sample_key", "kind", "f.tool", F.lit(None).cast("string").alias("feature_type"), "f.path", "f.id_col", "f.family_col", "f.confidence_col")
    known = F.col("tool").isin(*tools)
    p = p.withColumn("tool", F.when(known, F.col("tool")).otherwise(F.raise_error(F.concat(F.lit("unknown tool "), F.coalesce("tool", F.lit("null"))))))
    none = F.lit(None).cast("string")
    f = s.select("base", "s.sample_key", F.lit("feature").alias("kind"), F.explode("s.protein_features").alias("f")).select("base", "sample_key", "kind", "f.tool", "f.feature_type", "f.path", none.alias("id_col"), none.alias("family_col"), none.alias("confidence_col"))
    return p.unionByName(f).withColumn("path", F.concat_ws("/", "base", "path"))


def method_predictions(spark: SparkSession, path: str, tool: str, methods: DataFrame, id_: str | None = None, family: str | None = None, confidence: str | None = None) -> DataFrame:
    """(protein_id, family, confidence, ec, all_families, extra, tool) of a method's own table, read by its row in ``methods``.

    The row names the columns (arguments override it; a method that is not
    registered has protein_id, family and confidence) and those that go into
    the JSON object ``extra``.  Of several families in a cell the first is the
    call and ``all_families`` has all.  Rows without an id go; one without a
    family abstains.  Adding a method is adding a row.
    """
    row = methods.filter(F.col("key") == tool).first()
    pick = {k: row[k] if row and row[k] else v for k, v in COLUMNS.items()}
    df = delimited(spark, path)
    cell = lambda c: cleaned(F.col(f"`{c}`"), "advanced") if c in df.columns else F.lit(None).cast("string")
    first, every = primary_family(cell(family or pick["family_column"]))
    extra = json_object({c: F.col(f"`{c}`") for c in (row["extra"] if row else []) if c in df.columns})
    out = df.select(cell(id_ or pick["id_column"]).alias("protein_id"), first.alias("family"), cell(confidence or pick["confidence_column"]).try_cast("double").alias("confidence"), cell("ec").alias("ec"), every.alias("all_families"), extra.alias("extra"), F.lit(tool).alias("tool"))
    return out.filter("protein_id is not null")


#: Fixed values.  By type of feature: columns for label, score, start, end and path, and columns that join the attributes.  A label after "=" is a constant.
FEATURES: dict[str, tuple[dict[str, str], list[str]]] = {
    "signal_peptide": ({"label": "prediction", "score": "sp_prob", "end": "cs_position"}, []),
    "tm_topology": ({"label": "prediction", "score": "n_tm"}, ["topology"]),
    "structure": ({"label": "source", "score": "plddt", "path": "path"}, ["length", "source"]),
    "domain": ({"label": "name", "score": "score", "start": "start", "end": "end"}, ["acc", "evalue"]),
    "structure_hit": ({"label": "target_family", "score": "tmscore"}, ["target", "prob", "lddt", "evalue"]),
    "localization": ({"label": "localization", "score": "confidence"}, ["method"]),
    "physicochem": ({"label": "=physicochem", "score": "mw_da"}, ["pi", "instability", "gravy", "aromaticity"]),
    "ec_prediction": ({"label": "ec_number", "score": "confidence"}, ["rank"]),
}


def features(spark: SparkSession, path: str, feature_type: str, tool: str) -> DataFrame:
    """(protein_id, feature_type, tool, label, score, start, end, structure_path, attributes) of a feature table.

    Attributes are the JSON object of ``extra``, a map of texts, and the type's
    own columns over it.  Of a type that is not known the whole row is kept as
    attributes.
    """
    df = delimited(spark, path)
    cell = lambda c: cleaned(F.col(f"`{c}`"), "advanced") if c in df.columns else F.lit(None).cast("string")
    known = feature_type in FEATURES
    fields, more = FEATURES.get(feature_type, ({}, df.columns))
    own = F.map_filter(F.create_map(*[x for c in more for x in (F.lit(c), cell(c))]), lambda _, v: v.isNotNull()) if more else F.create_map().cast("map<string,string>")
    extra = F.coalesce(F.from_json(cell("extra"), "map<string,string>"), F.create_map().cast("map<string,string>")) if known else F.create_map().cast("map<string,string>")
    kept = F.map_filter(extra, lambda k, _: ~F.map_contains_key(own, k))

    def of(name: str):
        c = fields.get(name)
        return F.lit(None).cast("string") if c is None else F.lit(c[1:]) if c.startswith("=") else cell(c)

    out = df.select(cell("protein_id").alias("protein_id"), F.lit(feature_type).alias("feature_type"), F.lit(tool).alias("tool"), of("label").alias("label"), of("score").try_cast("double").alias("score"), whole(of("start")).alias("start"), whole(of("end")).alias("end"), of("path").alias("structure_path"), F.map_concat(kept, own).alias("attributes"))
    return out.filter("protein_id is not null")


def wanted_rows(spark: SparkSession, path: str, wanted: DataFrame, id_column: int, least: int) -> DataFrame:
    """(id, c) of the rows of (compressed) tables whose id is wanted; rows of fewer than ``least`` columns are skipped."""
    c = F.split("line", "\t")
    rows = lines(spark, path).filter(F.size(c) >= least).select(F.get(c, F.lit(id_column)).alias("id"), c.alias("c"))
    return rows.join(wanted.select(F.col(wanted.columns[0]).alias("id")).distinct(), "id", "left_semi")


def structure_hits(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(protein_id, target, target_family, tmscore, lddt, evalue, bits, fident, rank): the k hits of most bits of each query, in the order of file names and then of lines where they tie.

    A file may have a header, which names its columns; else they stand in the
    usual order.
    """
    c = F.split("line", "\t")
    all_ = lines(spark, path).filter("line <> ''").select("path", "pos", c.alias("c"))
    head = all_.groupBy("path").agg(F.min("pos").alias("top"), F.transform(F.min_by("c", "pos"), F.lower).alias("h"))
    # A row for each file.
    j = all_.join(F.broadcast(head), "path").withColumn("named", F.array_contains("h", "query")).filter(~F.col("named") | (F.col("pos") != F.col("top")))

    def at(place: int, *names: str):
        found = F.coalesce(*[F.nullif(F.array_position("h", n), F.lit(0)) for n in names]).cast("int") - 1
        return F.when(F.col("named"), F.get("c", found)).otherwise(F.get("c", F.lit(place)) if place >= 0 else F.element_at("c", -1))

    num = lambda x: F.nullif(x, F.lit("")).try_cast("double")
    rows = j.select("path", "pos", at(0, "query").alias("protein_id"), at(1, "target").alias("target"), num(at(-1, "alntmscore", "tmscore")).alias("tmscore"), num(at(-1, "lddt")).alias("lddt"), F.coalesce(num(at(10, "evalue")), F.lit(0.0)).alias("evalue"), F.coalesce(num(at(11, "bits")), F.lit(0.0)).alias("bits"), F.coalesce(num(at(2, "fident")), F.lit(0.0)).alias("fident")).filter("protein_id <> ''")
    family = F.coalesce(F.nullif(F.regexp_extract("target", r"([A-Z]{2,3}\d+)", 1), F.lit("")), F.lit("-"))
    return first_by(rows.withColumn("target_family", family), ["protein_id"], F.desc("bits"), F.asc("path"), F.asc("pos"), n=k, rank="rank").drop("path", "pos")


def topology(spark: SparkSession, gff: str, three_line: str) -> DataFrame:
    """(protein_id, length, n_tm, regions, category, topology): regions as ``type:start-end`` joined by "|", and the three-line file's category and string."""
    rows = lines(spark, gff).filter("line <> '' and line not like '//%'")
    size = rows.select(F.regexp_extract("line", r"^#\s+(\S+)\s+Length:\s+(\d+)", 1).alias("protein_id"), F.regexp_extract("line", r"Length:\s+(\d+)", 1).try_cast("int").alias("length")).filter("protein_id <> ''").groupBy("protein_id").agg(F.max("length").alias("length"))
    tm = rows.select(F.regexp_extract("line", r"^#\s+(\S+)\s+Number of predicted TMRs:\s+(\d+)", 1).alias("protein_id"), F.regexp_extract("line", r"TMRs:\s+(\d+)", 1).try_cast("int").alias("n_tm")).filter("protein_id <> ''").groupBy("protein_id").agg(F.max("n_tm").alias("n_tm"))
    c = F.split("line", "\t")
    seg = rows.filter(~F.col("line").startswith("#") & (F.size(c) >= 4)).select(F.get(c, F.lit(0)).alias("protein_id"), "pos", F.get(c, F.lit(1)).alias("t"), F.get(c, F.lit(2)).try_cast("int").alias("a"), F.get(c, F.lit(3)).try_cast("int").alias("b")).filter("a is not null and b is not null")
    named = seg.groupBy("protein_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("", "t", F.lit(":"), "a", F.lit("-"), "b").alias("x")))), lambda s: s["x"]), "|").alias("regions"))
    pos = F.col("_metadata.file_block_start")
    records = spark.read.option("lineSep", "\n>").text(three_line).select(pos.alias("block"), F.split(F.regexp_replace("value", "^>", ""), r"\r?\n").alias("l"))
    parts = F.split(F.get("l", F.lit(0)), r"\|")
    three = records.select(F.regexp_extract(F.get(parts, F.lit(0)), r"^\s*(\S+)", 1).alias("protein_id"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("category"), F.coalesce(F.get("l", F.lit(2)), F.lit("")).alias("topology")).filter("protein_id <> ''")
    out = size.join(tm, "protein_id", "full").join(named, "protein_id", "full").join(three, "protein_id", "full")
    return out.select("protein_id", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("n_tm", F.lit(0)).alias("n_tm"), F.coalesce("regions", F.lit("")).alias("regions"), "category", "topology")


def ranked_ec(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, ec_number, confidence, rank) of ragged rows ``id,EC:number/value,...``; cells that do not parse take no rank."""
    c = F.split("line", ",")
    rows = lines(spark, path).filter(F.size(c) >= 2).select(F.get(c, F.lit(0)).alias("protein_id"), F.slice(c, F.lit(2), F.size(c)).alias("cells"))
    one = lambda x, g: F.regexp_extract(x, r"(?:EC:|^\s*(?=[\d.]+:))([\d.\-]+)[/:]?([\d.]+)?", g)
    read = F.filter(F.transform("cells", lambda x: F.struct(one(x, 1).alias("ec_number"), F.coalesce(F.nullif(one(x, 2), F.lit("")).try_cast("double"), F.lit(0.0)).alias("confidence"))), lambda s: s["ec_number"] != "")
    return rows.select("protein_id", F.posexplode(read).alias("i", "x")).select("protein_id", "x.ec_number", "x.confidence", (F.col("i") + 1).alias("rank"))


def with_score_type(ranked: DataFrame) -> DataFrame:
    """``ranked_ec`` with the kind of its values for each protein: gmm_confidence if none is above 1, else distance."""
    top = ranked.groupBy("protein_id").agg(F.max(F.nanvl("confidence", F.lit(None).cast("double"))).alias("_top"))
    return ranked.join(top, "protein_id").withColumn("score_type", F.when(F.col("_top") <= 1, "gmm_confidence").otherwise("distance")).drop("_top")


def interpro_map(spark: SparkSession, path: str) -> DataFrame:
    """(pfam, interpro, description) of lines ``PFxxxxx.v <TAB> IPRxxxxxx [<TAB> description]``; the last line of an accession counts, a missing description is a dash."""
    c = F.split("line", "\t")
    rows = lines(spark, path).filter((F.size(c) >= 2) & F.get(c, F.lit(0)).startswith("PF")).select("path", "pos", F.substring_index(F.get(c, F.lit(0)), ".", 1).alias("pfam"), F.trim(F.get(c, F.lit(1))).alias("interpro"), F.coalesce(F.nullif(F.trim(F.get(c, F.lit(2))), F.lit("")), F.lit("-")).alias("description"))
    last = rows.filter(F.col("interpro").startswith("IPR")).groupBy("pfam").agg(F.max_by(F.struct("interpro", "description"), F.struct("path", "pos")).alias("x"))
    return last.select("pfam", "x.*")


def signal_results(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, prediction, probability): the probability of the predicted class, whose column a comment line names."""
    all_ = lines(spark, path).filter("trim(line) <> ''")
    named = F.col("line").startswith("#") & F.col("line").contains("Prediction") & F.col("line").contains("\t")
    head = all_.filter(named).groupBy("path").agg(F.max_by(F.split(F.trim(F.ltrim("line", F.lit("#"))), "\t"), "pos").alias("h"))
    c = F.split("line", "\t")
    rows = all_.filter(~F.col("line").startswith("#")).select("path", c.alias("c")).join(head, "path", "left").filter(F.get("c", F.lit(0)) != "")
    kind = F.trim(F.coalesce(F.get("c", F.lit(1)), F.lit("")))
    place = F.array_position(F.transform("h", lambda x: F.upper(F.substring_index(F.trim(x), "(", 1))), F.upper(kind)).cast("int") - 1
    p = F.when((F.size("h") == F.size("c")) & (place >= 0), F.get("c", place)).try_cast("double")
    return rows.select(F.get("c", F.lit(0)).alias("protein_id"), F.when(kind == "OTHER", "NO_SP").otherwise(kind).alias("prediction"), p.alias("probability"))


def structures(spark: SparkSession, path: str) -> DataFrame:
    """(path, mean, n_residues): the mean of the B-factor column over CA atoms (all atoms where there is none) on a scale of 100, and different residues."""
    row = lines(spark, path).filter(F.col("line").rlike("^(ATOM|HETATM)"))
    part = lambda a, n: F.trim(F.substring("line", a, n))
    x = row.select("path", F.when(F.length("line") >= 66, part(61, 6).try_cast("double")).alias("b"), (part(13, 4) == "CA").alias("ca"), F.when(F.col("line").startswith("ATOM") & (F.length("line") >= 27), F.substring("line", 22, 6)).alias("residue"))
    g = x.groupBy("path").agg(F.avg(F.when(F.col("ca"), F.col("b"))).alias("c"), F.avg("b").alias("a"), F.count_distinct("residue").alias("n_residues"))
    mean = F.coalesce("c", "a", F.lit(0.0))
    return g.select("path", F.round(F.when(mean <= 1.5, mean * 100).otherwise(mean), 1).alias("mean"), "n_residues")


def go_of_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, go_terms) of a mapping file, terms in file order, each once."""
    x = lines(spark, path).filter(F.col("line").startswith("Pfam:")).select("pos", F.regexp_extract("line", r"(PF\d{5})", 1).alias("domain"), F.regexp_extract(F.trim("line"), r"(GO:\d{7})\s*$", 1).alias("go")).filter("domain <> '' and go <> ''")
    return x.groupBy("domain").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "go"))), lambda s: s["go"])).alias("go_terms"))


def fold_strings(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, fold): names lose the suffix of their structure file, folds are lower case; rows of fewer than three columns are skipped."""
    c = F.split("line", "\t")
    return lines(spark, path).filter(F.size(c) >= 3).select(F.regexp_replace(F.get(c, F.lit(0)), r"[.]pdb_A$", "").alias("id"), F.get(c, F.lit(1)).alias("sequence"), F.lower(F.get(c, F.lit(2))).alias("fold"))


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, loss, accuracy) of the lines that report an epoch."""
    pattern = r"epoch\s+(\d+)\s+loss\s+([\d.]+)\s+val_clf_acc\s+([\d.]+)"
    got = lambda i: F.regexp_extract("line", pattern, i)
    return lines(spark, path).filter(F.col("line").rlike(pattern)).select(got(1).cast("int").alias("epoch"), got(2).try_cast("double").alias("loss"), got(3).try_cast("double").alias("accuracy"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def software_versions(spark: SparkSession, path: str) -> DataFrame:
    """(tool, version) of a file of two levels, process and tool; of a tool that several processes name the last counts.

    Versions are kept as they are written.  No file gives no rows.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "tool string, version string")
    pair = r"^\s+([^#:]+):\s*(\S.*)$"
    bare = F.trim(F.regexp_replace("line", r"\s+#.*$", ""))
    unquoted = lambda i: F.regexp_replace(F.trim(F.regexp_extract(F.concat(F.lit(" "), bare), pair, i)), "^(['\"])(.*)\\1$", "$2")
    rows = lines(spark, path).filter(F.col("line").rlike(pair)).select("pos", F.lower(unquoted(1)).alias("tool"), unquoted(2).alias("version")).filter("tool <> ''")
    return rows.groupBy("tool").agg(F.max_by("version", "pos").alias("version"))


def samplesheet(spark: SparkSession, path: str) -> DataFrame:
    """(sample, row): the columns of each row by name, under its sample or sample_id; the last row of a sample counts.  No file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "sample string, row map<string,string>")
    df = delimited(spark, path, sep=",")
    keys = [F.when(F.col(c) != "", F.col(c)) for c in ("sample", "sample_id") if c in df.columns]
    if not keys:
        return spark.createDataFrame([], "sample string, row map<string,string>")
    row = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    rows = df.select(F.coalesce(*keys).alias("sample"), row.alias("row"), F.monotonically_increasing_id().alias("at")).filter("sample is not null")
    return rows.groupBy("sample").agg(F.max_by("row", "at").alias("row"))


def genomes(spark: SparkSession, root: str, needed: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Folders class/genome below ``root``, in order: (class, genome, files) of those with all files, and (class, genome, missing) of the others.

    ``needed`` are patterns of file names.  A folder that lacks one is no
    error: it goes to the second table.  ``limit`` takes the first folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    at = F.split(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    named = files.select(F.get(at, F.lit(0)).alias("class"), F.get(at, F.lit(1)).alias("genome"), "path").filter(F.size(at) >= 3)
    found = named.groupBy("class", "genome").agg(F.array_sort(F.collect_list("path")).alias("files"))
    if limit is not None:
        found = found.orderBy("class", "genome").limit(limit)
    lacks = F.filter(F.array(*[F.lit(p) for p in needed]).cast("array<string>"), lambda p: ~F.exists("files", lambda f: F.rlike(F.substring_index(f, "/", -1), p)))
    checked = found.withColumn("missing", lacks)
    return checked.filter(F.size("missing") == 0).select("class", "genome", "files"), checked.filter(F.size("missing") > 0).select("class", "genome", "missing")
