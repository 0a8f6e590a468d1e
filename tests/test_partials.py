"""Shards in order, regimes of scores, maps, FASTA scopes, folders that are not read."""

from pyspark.sql import functions as F

from evidar.operators import merge, metrics
from evidar.sources import readers, sinks


def test_shards_keep_their_order(spark, tmp_path):
    for name, ids in (("b.shard1", [3, 4]), ("a.shard0", [1, 2])):
        spark.createDataFrame([(i, [float(i), 0.0]) for i in ids], "id int, emb array<double>").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = readers.embedding_shards(spark, f"{tmp_path}/*.shard*").orderBy("shard", "place").collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["id"])
    assert sorted(by_shard.values()) == [[1, 2], [3, 4]] and all(r["unit"] == [1.0, 0.0] for r in got)


def test_score_regimes_and_interpro(spark, tmp_path):
    (tmp_path / "ec.csv").write_text("p1,EC:1.1.1.1/0.9,EC:2.1.1.1/0.1\np2,EC:1.1.1.1/4.5\n")
    got = {r["protein_id"]: r["score_type"] for r in readers.with_score_type(readers.ranked_ec(spark, str(tmp_path / "ec.csv"))).collect()}
    assert got == {"p1": "gmm_confidence", "p2": "distance"}
    (tmp_path / "map.tsv").write_text("PF00001.21\tIPR000276\tGPCR\nPF00002\tIPR000832\nPF00003\tnone\nX\tIPR1\nPF00001\tIPR999999\t \n")
    assert {tuple(r) for r in readers.interpro_map(spark, str(tmp_path / "map.tsv")).collect()} == {("PF00001", "IPR999999", "-"), ("PF00002", "IPR000832", "-")}


def test_fasta_scopes(spark, tmp_path):
    genes = spark.createDataFrame([("g1", "s1", "kinase", "MKV"), ("g2", "s1", None, "MAA"), ("g3", "s2", "x", None)], "gene_key string, sample_key string, product string, protein_seq string")
    for name, kw, want in (("all", {}, {"g1", "g2"}), ("gene", {"gene": "g2"}, {"g2"}), ("sample", {"sample": "s2"}, set())):
        sinks.write_gene_fasta(genes, f"{tmp_path}/{name}", **kw)
        text = "".join(f.read_text() for f in (tmp_path / name).glob("part-*"))
        assert {x[1:].split()[0] for x in text.splitlines() if x.startswith(">")} == want
    text = "".join(f.read_text() for f in (tmp_path / "all").glob("part-*"))
    assert ">g1 s1 kinase\n" in text and ">g2 s1\n" in text


def test_unwanted_folders_are_not_read(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 10).alias("p"), F.lit("x").alias("t")).write.partitionBy("p").parquet(f"{tmp_path}/t")
    wanted = spark.createDataFrame([(3, 13), (4, 5)], "p long, id long").filter("id > 0")
    got = merge.fetch(spark.read.parquet(f"{tmp_path}/t"), wanted, "p", "id")
    assert [r["id"] for r in got.collect()] == [13]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()


def test_curve_without_positives_and_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.4, True), (0.1, False)], "s double, y boolean")
    got = {(r["threshold"], round(r["precision"], 6), r["recall"]) for r in metrics.precision_recall_curve(df, "s", F.col("y")).collect()}
    assert got == {(0.9, 0.5, 0.5), (0.4, round(2 / 3, 6), 1.0), (0.1, 0.5, 1.0), (None, 1.0, 0.0)}


def test_clusters_of_genes(spark):
    m = spark.createDataFrame([("c", "g1", None, "", None, None, 1), ("c", "g2", "TC", "k2", 5, 9, 2), ("c", "g3", "A", "k3", 1, 4, 3), ("c", "g4", "TC", None, 7, 30, 4), ("e", "gx", "A", None, None, None, 1)], "cluster_key string, gene_key string, gene_type string, contig string, start int, end int, pos int")
    g = spark.createDataFrame([("g1", "k1", 0, 8), ("g4", "k4", 7, 50)], "gene_key string, contig string, start int, end int")
    s = spark.createDataFrame([("c", "xylan", 0.5)], "cluster_key string, substrate string, score double")
    got = {r["cluster_key"]: tuple(r)[1:] for r in merge.build_clusters(m, g, s).collect()}
    assert got == {"c": ("k2", 0, 50, "null×1, TC×2, A×1", 4, "xylan", 0.5), "e": ("?", 0, 0, "A×1", 1, None, None)}
