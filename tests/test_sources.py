"""Readers, sinks and ingest on small files of our own."""

import pytest
from pyspark.sql import functions as F

from evidar.sources import readers, sinks
from evidar.streaming import ingest


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_gff3(spark, tmp_path):
    path = put(tmp_path, "a.gff", "##gff-version 3\nc1\tx\tCDS\t10\t30\t.\t+\t0\tID=g1;locus_tag=L1;product=alpha%2Cbeta+x;product=last\nc1\tx\tCDS\tno\t30\t.\t+\t0\tID=g2\nc1\tx\tRNA\t5\t8\t.\t?\t.\tnote=x\nshort\n##FASTA\nc1\tx\tCDS\t1\t2\t.\t+\t0\tID=late\n")
    rows = {r["gene_key"]: r for r in readers.gff3(spark, path).collect()}
    assert set(rows) == {"L1", "c1:5-8"}
    assert rows["L1"]["product"] == "last" and rows["L1"]["length"] == 21 and rows["c1:5-8"]["strand"] is None


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.faa", ">p1 first\nMKV\nLA\n>p2\n\n>p1 again\nGG\n")
    got = readers.fasta(spark, path)
    assert {r["id"]: r["sequence"] for r in got.collect()} == {"p1": "MKVLAGG"}
    sinks.write_fasta(got, str(tmp_path / "out"))
    assert {r["id"]: r["sequence"] for r in readers.fasta(spark, str(tmp_path / "out" / "part-*")).collect()} == {"p1": "MKVLAGG"}


def test_overview(spark, tmp_path):
    path = put(tmp_path, "o.tsv", "Gene ID\tEC#\tHMMER\tdbCAN_sub\tDIAMOND\t#ofTools\ng1\t3.2.1.4\tGH13_31(12-390)\tN\tCBM48+GH13\t2\ng2\t-\t-\tN\t-\t0\n")
    got = {(r["gene_id"], r["tool"], r["family"]) for r in readers.overview(spark, path).collect()}
    assert got == {("g1", "HMMER", "GH13"), ("g1", "DIAMOND", "CBM48"), ("g1", "DIAMOND", "GH13")}
    with pytest.raises(ValueError):
        readers.overview(spark, put(tmp_path, "bad.tsv", "x\ty\n1\t2\n"))


def test_domains_clusters_substrates_resistance(spark, tmp_path):
    line = "p1\tmd5\t99\tPfam\tPF1\tdesc\t3\t50\t1e-5\tT\tdate\tIPR1\tname\tGO:0004553(x)|GO:0005975\n"
    d = readers.domains(spark, put(tmp_path, "d.tsv", line + "too\tshort\n")).collect()
    assert len(d) == 1 and d[0]["go_terms"] == ["GO:0004553", "GO:0005975"] and d[0]["interpro_acc"] == "IPR1"
    c = readers.gene_clusters(spark, put(tmp_path, "c.tsv", "CGC#\tGene Type\tContig ID\tProtein ID\tGene Start\tGene Stop\tDirection\tProtein Family\nC1\tCAZyme\tk\tp1\t5\t9.0\t+\tGH5\n")).first()
    assert (c["cluster_key"], c["start"], c["end"], c["family"]) == ("C1", 5, 9, "GH5")
    s = readers.substrates(spark, put(tmp_path, "s.tsv", "#Cluster ID\tBest hit\tSubstrate\tScore\nC1\tx\txylan\t0.5\nC1\ty\tstarch\t0.7\n")).collect()
    assert [(x["cluster_key"], x["substrate"], x["score"]) for x in s] == [("C1", "starch", 0.7)]
    r = readers.resistance(spark, put(tmp_path, "r.tsv", "input_file_name\tinput_protein_id\tgene_symbol\tdrug_class\tsequence_identity\nout/s1.x.faa\tp1\ttetA\ttetracycline\t98.5%\n")).first()
    assert (r["sample"], r["identity"], r["coverage"]) == ("s1", 98.5, None)


def test_predictions_skip_abstentions(spark, tmp_path):
    path = put(tmp_path, "p.tsv", 'protein_id\tfamily\tconfidence\textra\np1\tGH5\t0.9\t"{""a"": 1}"\np2\t-\t0.1\t\n')
    rows = readers.predictions(spark, path).collect()
    assert [(r["protein_id"], r["confidence"], r["extra"]) for r in rows] == [("p1", 0.9, {"extra": '{"a": 1}'})]


def test_files_are_read_in_splits(spark, tmp_path):
    path = put(tmp_path, "big.faa", "junk\n" + "".join(f">p{i} a > b\n{'MK' * 30}\nLA\n" for i in range(400)))
    gff = put(tmp_path, "b.gff", "".join(f"c\tx\tCDS\t{i}\t{i + 5}\t.\t+\t0\tID=g{i}\n" for i in range(1, 900)) + "##FASTA\nc\tx\tCDS\t1\t2\t.\t+\t0\tID=late\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.fasta(spark, path)
        assert readers.lines(spark, path).rdd.getNumPartitions() > 3
        assert {r["id"]: r["sequence"] for r in got.collect()} == {f"p{i}": "MK" * 30 + "LA" for i in range(400)}
        assert {r["gene_key"] for r in readers.gff3(spark, gff).collect()} == {f"g{i}" for i in range(1, 900)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_samples_and_manifest(spark, tmp_path):
    for f in ("cazyme/dbcan/cazyme_annotation/s1_overview.tsv", "annotation/prokka/all/s1/s1.gff", "annotation/prokka/all/s2/other.gff", "annotation/prokka/long/s1/s1.gff", "cazyme/dbcan/cazyme_annotation/s3_overview.tsv"):
        (tmp_path / "r" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / f).write_text("x")
    got = {r["sample"]: (r["overview"], r["gff"]) for r in readers.samples(spark, str(tmp_path / "r")).collect()}
    assert set(got) == {"s1", "s2", "s3"} and got["s1"][0] and got["s1"][1].endswith("all/s1/s1.gff") and got["s2"][0] is None and got["s3"][1] is None
    m = put(tmp_path, "manifest.json", '{"samples": [{"sample_key": "s1", "cazyme_predictions": [{"tool": "fusion", "path": "a/b.tsv", "family_col": "f"}],\n "protein_features": [{"feature_type": "domain", "tool": "x", "path": "d.tsv"}]}]}')
    rows = {r["kind"]: r for r in readers.manifest(spark, m, ["fusion"]).collect()}
    assert rows["prediction"]["path"].endswith("/a/b.tsv") and rows["prediction"]["family_col"] == "f" and rows["feature"]["feature_type"] == "domain"
    with pytest.raises(Exception, match="unknown tool"):
        readers.manifest(spark, m, ["other"]).collect()


def test_topology_signal_structures_and_maps(spark, tmp_path):
    g = put(tmp_path, "t.gff3", "##gff-version 3\n# p1 Length: 50\n# p1 Number of predicted TMRs: 1\np1\tsignal\t1\t20\np1\tTMhelix\t25\t45\n//\n# p2 Length: 9\n")
    three = put(tmp_path, "t.3line", ">p1 | SP+TM\nMKV\nSSO\n>p3 | GLOB\nMM\nII\n")
    rows = {r["protein_id"]: r for r in readers.topology(spark, g, three).collect()}
    assert rows["p1"]["regions"] == "signal:1-20|TMhelix:25-45" and rows["p1"]["n_tm"] == 1 and rows["p1"]["category"] == "SP+TM" and rows["p1"]["topology"] == "SSO"
    assert rows["p2"]["length"] == 9 and rows["p3"]["category"] == "GLOB"
    s = put(tmp_path, "s.txt", "# SignalP-6.0\n# ID\tPrediction\tOTHER\tSP(Sec/SPI)\tCS Position\np1\tSP\t0.1\t0.9\tCS\np2\tOTHER\t0.8\t0.2\t\n")
    assert sorted(map(tuple, readers.signal_results(spark, s).collect())) == [("p1", "SP", 0.9), ("p2", "NO_SP", 0.8)]
    atom = lambda name, chain, seq, b: f"ATOM      1 {name:<4} ALA {chain}{seq:>4}    {0:>8.3f}{0:>8.3f}{0:>8.3f}{1:>6.2f}{b:>6.2f}\n"
    pdb = put(tmp_path, "x.pdb", "HEADER\n" + atom(" CA", "A", 1, 0.80) + atom(" CB", "A", 1, 0.20) + atom(" CA", "A", 2, 0.60))
    r = readers.structures(spark, pdb).first()
    assert (r["mean"], r["n_residues"]) == (70.0, 2)
    go = put(tmp_path, "pfam2go", "!x\nPfam:PF00001 7tm > GO:b ; GO:0000002\nPfam:PF00001 7tm > GO:a ; GO:0000001\nPfam:PF00001 7tm > GO:b ; GO:0000002\n")
    assert readers.go_of_domains(spark, go).first()["go_terms"] == ["GO:0000002", "GO:0000001"]
    fold = put(tmp_path, "f.tsv", "a.pdb_A\tMK\tDV\nshort\tx\n")
    assert [tuple(x) for x in readers.fold_strings(spark, fold).collect()] == [("a", "MK", "dv")]


def test_profile_hit_variants(spark, tmp_path):
    row = "prot1 - 300 GH5.hmm - 200 1e-30 100 0 1 1 1e-20 1e-18 99.5 0 1 150 11 160 9 170 0.9 desc"
    path = put(tmp_path, "d.txt", "# head\n" + row + "\n" + row.replace("1e-18", "1e-3") + "\nshort row\n")
    one = readers.profile_hits(spark, path).collect()
    assert len(one) == 1 and (one[0]["protein_id"], one[0]["profile"], one[0]["start"], one[0]["end"], one[0]["coverage"]) == ("prot1", "GH5.hmm", 9, 170, 0.75)
    two = readers.profile_hits(spark, path, None, None, False, "alignment").collect()
    assert len(two) == 2 and (two[0]["protein_id"], two[0]["profile"], two[0]["start"], two[0]["coverage"]) == ("GH5.hmm", "prot1", 11, 0.5)


def test_structure_hits_tie_by_files(spark, tmp_path):
    """Equal bits stand in the order of files, whatever their lines; a larger file is cut by Spark, so one file is no order of all."""
    (tmp_path / "hits").mkdir()
    row = lambda target: f"p\t{target}\t0.5\t1\t1\t1\t1\t1\t1\t1\t1e-5\t7.0\n"
    put(tmp_path, "hits/b.tsv", row("GH3_c"))
    put(tmp_path, "hits/a.tsv", row("GH1_a") + row("GH2_b"))
    got = sorted((r["rank"], r["target"]) for r in readers.structure_hits(spark, str(tmp_path / "hits"), 3).collect())
    assert got == [(1, "GH1_a"), (2, "GH2_b"), (3, "GH3_c")]


def test_structure_hits_are_written_as_ranges(spark):
    from evidar.plans import reading_files

    plan = reading_files.hit_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_compressible_rows_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A million equal rows are a few KB on disk: the ledger goes to them, never they to the driver."""
    root = str(tmp_path / "wh")
    rows = spark.range(1_000_000).select(F.lit("s").alias("source"), F.lit(1.0).alias("x"))
    assert ingest.ingest(spark, rows, spark.createDataFrame([("s", "1")], "source string, checksum string"), root) == 1
    x = ingest.versions(spark, root)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and x.count() == 1_000_000
    monkeypatch.setattr(ingest, "ENTRIES", 0)
    y = ingest.versions(spark, root)
    assert "BroadcastHashJoin [source" not in y._jdf.queryExecution().executedPlan().toString() and y.count() == 1_000_000


def test_ingest_is_idempotent_and_versioned(spark, tmp_path):
    root = str(tmp_path / "wh")
    rows = spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, x int")
    sums = spark.createDataFrame([("s1", "a"), ("s2", "b")], "source string, checksum string")
    assert ingest.ingest(spark, rows, sums, root, "r1") == 2
    assert ingest.ingest(spark, rows, sums, root) == 0
    changed = spark.createDataFrame([("s1", "c"), ("s2", "b")], "source string, checksum string")
    assert ingest.ingest(spark, rows.withColumn("x", F.col("x") + 10), changed, root) == 1
    assert sorted((r["source"], r["x"], r["release"]) for r in ingest.current(spark, root).collect()) == [("s1", 11, 2), ("s2", 2, 1)]
    assert ingest.versions(spark, root).count() == 3
    # A run that is known is not taken again, and another source never hides one that is there.
    assert ingest.ingest(spark, rows.withColumn("x", F.lit(0)), changed.withColumn("checksum", F.lit("z")), root, "r1") == 0
    assert ingest.ingest(spark, rows.withColumn("source", F.lit("s3")), spark.createDataFrame([("s3", "q")], "source string, checksum string"), root) == 1
    assert {r["source"] for r in ingest.current(spark, root).collect()} == {"s1", "s2", "s3"}
    # What a failed run left behind is in no ledger.
    rows.withColumn("release", F.lit(9).cast("long")).write.parquet(f"{root}/rows/part_run=broken")
    assert ingest.current(spark, root).count() == 4


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both write at once; every source is there once, releases are gapless, and what both bring is taken once."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "wh")

    def write(w):
        for i in range(3):
            names = [f"w{w}-{i}", f"both-{i}"]
            rows = spark.createDataFrame([(n, w, i) for n in names], "source string, writer int, release int")
            ingest.ingest(spark, rows, spark.createDataFrame([(n, "sum") for n in names], "source string, checksum string"), root)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, (1, 2)))
    got = ingest.current(spark, root).collect()
    assert sorted(r["source"] for r in got) == sorted([f"w{w}-{i}" for w in (1, 2) for i in range(3)] + [f"both-{i}" for i in range(3)])
    assert {r["ingest_release"] for r in got} <= set(range(1, 7)) and all(r["release"] in (0, 1, 2) for r in got)
    assert ingest.sweep(spark, root, 3600) == 0
    spark.range(2).write.parquet(f"{root}/rows/part_run=orphan")
    assert ingest.sweep(spark, root, 0) >= 1 and not (tmp_path / "wh/rows/part_run=orphan").exists()
    assert len(ingest.current(spark, root).collect()) == len(got)


def test_a_source_of_several_parts(spark, tmp_path):
    root = str(tmp_path / "wh")
    schema, sums = "source string, part string, x int", "source string, part string, checksum string"
    assert ingest.ingest(spark, spark.createDataFrame([("s", "a", 1), ("s", "a", 2)], schema), spark.createDataFrame([("s", "a", "1")], sums), root) == 1
    assert ingest.ingest(spark, spark.createDataFrame([("s", "b", 3)], schema), spark.createDataFrame([("s", "b", "b1")], sums), root) == 1
    assert sorted(r["x"] for r in ingest.current(spark, root).collect()) == [1, 2, 3]
    assert ingest.ingest(spark, spark.createDataFrame([("s", "a", 9), ("s", "b", 3)], schema), spark.createDataFrame([("s", "a", "2"), ("s", "b", "b1")], sums), root) == 1
    assert sorted(r["x"] for r in ingest.current(spark, root).collect()) == [3, 9] and ingest.versions(spark, root).count() == 4


def test_stream_takes_each_file_once(spark, tmp_path):
    incoming, root = str(tmp_path / "in"), str(tmp_path / "wh")
    spark.range(5).coalesce(1).write.parquet(f"{incoming}/a")
    ingest.ingest_stream(spark, incoming, "id long", root)
    ingest.ingest_stream(spark, incoming, "id long", root)
    assert ingest.current(spark, root).count() == 5
    # A batch beside the stream, and a file of the same name in another folder.
    assert ingest.ingest(spark, spark.createDataFrame([("x", 100)], "source string, id long"), spark.createDataFrame([("x", "1")], "source string, checksum string"), root) == 1
    name = next(f.name for f in (tmp_path / "in" / "a").iterdir() if f.name.endswith(".parquet"))
    (tmp_path / "in" / "b").mkdir()
    spark.range(5, 8).coalesce(1).write.parquet(str(tmp_path / "other"))
    next((tmp_path / "other").glob("*.parquet")).rename(tmp_path / "in" / "b" / name)
    ingest.ingest_stream(spark, incoming, "id long", root)
    assert ingest.current(spark, root).count() == 9 and ingest.read_ledger(spark, root).count() == 3


def test_normalised_table_manifest_summary_and_log(spark, tmp_path):
    df = spark.createDataFrame([("p1", "GH5", 0.91234, "x", 3), ("p2", None, None, "y", 4)], "protein_id string, family string, confidence double, kind string, n int")
    sinks.write_predictions(df, str(tmp_path / "predictions"), ["kind", "n"])
    rows = {r["protein_id"]: r for r in readers.predictions(spark, str(tmp_path / "predictions"), abstentions=True).collect()}
    assert rows["p1"]["confidence"] == 0.9123 and rows["p1"]["extra"]["extra"] == '{"kind":"x","n":3}' and rows["p2"]["family"] is None
    sinks.write_manifest(spark, str(tmp_path / "m"), "s1", {"fusion": "predictions"}, {"d.tsv": ("domain", "x")}, pipeline="p")
    assert {r["kind"] for r in readers.manifest(spark, str(tmp_path / "m" / "part-*"), ["fusion"]).collect()} == {"prediction", "feature"}
    sinks.write_summary(df, str(tmp_path / "sum"), ["family"])
    assert readers.delimited(spark, str(tmp_path / "sum" / "detail")).count() == 2
    log = put(tmp_path, "log", "start\nepoch 5 loss 0.25 val_clf_acc 0.9\n")
    assert [tuple(r) for r in readers.training_log(spark, log).collect()] == [(5, 0.25, 0.9)]


def test_software_versions_and_samplesheet(spark, tmp_path):
    (tmp_path / "v.yml").write_text("# made by a run\nFIRST:\n  Tool: 1.10\n  other: '2.0'\nSECOND:\n    tool: \"3.1-b\"  # newer\nempty:\n")
    assert {r["tool"]: r["version"] for r in readers.software_versions(spark, f"{tmp_path}/v.yml").collect()} == {"tool": "3.1-b", "other": "2.0"}
    assert readers.software_versions(spark, f"{tmp_path}/none.yml").count() == 0
    (tmp_path / "s.csv").write_text("sample_id,group,sample\ns1,x,\n,y,s2\n,z,\ns1,w,\n")
    assert {r["sample"]: r["row"]["group"] for r in readers.samplesheet(spark, f"{tmp_path}/s.csv").collect()} == {"s1": "w", "s2": "y"}
    assert readers.samplesheet(spark, f"{tmp_path}/none.csv").count() == 0


def test_genomes_and_those_that_lack_a_file(spark, tmp_path):
    for c, g, names in (("b", "g3", ["overview.tsv", "x.faa"]), ("a", "g1", ["overview.tsv", "y.faa"]), ("a", "g2", ["overview.tsv"])):
        (tmp_path / "top" / c / g / "deep").mkdir(parents=True)
        for n in names:
            (tmp_path / "top" / c / g / "deep" / n).write_text("x")
    good, bad = readers.genomes(spark, f"{tmp_path}/top", ["^overview[.]tsv$", "[.]faa$"])
    assert sorted((r["class"], r["genome"], len(r["files"])) for r in good.collect()) == [("a", "g1", 2), ("b", "g3", 2)]
    assert [(r["class"], r["genome"], r["missing"]) for r in bad.collect()] == [("a", "g2", ["[.]faa$"])]
    assert readers.genomes(spark, f"{tmp_path}/top", [], limit=1)[0].count() == 1
