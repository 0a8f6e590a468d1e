"""Versioned, idempotent ingest: a ledger of file checksums, appended tables, and file streams."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "source string, part string, checksum string, release long, run string"
#: Attempts at a commit before a writer gives up.
ATTEMPTS = 100
#: Entries of a ledger that may travel to the tasks that read rows.
ENTRIES = 20_000


def _files(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file unless it is there; storage decides between two writers."""
    files, where = _files(spark, path)
    try:
        out = files.create(where, False)
    except Exception as e:  # the JVM's FileAlreadyExistsException
        if "AlreadyExists" in str(e) or files.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def signature(files: DataFrame) -> DataFrame:
    """(source, checksum) from (source, role, content): a hash over the sorted "role:hash" of a source's files."""
    each = files.select("source", F.concat_ws(":", "role", F.sha2("content", 256)).alias("h"))
    return each.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "|").cast("binary"), 256).alias("checksum"))


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """(source, part, checksum, release, run) of every commit: a commit is a file that names its release, its run and its table of entries."""
    files, where = _files(spark, f"{root}/ledger")
    if not files.exists(where) or not files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger/*.json")):
        return spark.createDataFrame([], LEDGER)
    commits = spark.read.schema("release long, run string, attempt string").json(f"{root}/ledger/*.json")
    entries = spark.read.schema("source string, part string, checksum string, attempt string").parquet(f"{root}/entries")
    return entries.join(F.broadcast(commits), "attempt").select("source", "part", "checksum", "release", "run")  # a row for each commit


def _with_part(df: DataFrame) -> DataFrame:
    return df if "part" in df.columns else df.withColumn("part", F.lit(""))


def ingest(spark: SparkSession, rows: DataFrame, sources: DataFrame, root: str, run: str | None = None) -> int:
    """Appends the rows of sources whose checksum is not known, as one new release; returns how many it took.

    ``rows`` has a column source, ``sources`` is (source, checksum); both may
    have ``part``, which tells the files of a source apart: a source is then
    what its parts hold, whichever release or batch brought them, and a changed
    part replaces that part alone.  What is replaced stays as a version.  The
    same content of a source is taken once, under whichever part it comes.

    Any number of writers may work at once.  Rows go to a folder of the run and
    entries to a folder of the attempt; the commit is one small file named by
    the next release, created only if it is not there.  A writer that finds it
    there reads the ledger again, drops what others have brought meanwhile, and
    tries the next release.  What a failed run has left is in no commit, so no
    reader sees it; the same run writes it anew, and ``sweep`` removes it.  A
    run that the ledger knows is not taken again.  Columns of ``rows`` may have
    any names.
    """
    run = run or uuid.uuid4().hex
    named = _with_part(sources).groupBy("source", "checksum").agg(F.min("part").alias("part")).select("source", "part", "checksum")
    written = False
    for _ in range(ATTEMPTS):
        ledger = read_ledger(spark, root)
        if ledger.filter(F.col("run") == run).limit(1).count():
            return 0
        release = (ledger.agg(F.max("release")).first()[0] or 0) + 1
        attempt = uuid.uuid4().hex
        entries = f"{root}/entries/attempt={attempt}"
        named.join(ledger, ["source", "checksum"], "left_anti").write.parquet(entries)
        taken = spark.read.schema("source string, part string, checksum string").parquet(entries)
        n = taken.count()
        if n and not written:
            data = [c for c in rows.columns if c not in ("source", "part")]
            packed = _with_part(rows).select("source", "part", F.struct(*[F.col(f"`{c}`") for c in data]).alias("row"))
            packed.join(taken.select("source", "part"), ["source", "part"], "left_semi").write.mode("overwrite").parquet(f"{root}/rows/part_run={run}")
            written = True  # a later attempt takes the same or fewer sources
        if not n or _put_if_absent(spark, f"{root}/ledger/{release:012d}.json", json.dumps({"release": release, "run": run, "attempt": attempt})):
            return n
    raise RuntimeError(f"{root}: no commit in {ATTEMPTS} attempts")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All rows of every release that the ledger lists, with their release (``ingest_release`` where the rows have one of their own)."""
    ledger = read_ledger(spark, root)
    newest = ledger.agg(F.max_by("run", "release")).first()[0]
    if newest is None:
        return spark.createDataFrame([], "source string, release long")
    kind = spark.read.parquet(f"{root}/rows/part_run={newest}").schema
    rows = spark.read.schema(kind.add("part_run", "string")).parquet(f"{root}/rows")
    entries = ledger.select("source", "part", F.col("run").alias("part_run"), F.col("release").alias("_release"))
    # Rows that compress well look small enough to be broadcast and are not, so the ledger's side is said: it is sent if it is short, else both are sorted.
    entries = F.broadcast(entries) if entries.limit(ENTRIES + 1).count() <= ENTRIES else entries.hint("merge")
    of = rows.join(entries, ["source", "part", "part_run"])
    name = "ingest_release" if "release" in kind["row"].dataType.names else "release"
    return of.select("source", "row.*", F.col("_release").alias(name), F.col("part").alias("_part"))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of each source as it is now: of every part the newest release."""
    newest = read_ledger(spark, root).groupBy("source", F.col("part").alias("_part")).agg(F.max("release").alias("_newest"))
    x = versions(spark, root)
    if "_part" not in x.columns:
        return x
    name = "ingest_release" if "ingest_release" in x.columns else "release"
    kept = x.join(newest.withColumnRenamed("_newest", name), ["source", "_part", name], "left_semi")
    return kept.drop("_part")


def sweep(spark: SparkSession, root: str, older_than: float = 86_400.0) -> int:
    """Removes folders of runs and attempts that no commit names and that are older than so many seconds; returns how many.

    The age keeps what a writer is still at.
    """
    commits = spark.read.schema("release long, run string, attempt string").json(f"{root}/ledger/*.json").collect() if _files(spark, root)[0].globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger/*.json")) else []
    known = {f"part_run={c['run']}" for c in commits} | {f"attempt={c['attempt']}" for c in commits}  # names, a row for each commit
    removed = 0
    for folder in ("rows", "entries"):
        files, where = _files(spark, f"{root}/{folder}")
        for status in files.listStatus(where) if files.exists(where) else []:
            if status.getPath().getName() not in known and time.time() - status.getModificationTime() / 1000 >= older_than:
                files.delete(status.getPath(), True)
                removed += 1
    return removed


def ingest_stream(spark: SparkSession, incoming: str, schema: str, root: str, source: Callable[[Column], Column] = lambda path: path) -> None:
    """Takes all new files of a folder in one go; a file is a part of a source, its rows are its content.

    ``source`` names a source by its path: by default files of equal names in
    different folders are different sources.  Files of one source may come in
    different batches and are its parts all the same; a file that comes again
    with other rows under the same path replaces its part.
    """
    path = F.col("_metadata.file_path")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(incoming).withColumn("source", source(path)).withColumn("part", path)

    def take(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            data = batch.columns[:-2]
            sums = batch.groupBy("source", "part").agg(F.sha2(F.concat_ws(",", F.count("*"), F.sum(F.xxhash64(*data).cast("decimal(38,0)"))).cast("binary"), 256).alias("checksum"))
            ingest(spark, batch, sums, root, f"stream-{batch_id}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Extension: events by type in tumbling windows, with a watermark when it is a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
