"""What the text operators share: table access, intermediate tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables in the folder that the cluster shares.

    Writing cuts the lineage, so a lost executor costs at most the tasks of
    the running job.  The folder is the one in ``spark.checkpoint.dir``; where
    that is unset, a temporary folder takes its place in local mode (tests),
    and anything else is an error, as executors do not share such a folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="evidar-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them, once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table of narrow rows may be broadcast: it is counted first, up to the bound."""
    return df.limit(rows + 1).count() <= rows


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    BOUND = 500_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.BOUND:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def split_words(text: Column) -> Column:
    """The same words as an array, in DataFrame functions."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multipliers, one for each place in a window.
ODD = np.random.RandomState(7).randint(0, 2**62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of n words; a shorter text is one window, an empty one none."""
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        h += w[i : len(w) - n + 1 + i] * ODD[i]
    return mix(h)


def connected_components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, label): for each node of ``edges`` (src, dst), the smallest node it reaches.

    Labels travel along edges and along labels, so long chains take a
    logarithmic number of rounds.  Every round is written, not collected.
    """
    both = ws.save(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), f"{name}-edges")
    labels = ws.save(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("m"))
        near = labels.join(near, labels.node == near.src, "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        near = ws.save(near, f"{name}-near-{turn}")
        far = near.select(F.col("node").alias("via"), F.col("via").alias("far"))
        step = near.join(far, "via", "left").select("node", F.least("via", "far").alias("label"), "old")
        step = ws.save(step, f"{name}-{turn}")
        changed = step.filter("label <> old").limit(1).count()
        ws.drop(f"{name}-{turn - 1}")
        ws.drop(f"{name}-near-{turn}")
        labels = step.select("node", "label")
        if not changed:
            return labels
