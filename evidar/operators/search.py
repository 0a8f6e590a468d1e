"""Texts that contain other texts: shared fingerprints find candidates, the texts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import scratch

#: Bytes of a gram and grams of a window, by the least bytes of an item: the first that fits is an item's tier.
TIERS = [(47, 16, 32), (15, 8, 8), (7, 4, 4), (3, 3, 1), (2, 2, 1), (1, 1, 1)]
#: Fingerprints of items that travel with a task, so that texts send only what may hit; beyond it both sides meet in a shuffle.
FEW = 200_000
#: Bytes of a text that are fingerprinted at once.
PIECE = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def folded(h: np.ndarray, width: int, join) -> np.ndarray:
    """One value for each ``width`` neighbours, joined from two overlapping parts, which double as they go."""
    done = 1
    while done < width and len(h):
        step = min(done, width - done)
        h = join(h[: max(len(h) - step, 0)], h[step:])
        done += step
    return h


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * ODD) ^ b
    return (h ^ (h >> np.uint64(29))) * ODD


def fingerprints(b: np.ndarray, k: int, w: int) -> np.ndarray:
    """The least hash of each w neighbouring grams of k bytes, each once: texts that share k + w - 1 bytes share one."""
    least = folded(folded(b.astype(np.uint64) * ODD, k, mixed), w, np.minimum)
    return np.unique(least[np.append(True, least[1:] != least[:-1])]) if len(least) else least


def marks(text: str | None, tier: int) -> np.ndarray:
    """All fingerprints of a text, piece by piece with overlaps, so that memory stays small for any length."""
    _, k, w = TIERS[tier]
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    span = k + w - 2
    parts = [fingerprints(b[at : at + PIECE + span], k, w) for at in range(0, max(1, len(b) - span), PIECE)]
    return np.unique(np.concatenate(parts))


def containing(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", few: int = FEW) -> DataFrame:
    """(doc, item) of each text of ``docs`` that contains the whole text of an item, wherever it begins or ends.

    An item is known by the least hash of its first window of grams; a text
    that contains it has that hash among its own, one for each window.  Texts
    that share a fingerprint with an item are candidates, and ``contains``
    decides.  Up to ``few`` items travel as hashes with the tasks; more meet
    the texts' fingerprints in a join by hash.  Texts are read once, however
    many items there are.  Items shorter than a window have smaller ones.

    An item without text is in every text that is not null; a null item or text
    is in none.  Repeated rows are found as often as they stand, and two texts
    under one id each by its own.
    """
    spark = docs.sparkSession
    root = scratch(spark, "containing")
    rows = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("t"))
    size = F.octet_length("t")
    tier = F.when(size == 0, -1)
    for i, (least, _, _) in enumerate(TIERS):
        tier = tier.when(size >= least, i)
    kind = rows.schema["item"].dataType.simpleString()

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, i in zip(b.column("t").to_pylist(), b.column("tier").to_pylist(), strict=True):
                _, k, w = TIERS[i]
                out.append(int(fingerprints(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)[: k + w - 1], k, w)[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["item", "t", "tier", "mark"])

    rows = rows.withColumn("tier", tier)
    rows.filter("tier >= 0").mapInArrow(anchor, f"item {kind}, t string, tier int, mark long").write.parquet(f"{root}/items")
    known = spark.read.parquet(f"{root}/items")
    tiers = sorted(r["tier"] for r in known.select("tier").distinct().collect())  # six at most
    wanted = known.select("tier", "mark").distinct()
    travel = {i: np.sort(np.array([r["mark"] for r in wanted.filter(F.col("tier") == i).collect()], np.int64)) for i in tiers} if wanted.limit(few + 1).count() <= few else None  # within ``few``

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in enumerate(b.column("t").to_pylist()):
                for i in tiers:
                    m = marks(t, i).astype(np.int64)
                    m = m if travel is None else m[np.isin(m, travel[i])]
                    if len(m):
                        yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array([at] * len(m))), b.column("key").take(pa.array([at] * len(m))), pa.array([i] * len(m), pa.int32()), pa.array(m)], names=["doc", "key", "tier", "mark"])

    given = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("t"), F.xxhash64(text).alias("key"))
    doc_kind = docs.schema[doc_id].dataType.simpleString()
    hits = given.mapInArrow(fingerprint, f"doc {doc_kind}, key long, tier int, mark long").join(known.select("tier", "mark", "item", F.col("t").alias("it")), ["tier", "mark"])
    hits.select("doc", "key", "item", "it").distinct().write.parquet(f"{root}/hits")
    same = given.withColumnsRenamed({"doc": "_doc", "key": "_key"})
    pairs = spark.read.parquet(f"{root}/hits")
    found = same.join(pairs, F.col("_key").eqNullSafe(pairs["key"]) & F.col("_doc").eqNullSafe(pairs["doc"])).filter(F.contains("t", "it")).select(F.col("_doc").alias(doc_id), F.col("item").alias(item_id))
    empty = rows.filter("tier = -1").select("item")
    if not empty.limit(1).count():
        return found
    # An item without text is in all texts, so this result is their product by its nature.
    return found.unionAll(given.select("doc").join(empty).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)))
