"""Stupid-backoff scores of documents, from n-gram count tables of orders 1 to 3.

A word scores log(count of its triple / count of the triple's first pair); where
an n-gram has no count it backs off to the next order, by BACKOFF each time.
Every count above zero counts, and the counts are those of the documents that
are scored, so only the start of a text backs off: its second word has no
triple, its first word no pair either, and scores by its share of all words.

A text's score is therefore a sum of logarithms of single counts.  The count
tables are partitioned by a hash of the n-gram's first pair, which holds the
count of that pair and of every triple that begins with it, so each word of a
text travels once.  To keep the shuffle small, a task packs the n-grams of a
chunk of texts, sorted by hash, into one array for each bucket; the bucket
counts, joins the counts to the n-grams it was sent, and sends back one sum for
each text of the chunk; the sums of a chunk are added up.

Pairs that stand in a large part of all texts would fill single buckets.  A
sample of texts names them; they and their frequent triples are counted in a
pass of their own, which sends one row for each task and n-gram, and what they
add is known before the shuffle.  Their other triples are dealt by the triple.
The sample decides which way an n-gram goes, never a count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, WordHashes, Workspace, mix, table, words_of

BACKOFF = 0.4
#: Words packed at a time by a task; words of a bucket, on average; buckets at least.
CHUNK_WORDS, BUCKET_WORDS, LEAST_BUCKETS = 1 << 19, 1 << 21, 24
#: Texts of the sample that names hot n-grams, and the share of them that makes one hot.
HOT_TEXTS, HOT_SHARE = 2_000, 0.01
#: Hashes of pairs keep 60 bits.  A word's hash within a triple keeps 32: it only tells apart what follows the same pair.
KEY, NEXT = 60, np.uint64((1 << 32) - 1)
#: Sums travel as whole multiples of this, so they do not depend on the order of addition.
UNIT = 2.0**-32
#: Planes of bytes that are packed, by column: hash of the pair, word after it (0: none), place of the text, occurrences, adds the pair's own count.
PLANES = {"key": 8, "next": 4, "place": 3, "tf": 4, "own": 1}


def _pack(values: np.ndarray, planes: int = 8) -> bytes:
    """Bytes of equal rank stand together, so the high ones compress."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, :planes].T)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, planes: int = 8) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * planes, codec="zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = raw.reshape(planes, n).T
    return out.reshape(-1).view("<u8")


def _pack_sums(x: np.ndarray) -> bytes:
    v = np.rint(x / UNIT).astype(np.int64)
    return _pack(((v << 1) ^ (v >> 63)).view(np.uint64))


def _unpack_sums(data: bytes, n: int) -> np.ndarray:
    v = _unpack(data, n)
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, hashes of the words) of the texts of a task, so many words at a time."""
    hashes, ids, held, n = WordHashes(), [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            held.append(hashes.of(words_of(t)))
            n += len(held[-1]) + 1
            if n >= words:
                yield ids, held
                ids, held, n = [], [], 0
    if ids:
        yield ids, held


def _flat(held: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Words of all texts, the place of their text, what remains behind them in it, and whether they begin it."""
    sizes = np.array([len(w) for w in held])
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint64), sizes), np.repeat(sizes, sizes) - 1 - at, at == 0


def _key(h: np.ndarray) -> np.ndarray:
    return mix(h) >> np.uint64(64 - KEY)


def _keys(flat: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of pairs, their hashes, and the hashes of the words after them (0 at the end of a text)."""
    pair = np.flatnonzero(left > 0)
    with np.errstate(over="ignore"):
        key = _key(flat[pair] * ODD[0] + flat[pair + 1] * ODD[1])
        after = mix(flat[np.minimum(pair + 2, len(flat) - 1)] * ODD[2]) & NEXT
    after[after == 0] = 1
    after[left[pair] < 2] = 0
    return pair, key, after


def _triple(key: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _key(key * ODD[3] + after * ODD[4])


def _known(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands among the sorted ones, and whether it does."""
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return i, sorted_values[i] == values


def _grams_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, pair or triple) of each text of the sample, once for each text."""
    for _, held in chunks(batches, 1):
        flat, _, left, _ = _flat(held)
        _, key, after = _keys(flat, left)
        for kind, h in ((2, key), (3, _triple(key, after)[after > 0])):
            h = np.unique(h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), kind, np.int32))], names=["gram", "kind"])


def _counted(hot: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(h), np.int64) for k, h in hot.items()}
        for _, held in chunks(batches, CHUNK_WORDS):
            flat, _, left, _ = _flat(held)
            _, key, after = _keys(flat, left)
            i, known = _known(hot[2], key)
            sums[2] += np.bincount(i[known], minlength=len(hot[2]))
            known &= after > 0  # the triples of hot pairs
            i, known = _known(hot[3], _triple(key[known], after[known]))
            sums[3] += np.bincount(i[known], minlength=len(hot[3]))
        for k, h in hot.items():
            seen = sums[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(h[seen].view(np.int64)), pa.array(np.full(seen.sum(), k, np.int32)), pa.array(sums[k][seen])], names=["gram", "kind", "n"])

    return run


def hot_grams(docs: DataFrame, rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order (2 and 3): hashes of the hot n-grams, sorted, and their counts over all texts.

    An n-gram that stands in HOT_SHARE of the sampled texts is hot, so their
    number is bounded by the words of a sampled text over that share.
    """
    share = min(1.0, HOT_TEXTS / max(1, rows))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    least = max(3, int(HOT_SHARE * min(rows, HOT_TEXTS)))
    found = sample.mapInArrow(_grams_of_texts, "gram long, kind int").groupBy("gram", "kind").count().filter(F.col("count") >= least)
    named = {k: [] for k in (2, 3)}
    for r in found.select("gram", "kind").collect():
        named[r["kind"]].append(r["gram"])
    hot = {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in named.items()}
    counts = docs.mapInArrow(_counted(hot), "gram long, kind int, n long").groupBy("gram", "kind").agg(F.sum("n").alias("n"))
    sums = {k: np.zeros(len(h)) for k, h in hot.items()}
    for r in counts.collect():
        k = r["kind"]
        sums[k][np.searchsorted(hot[k], np.array([r["gram"]], np.int64).view(np.uint64))[0]] = r["n"]
    return {k: (hot[k], sums[k]) for k in hot}


def _packed(buckets: int, hot: dict[int, tuple[np.ndarray, np.ndarray]], schema: pa.Schema) -> Callable:
    logs = {k: np.log(np.maximum(n, 1)) for k, (_, n) in hot.items()}

    def grams(held: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """What has to be counted elsewhere, and what hot n-grams add to each text."""
        flat, place, left, first = _flat(held)
        pair, key, after = _keys(flat, left)
        own = first[pair].astype(np.uint64)
        i, hot_pair = _known(hot[2][0], key)
        c2 = np.where(hot_pair, logs[2][i] if len(logs[2]) else 0.0, 0.0)
        three = _triple(key, after)
        j, hot_triple = _known(hot[3][0], three)
        hot_triple &= hot_pair & (after > 0)
        c3 = np.where(hot_triple, logs[3][j] if len(logs[3]) else 0.0, 0.0)
        x = np.bincount(place[pair], own * c2 + (after > 0) * np.where(hot_pair, c3 - c2, 0.0), len(held))
        go = ~hot_pair | ~hot_triple & (after > 0)
        # The other triples of a hot pair count by themselves, as a pair that nothing follows.
        key, after, own = np.where(hot_pair, three, key)[go], np.where(hot_pair, 0, after)[go], np.where(hot_pair, 1, own)[go]
        with np.errstate(over="ignore"):
            single, n = np.unique(_key(flat * ODD[0]), return_counts=True)
            alone = np.flatnonzero(first & (left == 0))
            one = _key(flat[alone] * ODD[0])
        zero = np.zeros(len(single), np.uint64)
        out = {
            "key": np.concatenate([single, one, key]),
            "next": np.concatenate([zero, one * 0, after]),
            "place": np.concatenate([zero, place[alone], place[pair][go]]),
            "tf": np.concatenate([n.astype(np.uint64), one * 0, np.ones(len(key), np.uint64)]),
            "own": np.concatenate([zero, one * 0 + np.uint64(1), own.astype(np.uint64)]),
        }
        order = np.argsort(out["key"])
        return {c: v[order] for c, v in out.items()}, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        limits = np.array([((b << KEY) + buckets - 1) // buckets for b in range(buckets)], np.uint64)
        for at, (ids, held) in enumerate(chunks(batches, CHUNK_WORDS)):
            values, x = grams(held)
            edges = np.searchsorted(values["key"], limits)
            n_words = np.array([len(w) for w in held])
            out = [((part + at) % buckets, part + at, len(ids), ids, _pack(n_words), None, None, None, None, _pack_sums(x))]
            for b, (i, j) in enumerate(zip(edges, [*edges[1:], len(values["key"])], strict=True)):
                if i < j:
                    cut = {c: v[i:j] for c, v in values.items()} | {"key": np.diff(values["key"][i:j], prepend=np.uint64(0))}
                    out.append((b, part + at, int(j - i), None, *(_pack(cut[c], p) for c, p in PLANES.items()), None))
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 64], strict=True), schema, strict=True)], schema=schema)

    return run


def _summed(schema: pa.Schema) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """What the n-grams of one bucket add to each text of each chunk; the heads of chunks pass through."""
        heads = group.filter(pc.is_valid(group.column("x")))
        sent = group.filter(pc.is_null(group.column("x")))
        heads = pa.table([heads.column(f.name if f.name != "words" else "key") for f in schema], schema=schema)
        if not sent.num_rows:
            return heads
        ns = sent.column("n").to_pylist()
        got = {c: np.concatenate([_unpack(v.as_py(), n, p) for v, n in zip(sent.column(c), ns, strict=True)]) for c, p in PLANES.items()}
        ends = np.cumsum(ns)
        for i, j in zip(ends - ns, ends, strict=True):
            got["key"][i:j] = np.cumsum(got["key"][i:j], dtype=np.uint64)
        tf = got["tf"].astype(np.float64)
        _, two = np.unique(got["key"], return_inverse=True)
        c2 = np.log(np.bincount(two, tf))[two]
        _, three = np.unique(_triple(got["key"], got["next"]), return_inverse=True)
        c3 = np.log(np.maximum(np.bincount(three, tf), 1))[three]
        x = np.where(got["next"] > 0, c3 - c2, 0.0) + got["own"] * c2
        out = []
        for chunk, i, j in zip(sent.column("chunk").to_pylist(), ends - ns, ends, strict=True):
            sums = np.bincount(got["place"][i:j].astype(np.int64), x[i:j])
            out.append((chunk, len(sums), None, None, _pack_sums(sums)))
        sums = pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        return pa.concat_tables([heads, sums])

    return run


def _finished(schema: pa.Schema) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """The texts of one chunk with their sums."""
        rows = group.select(["n", "x", "words", "ids"]).to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        x = np.zeros(head["n"], np.int64)
        for r in rows:
            x[: r["n"]] += _unpack_sums(r["x"], r["n"])
        return pa.table([pa.array(head["ids"], schema.field("doc_id").type), pa.array(_unpack(head["words"], head["n"]).astype(np.int64)), pa.array(x * UNIT)], schema=schema)

    return run


def score(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score) of each id of ``docs`` (doc_id, text); log_score is null without words.

    Rows that repeat an id are one document whose texts' scores add up, and so
    are the rows without an id.  Null and empty texts have no words.  Columns
    beside the two are left out.  ``docs`` is read twice and should be a stored
    table.  Words and pairs are told apart by 60 bits of a
    hash, triples by 32 more (those of hot pairs by 60 bits of their own).
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    hot = hot_grams(docs, size["rows"])
    buckets = max(LEAST_BUCKETS, (size["bytes"] or 0) // 5 // BUCKET_WORDS)
    kind = docs.schema["doc_id"].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    if id_type == pa.string():
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    name = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}[id_type]
    ids = pa.field("ids", pa.list_(id_type))
    sent = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ids, *[(c, pa.binary()) for c in PLANES], ("x", pa.binary())])
    back = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ids, ("words", pa.binary()), ("x", pa.binary())])
    done = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("x", pa.float64())])
    packed = docs.mapInArrow(_packed(buckets, hot, sent), f"bucket long, chunk long, n int, ids array<{name}>, {', '.join(f'{c} binary' for c in PLANES)}, x binary")
    sums = packed.groupBy("bucket").applyInArrow(_summed(back), f"chunk long, n int, ids array<{name}>, words binary, x binary")
    texts = sums.groupBy("chunk").applyInArrow(_finished(done), f"doc_id {name}, n_words long, x double")
    texts = ws.save(texts, "texts")
    total = texts.agg(F.sum("n_words")).first()[0] or 0
    off, n = math.log(BACKOFF), F.col("n_words")
    # The first word of a text backs off twice, a second one once.
    starts = F.when(n > 0, 2 * off - math.log(max(1, total))).otherwise(0.0) + F.when(n > 1, off).otherwise(0.0)
    out = texts.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum(F.least(n, F.lit(2))).cast("long").alias("n_backed_off"), F.sum(F.col("x") + starts).alias("log_score"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "n_backed_off", F.when(n > 0, F.round("log_score", 3)).alias("log_score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op9"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, doc_id, unnest(ws) AS c, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT doc_id, c, lag(c) OVER v AS b, lag(c, 2) OVER v AS a FROM t WINDOW v AS (PARTITION BY r ORDER BY i)),
one AS (SELECT c, count(*) AS k FROM p GROUP BY c),
two AS (SELECT b, c, count(*) AS k FROM p WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS k FROM p WHERE a IS NOT NULL GROUP BY a, b, c),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
s AS (
  SELECT p.doc_id, three.k IS NULL AS off,
    CASE WHEN three.k IS NOT NULL THEN ln(three.k) - ln(ab.k) WHEN bc.k IS NOT NULL THEN ln(0.4) + ln(bc.k) - ln(ob.k) ELSE 2 * ln(0.4) + ln(oc.k) - ln(n.n) END AS x
  FROM p CROSS JOIN n JOIN one oc ON oc.c = p.c LEFT JOIN one ob ON ob.c = p.b LEFT JOIN two bc ON bc.b = p.b AND bc.c = p.c
  LEFT JOIN two ab ON ab.b = p.a AND ab.c = p.b LEFT JOIN three ON three.a = p.a AND three.b = p.b AND three.c = p.c),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (off) AS n_backed_off, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_words, 0) AS n_words, coalesce(g.n_backed_off, 0) AS n_backed_off, round(g.x, 3) AS log_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM d.doc_id
"""
