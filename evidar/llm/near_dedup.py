"""MinHash near-duplicate groups with odd sketches.

A document's set holds its distinct five-word shingles as 64-bit hashes.  Equal
sets are one class, found by a digest of the whole set.  Each class has 125
MinHash samples: 25 bands of five make the candidates, and an odd sketch (the
parity of how many samples fall on each of 256 bits) filters them: the
population count of the XOR of two sketches tells how many samples differ.
What passes is confirmed on the full sets.

No bucket emits all its pairs.  The first round compares each class with the
smallest class of its bucket.  The second takes the buckets that the first left
with several groups, cut into blocks: sketches of each pair of blocks meet, and
only members that have a likely partner of another group there fetch their
full sets; the links that join groups are emitted.  Components come from label
passing.

A class bears the 128-bit digest of its set, so rows without an id and rows
that share an id with another text keep their own links.

At a similarity of just 0.85 a pair misses all bands with a chance of 4e-7, and
the filter drops one with a chance under 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, Workspace, connected_components, mix, ngram_hashes, small_enough, table

WORDS = 5
BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
SIMILAR = 85  # per cent
#: Samples that may differ: the mean at 0.85 is 19 with a deviation of 4; some pairs of bits meet again.
MAY_DIFFER = 31
#: Members of a block, and shingles in it: what bounds a task of the second round.
BLOCK = 256
BLOCK_SHINGLES = 500_000
BROADCAST_KEYS = 1_000_000

_rng = np.random.RandomState(11)
_XOR = _rng.randint(0, 2**63, SAMPLES).astype(np.uint64)
_MUL = _rng.randint(0, 2**62, SAMPLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.randint(0, 2**63, (1, SAMPLES)).astype(np.uint64)
_BAND = _rng.randint(0, 2**62, (ROWS, 1, BANDS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)

SKETCHED = "doc_id long, text_hash long, n_shingles long, set_key binary, s0 long, s1 long, s2 long, s3 long, bands array<long>"


def shingles(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; bytes.lower() lowers A-Z alone."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(ngram_hashes(hashes.of(words), n))


def samples(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, 2**32 - 1, np.uint64)
    for i in range(0, len(s), 1024):
        h = s[i : i + 1024, None] ^ _XOR
        h *= _MUL
        np.minimum(out, (h >> np.uint64(32)).min(0), out=out)
    return out


def sketches(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x samples) to odd sketches (4 words of 64 bits) and band keys."""
    n = len(m)
    bits = (mix(m ^ _SALT) & np.uint64(255)).astype(np.int64) + 256 * np.arange(n)[:, None]
    odd = np.bincount(bits.ravel(), minlength=256 * n).reshape(n, 256) & 1
    words = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    r = m.reshape(n, BANDS, ROWS)
    keys = sum(r[:, :, i] * _BAND[i] for i in range(ROWS)) + np.arange(BANDS, dtype=np.uint64)
    return words, mix(keys).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        sizes, keys, sig = [], [], []
        for text in b.column(2):
            s = shingles(text.as_py(), hashes)
            sizes.append(len(s))
            keys.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            sig.append(samples(s))
        if not sizes:
            continue
        odd, bands = sketches(np.array(sig))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(4)], bands], names=["doc_id", "text_hash", "n_shingles", "set_key", "s0", "s1", "s2", "s3", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            sets = [shingles(t.as_py(), hashes).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "set"])


def near(a: str, b: str) -> Column:
    """The filter of a pair: sizes and sketches allow a similarity of SIMILAR."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)), F.lit(0))
    # Each sample that differs puts two bits in; some of them meet again.
    return (100 * F.least(na, nb) >= SIMILAR * F.greatest(na, nb)) & (differ <= 2 * MAY_DIFFER)


def sets_of(docs: DataFrame, reps: DataFrame, keys: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(set_key, set) of the classes with these keys, from one document of each."""
    wanted = reps.select("set_key", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).join(keys, "set_key", "left_semi")
    wanted = ws.save(wanted, f"{name}-keys")
    # Narrow rows, counted first: below the bound no text is shuffled.
    wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_KEYS) else wanted
    texts = docs.select("doc_id", "text", text_hash())
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")))
    sets = found.select("set_key", "text").mapInArrow(_sets, "set_key binary, set array<long>")
    return ws.save(sets.dropDuplicates(["set_key"]), f"{name}-sets")


def confirmed(docs: DataFrame, reps: DataFrame, pairs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough, as edges (src, dst)."""
    sets = sets_of(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct(), ws, name)
    x = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    edges = x.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u")).filter(100 * F.col("i") >= SIMILAR * F.col("u"))
    edges = ws.save(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), f"{name}-edges")
    ws.drop(f"{name}-sets")
    return edges


def between(docs: DataFrame, reps: DataFrame, rows: DataFrame, ws: Workspace) -> DataFrame:
    """Edges between the members of a bucket that bear different labels (rows of key, set_key, label, n_shingles, s0 to s3).

    A bucket is cut into blocks of about BLOCK members or BLOCK_SHINGLES
    shingles, and each pair of blocks is one key of a semi-join on sketches:
    it leaves the members with a likely partner of another label in that pair
    of blocks.  These alone get their sets.  A group compares them, the nearest
    pairs first, and leaves out pairs that its own links have brought together;
    so it emits fewer edges than it has members.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = ws.save(rows.groupBy("key").agg(blocks.alias("nb")), "between-sizes")
    cut = rows.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("set_key"), F.col("nb")).cast("int"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("c")).select("key", F.least("b", "c").alias("bi"), F.greatest("b", "c").alias("bj"), "b", "set_key", "label", "n_shingles", "s0", "s1", "s2", "s3")
    x, y = dealt.alias("x"), dealt.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.bi") == F.col("y.bi")) & (F.col("x.bj") == F.col("y.bj"))
    # Either one of each block or, where both are the same block, any two.
    across = F.col("x.b") + F.col("y.b") == F.col("x.bi") + F.col("x.bj")
    able = ws.save(x.join(y, same & across & (F.col("x.label") != F.col("y.label")) & near("x", "y"), "left_semi"), "able")
    sets = sets_of(docs, reps, able.select("set_key").distinct(), ws, "between")
    edges = able.join(sets, "set_key").groupBy("key", "bi", "bj").applyInPandas(_links, "src binary, dst binary").distinct()
    edges = ws.save(edges, "between-edges")
    ws.drop("between-sets")
    ws.drop("able")
    return edges


def _links(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("set_key", ignore_index=True)
    ids, n = g["set_key"].to_numpy(), g["n_shingles"].to_numpy()
    words = g[["s0", "s1", "s2", "s3"]].to_numpy().view(np.uint64)
    first, second = g["b"].to_numpy() == g["bi"].iloc[0], g["b"].to_numpy() == g["bj"].iloc[0]
    differ = sum(np.bitwise_count(words[:, None, k] ^ words[None, :, k]).astype(np.int32) for k in range(4))
    # Either each row of one block with each of the other, or all pairs of one block.
    meet = first[:, None] & second[None, :]
    meet = np.triu(meet | meet.T, 1) & (differ <= 2 * MAY_DIFFER) & (100 * np.minimum.outer(n, n) >= SIMILAR * np.maximum.outer(n, n))
    at, to = np.nonzero(meet)
    group = {x: x for x in g["label"]}

    def top(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    label, sets, out = g["label"].to_numpy(), list(g["set"]), []
    for k in np.argsort(differ[at, to], kind="stable"):
        i, j = at[k], to[k]
        x, y = top(label[i]), top(label[j])
        if x == y:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= SIMILAR * (n[i] + n[j] - both):
            group[x] = y
            out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["src", "dst"])


def text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def groups(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, first_hash) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id of the group; ``first_hash`` is the
    hash of the text under that id (the smallest, where it has several).  A
    null text and a text without words have an empty set and no links.  A
    repeated row is an exact copy; one id with two texts is two documents, each
    with its own links.  A row without an id has its links but never names its
    group, and has no component where the group has no id at all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = ws.save(docs.select("doc_id", text_hash(), "text").mapInArrow(_sketch, SKETCHED), "sketched")
    # Below six shingles only equal sets are similar enough.
    reps = ws.save(sk.filter("n_shingles > 5").dropDuplicates(["set_key"]), "reps")
    rows = reps.select(F.explode("bands").alias("key"), "set_key")
    shared = ws.save(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("set_key").alias("leader")).filter("n > 1").select("key", "leader"), "shared")
    members = ws.save(rows.join(shared, "key"), "members")

    sketch = reps.select("set_key", "n_shingles", "s0", "s1", "s2", "s3")
    side = F.broadcast(sketch) if small_enough(sketch, 100_000) else sketch
    stars = members.filter("set_key <> leader").select(F.col("leader").alias("a"), F.col("set_key").alias("b")).distinct()
    stars = stars.join(side.alias("x"), F.col("a") == F.col("x.set_key")).join(side.alias("y"), F.col("b") == F.col("y.set_key")).filter(near("x", "y")).select("a", "b")
    stars = ws.save(stars, "stars")
    edges = confirmed(docs, reps, stars, ws, "star")
    labels = connected_components(edges, ws, "star-cc")

    # The leader has met all of its bucket; the others still meet where the first round left several groups.
    named = members.filter("set_key <> leader").join(labels, members.set_key == labels.node, "left").select("key", "set_key", F.coalesce("label", "set_key").alias("label"))
    mixed = ws.save(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"), "mixed")
    named = ws.save(named.join(mixed, "key", "left_semi").join(side, "set_key"), "named")
    for done in ("members", "shared", "stars", "mixed"):
        ws.drop(done)
    more = between(docs, reps, named, ws)
    ws.drop("named")
    if more.limit(1).count():
        labels = connected_components(edges.union(more), ws, "all-cc")

    ids = sk.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    ids = ws.save(ids.join(labels, ids.set_key == labels.node, "full").select(F.coalesce("set_key", "node").alias("set_key"), F.coalesce("label", "set_key", "node").alias("label"), "first"), "named-classes")
    names = ids.groupBy("label").agg(F.min("first").alias("name"))
    names = ids.select("set_key", "label").join(names, "label").select("set_key", "name")
    out = sk.select("doc_id", "text_hash", "n_shingles", "set_key").join(names, "set_key", "left")
    own = F.col("set_key").isNull()
    return out.select("doc_id", "text_hash", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("component_id"), F.when(own, F.col("text_hash")).otherwise(F.col("name.text_hash")).alias("first_hash"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"), Workspace(spark, "op7"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, once.  Rows without an id stay.

    Two texts under one id both stay where they are not near copies.
    """
    cols = [f"`{c}`" for c in docs.columns]
    g = groups(docs, Workspace(spark, "stage7"))
    gone = g.filter((F.col("doc_id") != F.col("component_id")) | (F.col("text_hash") != F.col("first_hash"))).select("doc_id", F.col("text_hash").alias("h")).distinct()
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    w = docs.select(F.struct(*cols).alias("row"), id_.alias("doc_id"), F.xxhash64(text).alias("h")).join(gone, ["doc_id", "h"], "left_anti")
    once = w.filter("doc_id is not null").dropDuplicates(["doc_id", "h"])
    return once.unionByName(w.filter("doc_id is null")).select("row.*")


#: Exact similarities of all documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id, min(r.b) = n.doc_id AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
