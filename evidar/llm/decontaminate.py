"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of WINDOW words.  A passage is a TF-IDF vector
over the benchmark's vocabulary; the document frequencies are counted over all
documents.  A randomised SVD gives a latent basis: that of all passages of all
documents and of all windows of all items, either half by weight, so no sample
decides what it holds.  The matrix of the documents' passages is never built; what
the SVD multiplies with is their terms' products, summed up by Spark.  Every
passage of every document is then searched against every benchmark window by
cosine in that space; only passages too foreign to the benchmark's vocabulary to
reach the cosine are passed over.  Around each alignment of a candidate the longest common subsequence with the
whole item decides; where it is long but not long enough, the item's answer (its
own column, or else its last sentence) must stand in the passage too.

Texts are read once for each block: their words are written as places in the
block's vocabulary, which is all that frequencies, basis and search need.

The benchmark is a stated query set.  It is taken in blocks of about BLOCK_WORDS
words (an item is never cut), which bounds vocabulary and windows, and with them
what goes to the tasks, however large the benchmark is; passages and windows are
multiplied in tiles of bounded size.  Documents are searched together, about
CHUNK_WORDS words at a time, and each by its own passages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

WINDOW, STEP = 12, 6  # words of a passage, and from one passage to the next
ITEM_STEP = 2
RANK, OVERSAMPLE, POWER = 128, 16, 2
BLOCK_WORDS = 60_000
CHUNK_WORDS = 200_000  # words of documents searched together; a document is never cut
TILE = 4_000_000  # products of passages and windows held at a time
HITS = 65_536  # candidates of a tile held at a time
PAIRS = 4_000_000  # products of terms that a task holds before it adds up equal ones
PARTS = 64  # tasks that add up products of terms, each at most one for each pair of terms
UNIT = 1 << 24  # products are counted in whole parts of 1, so that their sums do not depend on the order
COSINE = 0.65
LEAK = 0.70  # share of the item's words in the common subsequence
PARAPHRASE = 0.50  # the same, with the answer
SLACK = 8  # words on either side of a candidate, besides half of the item: additions stretch a passage

MARKS = b".,;:!?\"'()[]{}*_|#%&$"
LOWER = bytes(range(256)).lower()


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-case words without marks; bytes are UTF-8."""
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(LOWER, MARKS).split()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents (their ids, their words) of about CHUNK_WORDS words at a time."""
    ids: list = []
    texts: list[list[bytes]] = []
    size = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
            ids.append(doc)
            texts.append(words_of(text.as_py()))
            size += len(texts[-1]) + 1
            if size >= CHUNK_WORDS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def coded_chunks(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """The same of documents whose words are places: ids, lengths, and all places one after another."""
    ids: list = []
    parts: list[np.ndarray] = []
    size = 0
    for b in batches:
        for doc, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(doc)
            parts.append(np.frombuffer(words.as_buffer(), kind))
            size += len(parts[-1]) + 1
            if size >= CHUNK_WORDS:
                yield ids, np.array([len(x) for x in parts], np.int64), np.concatenate(parts).astype(np.int64)
                ids, parts, size = [], [], 0
    if ids:
        yield ids, np.array([len(x) for x in parts], np.int64), np.concatenate(parts).astype(np.int64)


def latent(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space of passages, given as the ids of their words; rows: see Space.weighted."""
    x = np.zeros((len(ids), rows.shape[1]), np.float32)
    for k in range(ids.shape[1]):
        x += rows[ids[:, k]]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Items:
    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]

    @property
    def vocabulary(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(sorted({w for item in self.words for w in item}))}

    @property
    def places(self) -> dict[bytes, int]:
        """The place of each word that can matter: in the vocabulary, or behind it (and a place for foreign words) where only answers have it."""
        known = self.vocabulary
        return known | {w: len(known) + 1 + i for i, w in enumerate(sorted({w for a in self.answers for w in a} - known.keys()))}

    def windows(self) -> list[tuple[int, int]]:
        """(place of the item, first word) of all windows."""
        out = []
        for i, w in enumerate(self.words):
            out += [(i, s) for s in sorted({*range(0, max(1, len(w) - WINDOW + 1), ITEM_STEP), max(0, len(w) - WINDOW)})]
        return out


def items_of(rows: list) -> Items:
    """Items with words; an item's answer is its ``answer`` if it has one, else its last sentence."""
    items = Items([], [], [])
    for r in rows:
        words = words_of(r["text"])
        if words:
            answer = words_of(r["answer"]) or words_of([s for s in re.split(r"(?<=[.!?])\s+", r["text"].strip()) if words_of(s)][-1])
            items.ids.append(r["item_id"])
            items.words.append(words)
            items.answers.append(answer)
    return items


class Space:
    """Passages of a text as rows of a TF-IDF matrix over a vocabulary."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray):
        self.place, self.idf = vocabulary, idf
        self.foreign = float(np.median(idf)) if len(idf) else 1.0

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(len(self.place))), np.int64, len(words))

    def passages(self, ids: np.ndarray, lengths: np.ndarray, least: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages of the documents that stand one after another in ``ids``, where their share of known
        weight allows a cosine of ``least``: the places of their documents, their first words there, and their
        words' ids."""
        weight = np.append(self.idf, 0.0) ** 2
        known = np.concatenate([[0.0], np.cumsum(weight[ids])])
        strange = np.concatenate([[0], np.cumsum(ids == len(self.place))])
        counts = -(-np.maximum(1, lengths - WINDOW + step) // step)
        doc = np.repeat(np.arange(len(lengths)), counts)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        close = np.cumsum(lengths)
        starts = (close - lengths)[doc] + first
        ends = np.minimum(starts + WINDOW, close[doc])
        own = known[ends] - known[starts]
        all_ = own + (strange[ends] - strange[starts]) * self.foreign**2
        kept = np.flatnonzero((own > 0) & (own >= least**2 * all_))
        at = starts[kept, None] + np.arange(WINDOW)
        padded = np.concatenate([ids, np.full(WINDOW, len(self.place))])
        return doc[kept], first[kept], np.where(at < ends[kept, None], padded[at], len(self.place))

    def weighted(self, basis: np.ndarray) -> np.ndarray:
        """The basis times the weights of the terms, and a row of zeros for foreign words."""
        return np.vstack([basis * self.idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)

    def gram(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The passages' matrix times its transpose, applied to q: terms x columns of q."""
        weight = np.append(self.idf, 0.0).astype(np.float32)[ids]
        weight /= np.maximum(np.sqrt((weight**2).sum(1, keepdims=True)), 1e-9)
        rows = np.vstack([q, np.zeros((1, q.shape[1]))]).astype(np.float32)
        y = sum(weight[:, k, None] * rows[ids[:, k]] for k in range(ids.shape[1]))
        order = np.argsort(ids, axis=None, kind="stable")
        terms, first = np.unique(ids.ravel()[order], return_index=True)
        out = np.zeros((len(self.place) + 1, q.shape[1]))
        out[terms] = np.add.reduceat(y[order // ids.shape[1]] * weight.ravel()[order, None], first, axis=0)
        return out[:-1]


def coded(docs: DataFrame, items: Items) -> tuple[DataFrame, str]:
    """(doc_id, words) of the rows of ``docs`` that have words, as places, and numpy's name for the kind of these."""
    n, places = len(items.vocabulary), items.places
    kind = "<u2" if len(places) + 1 < 1 << 16 else "<u4"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in chunks(batches):
            ids = np.fromiter(map(places.get, chain.from_iterable(texts), repeat(n)), kind)
            ends = np.cumsum([len(t) for t in texts]).tolist()
            words = [ids[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)]
            own = [i for i, w in enumerate(words) if w]
            yield pa.RecordBatch.from_arrays([pa.array([doc_ids[i] for i in own], pa.int64()), pa.array([words[i] for i in own], pa.binary())], names=["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(code, "doc_id long, words binary"), kind


def document_frequencies(codes: DataFrame, kind: str, n: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n + 1, np.int64)
        for _, lengths, ids in coded_chunks(batches, kind):
            once = np.unique(np.repeat(np.arange(len(lengths)), lengths) * (n + 1) + np.minimum(ids, n))
            seen += np.bincount(once % (n + 1), minlength=n + 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["term", "df"])

    df = np.zeros(n + 1, np.int64)
    for r in codes.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most a row for each word of the block
        df[r["term"]] = r["df"]
    return df[:n]


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def products(codes: DataFrame, kind: str, space: Space) -> DataFrame:
    """(a, b, product): the products of the weights of two terms, summed over all passages of all documents.

    Passages stand end to end, so each word counts once.  They are TF-IDF rows
    of length 1 in which foreign words have a share, and this is the part of
    their matrix's square that lies within the vocabulary.
    """
    n = len(space.place)
    weight, i, j = np.append(space.idf, 0.0), *np.triu_indices(WINDOW, 1)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for _, lengths, ids in coded_chunks(batches, kind):
            doc, first, p = space.passages(np.minimum(ids, n), lengths, 0.0, WINDOW)
            w = weight[p]
            words = np.minimum(WINDOW, lengths[doc] - first)
            own = p < n
            w /= np.sqrt((w**2).sum(1) + (words - own.sum(1)) * space.foreign**2)[:, None]
            both = own[:, i] & own[:, j]
            keys = np.concatenate([(p * (n + 1))[own], (np.minimum(p[:, i], p[:, j]) * n + np.maximum(p[:, i], p[:, j]))[both]])
            same = (p[:, i] == p[:, j])[both]
            values = np.concatenate([(w * w)[own], (w[:, i] * w[:, j])[both] * (1 + same)])
            held.append(added(keys, np.rint(values * UNIT).astype(np.int64)))
            size += len(held[-1][0])
            if size > PAIRS:
                held = [added(*map(np.concatenate, zip(*held, strict=True)))]
                size = 0
        keys, values = added(*map(np.concatenate, zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 2
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(values[at : at + (1 << 16)])], names=["key", "product"])

    sums = codes.coalesce(PARTS).mapInArrow(square, "key long, product long").groupBy("key").agg(F.sum("product").alias("product"))
    return sums.select(F.floor(F.col("key") / n).alias("a"), (F.col("key") % n).alias("b"), "product")


def times(squares: DataFrame, q: np.ndarray) -> np.ndarray:
    """The symmetric matrix ``squares`` (a, b, product: all of its entries, in order of a) times q; a row for each term and batch comes back."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x = (batch.column(k).to_numpy() for k in range(3))
            for at in range(0, len(a), 8192):
                part = slice(at, at + 8192)
                order = np.argsort(a[part], kind="stable")
                terms, first = np.unique(a[part][order], return_index=True)
                y = np.add.reduceat((q[b[part]] * x[part, None])[order], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([r.tobytes() for r in y], pa.binary())], names=["term", "y"])

    out = np.zeros(q.shape)
    for term, y in sorted(squares.mapInArrow(multiply, "term long, y binary").collect()):  # about a row for each word of the block
        out[term] += np.frombuffer(y)
    return out


def corpus_square(codes: DataFrame, kind: str, space: Space, ws: Workspace, name: str) -> Callable[[np.ndarray], np.ndarray] | None:
    """A function that multiplies with the square of the matrix of all documents' passages, whose trace is made 1; none without any."""
    half = ws.save(products(codes, kind, space), f"{name}-half")
    mass = half.filter("a = b").agg(F.sum("product")).first()[0]
    if not mass:
        return None
    whole = half.unionAll(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "product"))
    squares = ws.save(whole.repartitionByRange("a").sortWithinPartitions("a", "b"), name)
    ws.drop(f"{name}-half")
    return lambda q: times(squares, q) / mass


def latent_basis(space: Space, own: np.ndarray, corpus: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """An orthonormal basis (terms x RANK) of the leading right singular vectors of all benchmark windows of a block and, by ``corpus``, of all passages of the documents; either has half of the weight."""
    n, k = len(space.place), min(RANK + OVERSAMPLE, len(space.place))

    def product(q: np.ndarray) -> np.ndarray:
        out = sum((space.gram(own[i : i + 4096], q) for i in range(0, len(own), 4096)), np.zeros((n, k)))
        return out / len(own) + corpus(q) if corpus else out

    q = np.linalg.qr(np.random.RandomState(5).normal(size=(n, k)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(product(q))[0]
    b = product(q)  # the matrix is symmetric: its action within the range gives the order of the directions
    values, vectors = np.linalg.eigh(q.T @ b)
    return q @ vectors[:, np.argsort(-values)[:RANK]]


def places_of(words: list[bytes]) -> dict[bytes, int]:
    """The places of each word, as bits."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(words):
        at[w] = at.get(w, 0) | 1 << i
    return at


def common_subsequence(a: list[bytes], b: list[bytes], at: dict[bytes, int] | None = None, least: float = 0) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; at: places_of(a).

    Words of ``b`` that ``a`` lacks change nothing.  Where fewer than ``least`` are left, their number is given
    instead, which the length does not exceed.
    """
    shared = list(filter(None, map((places_of(a) if at is None else at).get, b)))
    if len(shared) < least:
        return len(shared)
    full = (1 << len(a)) - 1
    v = full
    for m in shared:
        u = v & m
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def search(docs: DataFrame, items: Items, space: Space, basis: np.ndarray, kind: str | None = None) -> DataFrame:
    """(doc_id, item_id, lcs, n_words, cosine, has_answer) of the leaks of the items in ``docs``, whose words are places of ``kind``, or texts."""
    windows = items.windows()
    vectors = space.weighted(basis)
    own = latent(window_ids(items, space, windows), vectors)
    window_item, window_first = np.array(windows, np.int64).T
    tile = max(16, min(4096, TILE // max(1, len(own))))
    n, places = len(space.place), items.places
    targets, answers = ([[places[w] for w in words] for words in x] for x in (items.words, items.answers))

    def found(ids: np.ndarray, lengths: np.ndarray, at_of: dict[int, dict[int, int]]) -> dict[tuple[int, int], tuple[int, float, bool]]:
        """The best hit of each leak (place of the document, place of the item); at_of: places_of the items' words, kept from chunk to chunk."""
        doc, starts, rows = space.passages(np.minimum(ids, n), lengths, COSINE)
        out: dict[tuple[int, int], tuple[int, float, bool]] = {}
        near: dict[tuple[int, int, int], float] = {}  # alignments, each with its best cosine
        for i in range(0, len(rows), tile):
            x = latent(rows[i : i + tile], vectors)
            hits = np.flatnonzero(x @ own.T >= COSINE - 1e-4)
            for j in range(0, len(hits), HITS):
                p, w = np.divmod(hits[j : j + HITS], len(own))
                cosines = np.einsum("ij,ij->i", x[p], own[w])  # again, one by one: a product rounds by the shape of its tile
                for d, item, at, cosine in zip(doc[i + p].tolist(), window_item[w].tolist(), (starts[i + p] - window_first[w]).tolist(), cosines.tolist(), strict=True):
                    if cosine >= COSINE and cosine > near.get((d, item, at), 0.0):
                        near[d, item, at] = cosine
        open_ = np.cumsum(lengths) - lengths
        for (d, item, at), cosine in near.items():
            target = targets[item]
            if item not in at_of:
                at_of[item] = places_of(target)
            pad = SLACK + len(target) // 2
            region = ids[open_[d] + max(0, at - pad) : open_[d] + max(0, min(lengths[d], at + len(target) + pad))].tolist()
            lcs = common_subsequence(target, region, at_of[item], PARAPHRASE * len(target))
            if lcs < PARAPHRASE * len(target):
                continue
            answer = answers[item]
            has = common_subsequence(answer, region) == len(answer)
            if lcs >= LEAK * len(target) or has:
                out[d, item] = max(out.get((d, item), (-1, 0.0, False)), (lcs, round(cosine, 4), has))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_of: dict[int, dict[int, int]] = {}
        parts = coded_chunks(batches, kind) if kind else ((d, np.array([len(t) for t in texts], np.int64), np.fromiter(map(places.get, chain.from_iterable(texts), repeat(n)), np.int64)) for d, texts in chunks(batches))
        for doc_ids, lengths, ids in parts:
            leaks = [(doc_ids[d], items.ids[i], hit[0], len(items.words[i]), hit[1], hit[2]) for (d, i), hit in found(ids, lengths, at_of).items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*leaks, strict=True) if leaks else [()] * 6, kinds, strict=True)], names=["doc_id", "item_id", "lcs", "n_words", "cosine", "has_answer"])

    return docs.select("doc_id", "words" if kind else "text").mapInArrow(run, "doc_id long, item_id long, lcs long, n_words long, cosine double, has_answer boolean")


def window_ids(items: Items, space: Space, windows: list[tuple[int, int]]) -> np.ndarray:
    n = len(space.place)
    rows = [space.ids(items.words[i][s : s + WINDOW]) for i, s in windows]
    return np.array([np.append(r, np.full(WINDOW - len(r), n)) for r in rows], np.int64).reshape(-1, WINDOW)


def leaks(docs: DataFrame, benchmark: DataFrame, ws: Workspace) -> DataFrame:
    """The leaks of all benchmark items in all rows of ``docs``, a row for each document row and item.

    Null and empty texts and items have none.  Repeated rows are reported as
    often as they stand; a row or an item without an id is reported with a null
    id.
    """
    if "answer" not in benchmark.columns:
        benchmark = benchmark.withColumn("answer", F.lit(None).cast("string"))
    bench = ws.save(benchmark.select("item_id", "text", "answer").filter("text is not null").distinct(), "benchmark")
    n_words = bench.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-n_words // BLOCK_WORDS))
    docs = docs.select("doc_id", "text")
    rows_of_docs: int | None = None
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, lcs long, n_words long, cosine double, has_answer boolean")
    for block in range(blocks):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text", "answer").collect()  # about BLOCK_WORDS words
        items = items_of(rows)
        if not items.ids:
            continue
        if rows_of_docs is None:
            rows_of_docs = docs.count()
        codes, kind = coded(docs, items)
        codes = ws.save(codes, f"words-{block}")
        df = document_frequencies(codes, kind, len(items.vocabulary))
        space = Space(items.vocabulary, np.log((rows_of_docs + 1.0) / (df + 0.5)) + 0.05)
        basis = latent_basis(space, window_ids(items, space, items.windows()), corpus_square(codes, kind, space, ws, f"square-{block}"))
        out = out.union(ws.save(search(codes, items, space, basis, kind), f"leaks-{block}"))
        ws.drop(f"words-{block}")
        ws.drop(f"square-{block}")
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without leaks.  A row goes by its own text: others under its id, or without one, stay or go by theirs."""
    ws = Workspace(spark, "stage5")
    key = F.xxhash64("doc_id", "text")
    found = ws.save(leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), ws).select(F.col("doc_id").alias("_leaky text")).distinct(), "leaky")
    return docs.join(found, key == F.col("_leaky text"), "left_anti").select(*[f"`{c}`" for c in docs.columns])
