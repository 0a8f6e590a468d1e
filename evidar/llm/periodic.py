"""Periodic runs of words: harmonic grid probing, and the text with repeats collapsed.

A run of period p and length 4 p or more holds four neighbouring multiples of
p, so it is enough to compare the words at j p, (j + 1) p, (j + 2) p and
(j + 3) p for each p: n / p places, n log n in all.  What passes is extended
by comparing chunks of the word array with itself p places on.  Places inside
a run found before are skipped: a stretch that shares 3 p words with a run of
a smaller period belongs to that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words, table, words_of

#: Grid places that are compared at once.
AT_ONCE = 1 << 20
#: Texts of so many words are probed in one piece.
SHORT = 4096
#: A run has this many words, and this many periods, at least.
WORDS, PERIODS = 6, 4


def grid(n: int, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): every multiple of a period that has three more behind it, by period and place, in pieces in which a period at most doubles (one piece for a short text)."""
    p = 1
    while PERIODS * p <= n:
        for low in range(0, max(1, n - 3 * p), at_once * p):  # one piece, but for texts of more words than fit
            high = min(n if 16 * n <= at_once and n <= SHORT else 2 * p, n // PERIODS + 1) if n - 3 * p <= at_once * p else p + 1
            periods = np.arange(p, high)
            first = np.full(len(periods), low // p)
            last = np.minimum((n - 1 - 3 * periods) // periods, first + at_once - 1 if high == p + 1 else n)
            count = np.maximum(last - first + 1, 0)
            period = np.repeat(periods, count)
            place = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)) * period
            yield place, period
        p = high


def reach(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The widest [lo, hi) around ``at`` in which words p apart are equal; ``at`` and at + p are.  Chunks double as they go."""
    n, chunk, k = len(w), 64, at
    while k < n - p:
        stop = min(k + chunk, n - p)
        if (other := w[k:stop] != w[k + p : stop + p]).any():
            k += int(other.argmax())
            break
        k, chunk = stop, 2 * chunk
    lo, chunk = at, 64
    while lo > 0:
        begin = max(lo - chunk, 0)
        if (other := w[begin:lo] != w[begin + p : lo + p])[::-1].any():
            lo -= int(other[::-1].argmax())
            break
        lo, chunk = begin, 2 * chunk
    return lo, k + p


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n = len(w)
    found: list[tuple[int, int, int]] = []
    covered = np.zeros(n, np.int64)  # where the farthest run over a place ends
    for place, period in grid(n):
        x = w[place]
        same = (x == w[place + period]) & (x == w[place + 2 * period])
        place, period = place[same], period[same]
        same = (w[place] == w[place + 3 * period]) & (covered[place] <= place + 3 * period)
        done, of = -1, 0  # to which place stretches of this period are known
        for at, p in zip(place[same].tolist(), period[same].tolist(), strict=True):
            if (p == of and at + p < done) or covered[at] > at + 3 * p:
                continue
            lo, hi = reach(w, at, p)
            done, of = hi, p
            if hi - lo >= max(WORDS, PERIODS * p) and covered[lo] < hi:
                found.append((lo, hi - lo, p))
                np.maximum(covered[lo:hi], hi, out=covered[lo:hi])
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` with ``runs``, an array of (start, length, period), and ``collapsed``, the text with one period of each run.

    Places are word numbers; words are ``[^\\x20\\x09-\\x0D]+``.  A run is a
    stretch of words with smallest period q (words q apart are equal) and
    max(6, 4 q) words or more that no neighbouring word extends.  ``collapsed``
    is the words, joined by one space, that no run holds after its first q.

    A null or empty text has no run and an empty ``collapsed``.  Repeated rows
    are told apart by nothing and give the same twice.  Columns of ``df`` named
    like the new ones are replaced.  A text is one row and its words stand in
    the memory of one task, whatever its length; nothing is shuffled.
    """
    kept = [c for c in df.columns if c.lower() not in (runs.lower(), collapsed.lower())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_runs, out_text = [], []
            for value in b.column(b.num_columns - 1).to_pylist():
                words = words_of(value)
                number: dict[bytes, int] = {}
                found = runs_of(np.fromiter((number.setdefault(x, len(number)) for x in words), np.int32, len(words)))
                drop = np.zeros(len(words), bool)
                for s, length, q in found:
                    drop[s + q : s + length] = True
                if found:
                    words = [words[i] for i in np.flatnonzero(~drop)]
                out_runs.append(found)
                out_text.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in x] for x in out_runs]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind), pa.array(out_text, pa.string())], names=[*b.schema.names[:-1], runs, collapsed])

    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("_text of runs"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    return given.mapInArrow(of, f"{names}, `{runs}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed}` string")


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, ties by the smallest start and then period; null where there is none."""
    more = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"]) | ((a["length"] * b["period"] == b["length"] * a["period"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def planted(df: DataFrame) -> DataFrame:
    """``documents`` in which every tenth text by h = crc32(doc_id) repeats itself: each word i from a on becomes word a + (i - a) % p, for a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10).  A null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    wanted = df.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    split = wanted.withColumn("_w", F.when(F.col("_g").isNotNull(), split_words(F.col("text"))))
    a = split.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    p = a.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    words = F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return p.withColumn("text", F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text"))).drop("_g", "_w", "_n", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each document, as the contract's digest columns."""
    docs = planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return x.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
