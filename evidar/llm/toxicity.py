"""Toxicity by weak supervision.

Voters are words and word stems that the labelled training rows suggest; a
voter votes "toxic" on a text that has it and abstains on others.  A generative
label model, fitted by expectation maximisation on the votes alone, estimates
how often each voter votes on toxic and on clean texts, and how far voters
agree beyond what the label explains; correlated voters share their weight.
Its posteriors are the labels on which a linear classifier over more words and
stems is trained.  The classifier scores every whole text.

Fitting uses a bounded sample of the labelled rows (``TRAIN_ROWS``); rows whose
crc32 of the id leaves 2 when divided by 4 never take part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

TRAIN_ROWS = 20_000
STEMS = (3, 4, 5, 6, 7, 8)
VOTERS = 96
FEATURES = 768
ITERATIONS = 12
THRESHOLD = 0.3
MEMO = 300_000

TOKEN = re.compile(r"[^\W\d_]+")


def features_of(words: set[str]) -> Counter:
    """The words of a text, and the beginnings that leave a rest, with the number of different words that have them.

    A stem that two or three different words share is a feature of its own
    ("stem*2", "stem*3"): stems that clean texts have by chance seldom return.
    """
    seen = Counter(w[:k] + "*" for w in words for k in STEMS if len(w) > k)
    out = Counter({f"{f}{level}": 1 for f, n in seen.items() for level in (2, 3) if n >= level})
    out.update(seen.keys())
    out.update(words)
    return out


class Known(dict):
    """Finds the features of a fixed list in texts.  Word -> stems and words of the list; remembered up to a bound."""

    def __init__(self, features: list[str]):
        self.places: dict[str, list[tuple[int, int]]] = {}
        for i, f in enumerate(features):
            base, level = (f[:-1], int(f[-1])) if f[-2:-1] == "*" else (f, 1)  # no word holds a star
            self.places.setdefault(base, []).append((level, i))

    def __missing__(self, word: str) -> tuple[str, ...]:
        out = tuple(f for f in (word, *[word[:k] + "*" for k in STEMS if len(word) > k]) if f in self.places)
        if len(self) < MEMO:
            self[word] = out
        return out

    def in_text(self, text: str | None) -> list[int]:
        found = Counter(chain.from_iterable(map(self.__getitem__, set(TOKEN.findall(text.lower()))))) if text else {}
        return [i for base, n in found.items() for level, i in self.places[base] if n >= level]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting; a row without an id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents, chosen by a hash of the id.

    One row for each id: of labels that disagree the larger counts, of several
    texts under one id the smallest.
    """
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` narrow rows
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def suggest(train: DataFrame, n: int) -> list[str]:
    """The n words and stems that most speak for toxic, by their document frequencies among toxic and other rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def told() -> Iterator[pa.RecordBatch]:
            names = sorted(seen[0].keys() | seen[1].keys())
            for i in range(0, len(names), 10_000):
                part = names[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in seen)], names=["feature", "neg", "pos"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update(features_of(set(TOKEN.findall(text.lower())) if text else set()))
                if len(seen[0]) + len(seen[1]) > MEMO:  # told in parts, which are summed afterwards
                    yield from told()
                    seen = Counter(), Counter()
        yield from told()

    is_toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    counts = train.select("text", is_toxic.cast("int").alias("y")).mapInArrow(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).filter("pos >= 2")
    rows = train.agg(F.count(F.when(is_toxic, 1)).alias("pos"), F.count(F.when(~is_toxic, 1)).alias("neg")).first()
    lift = F.log((F.col("pos") + 0.5) / (rows["pos"] + 1.0)) - F.log((F.col("neg") + 0.5) / (rows["neg"] + 1.0))
    best = counts.withColumn("lift", lift).filter("lift > 1").orderBy(F.desc(F.round(F.col("lift") * F.col("pos"), 6)), "feature").limit(n)
    return [r["feature"] for r in best.select("feature").collect()]


def choose_voters(x: np.ndarray, toxic: np.ndarray, n: int = VOTERS) -> list[int]:
    """Features that become voters: one after the other, what covers most toxic rows (up to three times each) at few clean ones."""
    worth = np.ones(len(x))  # what covering a row once more is worth
    left = [i for i in range(x.shape[1]) if 4 * x[~toxic, i].sum() <= x[toxic, i].sum()]
    out: list[int] = []
    while left and len(out) < n:
        gain = (worth * toxic) @ x[:, left] - 2 * (worth * ~toxic) @ x[:, left]
        best = int(gain.argmax())
        if gain[best] < 1:
            break
        column = x[:, left[best]]
        out.append(left[best])
        worth = np.where(column, worth / 2, worth)
        worth[worth < 0.2] = 0
        left = [i for i in left if not np.array_equal(x[:, i], column)]
    return out


def label_model(votes: np.ndarray, prior: float, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of toxic; each voter's rates on toxic and on clean texts; and its share of weight.

    The last voter is added here: it votes "clean" where all others abstain.
    Otherwise an abstention says nothing.  Start: any vote means toxic.  The
    class balance is given, and each round's posteriors are shifted to meet it;
    all else is estimated from the votes alone.
    """
    v = np.column_stack([votes, ~votes.any(1)]).astype(np.float32)
    post = np.where(v[:, -1] == 0, 0.9, 0.1 * prior)
    share = np.ones(v.shape[1])
    for _ in range(iterations):
        hit = (post @ v + 0.5) / (post.sum() + 1)
        false = ((1 - post) @ v + 0.5) / ((1 - post).sum() + 1)
        hit[:-1] = np.maximum(hit, false)[:-1]
        # Agreement that the label does not explain: correlations of the residuals.
        rest = v - (post[:, None] * hit + (1 - post)[:, None] * false).astype(np.float32)
        scale = np.sqrt((rest**2).mean(0)) + 1e-6
        corr = (rest.T @ rest) / len(v) / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        evidence = v @ (share * np.log(hit / false))
        low, high = -60.0, 60.0  # of the shift, by bisection
        for _ in range(50):
            shift = (low + high) / 2
            post = 1 / (1 + np.exp(-np.clip(shift + evidence, -30, 30)))
            low, high = (shift, high) if post.mean() < prior else (low, shift)
    return post, hit, false, share


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps."""
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    ridge = np.full(x.shape[1], l2 / max(1, len(x)), np.float32)
    ridge[-1] = 0
    rate = 1 / (0.25 * max(1.0, float((x**2).sum(1).mean())) + float(ridge.max()))
    w = u = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ u, -30, 30)))
        new = u - rate * (x.T @ (p - y).astype(np.float32) / max(1, len(x)) + ridge * u)
        u, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def presence(rows: DataFrame, features: list[str]) -> np.ndarray:
    """rows x features as booleans, from a bounded table."""
    n = len(features)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(features)
        for b in batches:
            out = []
            for text in b["text"]:
                x = np.zeros(n, np.uint8)
                x[known.in_text(text)] = 1
                out.append(np.packbits(x).tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "bits": out, "toxic": b["toxic"]})

    got = rows.mapInPandas(pack, "doc_id long, bits binary, toxic int").orderBy("doc_id", "bits").collect()
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in got), np.uint8).reshape(len(got), -1)
    return np.unpackbits(bits, axis=1)[:, :n].astype(bool), np.array([r["toxic"] == 1 for r in got])


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace) -> tuple[list[str], np.ndarray, float]:
    """Features, weights and bias.  Without labelled rows there are no features and every score is low."""
    train = ws.save(train_rows(docs, labels), "train")
    features = suggest(train, FEATURES)
    if not features:
        return [], np.zeros(0), -4.0
    x, toxic = presence(train, features)
    post, *_ = label_model(x[:, choose_voters(x, toxic)], float(np.clip(toxic.mean(), 0.01, 0.5)))
    weights, bias = fit_linear(x, post)
    return features, weights.astype(float), bias


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, which replace columns of these names; null and empty texts get the bias."""
    features, weights, bias = model

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(features)
        for b in batches:
            logits = np.array([bias + weights[known.in_text(t)].sum() for t in b], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    own = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*own, scored(F.col(f"`{text}`")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), Workspace(spark, "op1"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
