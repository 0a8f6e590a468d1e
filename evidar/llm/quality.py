"""Rule bitmask ledger for document quality.

``ledger`` evaluates every rule once per text and stores the measurements and
one integer whose bit i says that rule i failed.  A policy is a named, versioned
set of rules; applying it is one bitwise AND, and ``ablation`` finds in one
aggregation how many documents each rule rejects on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, Workspace, ngram_hashes, table, words_of

SYMBOLS = "#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, n_upper_words long"

#: name -> SQL condition under which the rule fails; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "shouting": "2 * n_upper_words > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


@dataclass(frozen=True)
class Policy:
    """A named set of rules; a document passes if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
DEFAULT = Policy("default-1", tuple(RULES))


def measure(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    words = words_of(text)
    symbols = sum(map((text or "").count, SYMBOLS))
    if not words:
        return 0, 0, symbols, 0, 0, 0, 0
    w = hashes.of(words)
    repeated = 0
    if len(w) > 3:
        grams = ngram_hashes(w, 3)
        _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
        starts = times[back] > 1
        covered = np.zeros(len(w), bool)
        for i in range(3):
            covered[i : len(grams) + i] |= starts
        repeated = int(covered.sum())
    lines = [x for x in text.split("\n") if words_of(x)]
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    upper = sum(1 for x in words if len(x) > 1 and x.isupper())
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(lines), repeated, upper


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (its own columns of a measure's name are replaced), the measurements and ``failed_bits``.

    A null text has no words; it fails ``few_words``.
    """

    @F.pandas_udf(MEASURES)
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in texts:
            yield pd.DataFrame([measure(t, hashes) for t in batch], columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")

    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {*names, "failed_bits", "_m"}]
    out = docs.select(*kept, measured(F.col(f"`{text}`")).alias("_m")).select(*kept, *[F.col(f"_m.{n}").alias(n) for n in names])
    return out.withColumn("failed_bits", failed_bits())


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that would pass without it."""
    inside = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    aggs = []
    for r in policy.rules:
        bit = 1 << list(RULES).index(r)
        aggs += [F.sum(F.when(inside.bitwiseAND(F.lit(bit).cast("long")) != 0, 1).otherwise(0)).alias(f"{r}_f"), F.sum(F.when(inside == bit, 1).otherwise(0)).alias(f"{r}_o")]
    one = led.agg(*aggs, F.sum(F.when(inside == 0, 1).otherwise(0)).alias("passed"))
    rows = F.explode(F.array(*[F.struct(F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.coalesce(f"{r}_f", F.lit(0)).alias("n_failed"), F.coalesce(f"{r}_o", F.lit(0)).alias("n_only"), (F.coalesce("passed", F.lit(0)) + F.coalesce(f"{r}_o", F.lit(0))).alias("n_passed_without")) for r in policy.rules]))
    return one.select(rows.alias("r")).select("r.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(DEFAULT).alias("kept"), "failed_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy does, from the ledger of all documents, which is written and read as later policies would."""
    led = Workspace(spark, "ablation").save(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "ledger")
    return ablation(led, DEFAULT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the default policy passes, with their own columns, whatever their names; one without text fails."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    return ledger(rows).filter(passes(DEFAULT)).select("own.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words
  FROM w LEFT JOIN p ON p.r = w.r),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_upper_words > n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 32 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""

ORACLE_ABLATION = (
    f"WITH q AS ({ORACLE.strip()}), r AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', {1 << i})" for i, name in enumerate(RULES))
    + f""") v(rule, bit))
SELECT '{DEFAULT.version}' AS policy, rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only,
  count(*) FILTER (failed_bits = 0 OR failed_bits = bit) AS n_passed_without
FROM q, r GROUP BY rule, bit
"""
)
