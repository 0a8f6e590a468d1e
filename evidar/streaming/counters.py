"""Single-pass counters with a sample, over a table or a stream.

State holds, for each class and salt, how many rows came and which of them
stand first in a random order; so a class with a third of all rows is shared
out, a state stays small, and a stream goes on where it stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import draw

SALTS = 64
UPDATE = "class string, salt int, n long, draws array<string>, ids array<string>"
STATE = "n long, draws array<string>, ids array<string>"


def dealt(df: DataFrame, class_: str, id_: str, seed: str, salts: int) -> DataFrame:
    named = df.select(F.coalesce(F.col(class_).cast("string"), F.lit("")).alias("class"), F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("id"))
    return named.withColumn("draw", draw("id", seed)).withColumn("salt", F.pmod(F.xxhash64("draw"), F.lit(salts)).cast("int"))


def of_table(df: DataFrame, class_: str, id_: str, k: int, seed: str, salts: int = SALTS) -> DataFrame:
    """What ``updates`` says of a stream that has got just these rows; one shuffle."""
    place = F.row_number().over(Window.partitionBy("class", "salt").orderBy("draw", "id"))
    rows = dealt(df, class_, id_, seed, salts).withColumn("place", place)
    best = F.sort_array(F.collect_list(F.when(F.col("place") <= k, F.struct("draw", "id"))))
    return rows.groupBy("class", "salt").agg(F.count("*").alias("n"), best.alias("b")).select("class", "salt", "n", F.col("b.draw").alias("draws"), F.col("b.id").alias("ids"))


def updates(df: DataFrame, class_: str, id_: str, k: int, seed: str, salts: int = SALTS) -> DataFrame:
    """(class, salt, n, draws, ids) of a stream: for each class and salt that got rows, its rows so far and the k that stand first in the random order."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, draws, ids = state.get if state.exists else (0, [], [])
        best = list(zip(draws, ids, strict=True))
        for f in frames:
            n += len(f)
            best = heapq.nsmallest(k, [*best, *zip(f["draw"], f["id"], strict=True)])
        draws, ids = [d for d, _ in best], [i for _, i in best]
        state.update((n, draws, ids))
        yield pd.DataFrame({"class": [key[0]], "salt": [key[1]], "n": [n], "draws": [draws], "ids": [ids]})

    return dealt(df, class_, id_, seed, salts).groupBy("class", "salt").applyInPandasWithState(count, UPDATE, STATE, "update", GroupStateTimeout.NoTimeout)


def merged(state: DataFrame, k: int) -> DataFrame:
    """(class, n, sample): totals, and the ids of the k rows that stand first, in that order.  Of one class and salt the latest update counts."""
    latest = state.groupBy("class", "salt").agg(F.max(F.struct("n", "draws", "ids")).alias("s")).select("class", "s.*")
    totals = latest.groupBy("class").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(F.arrays_zip("draws", "ids"))).alias("all"))  # at most k a salt
    return totals.select("class", "n", F.slice(F.array_sort("all"), 1, k)["ids"].alias("sample"))


def counters(df: DataFrame, class_: str, id_: str, k: int, seed: str = "0") -> DataFrame:
    """Rows of each class and a uniform sample of k, for a table.  A null class is counted as an empty one; repeated rows count each."""
    return merged(of_table(df, class_, id_, k, seed), k)


def count_stream(spark: SparkSession, incoming: str, schema: str, root: str, class_: str, id_: str, k: int, seed: str = "0") -> DataFrame:
    """The same over all files that a folder has got so far; what is counted is not counted again.

    A batch that is run again after a failure writes its folder anew.
    """
    stream = spark.readStream.schema(schema).parquet(incoming)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/updates/part_batch={batch_id}")

    updates(stream, class_, id_, k, seed).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start().awaitTermination()
    return merged(spark.read.schema(UPDATE).parquet(f"{root}/updates"), k)
