"""Preference formatting of conversations, in DataFrame functions only.

A pair has a chosen and a rejected conversation.  Their longest common prefix
of turns is rendered once, as the prompt; what follows on either side is a
completion.  A mask lists the code-point ranges of a completion that training
counts: the text of assistant turns with its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
TRAINED = "assistant"


def turn_head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(turn_head(t["role"]), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """start:end of each trained range, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(turn_head(t["role"]))
        end = start + F.char_length(t["text"]) + len(END)
        span = F.when(t["role"] == TRAINED, F.concat_ws(":", start, end))
        return F.struct((end + 1).alias("at"), F.concat_ws(",", F.nullif(acc["out"], F.lit("")), span).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def clean_turn() -> Column:
    def clean(c: str, other: str) -> Column:
        return F.replace(F.coalesce(F.col(c), F.lit(other)), F.lit(OPEN), F.lit("<")).alias(c)

    return F.struct("turn", clean("role", "unknown"), clean("text", ""))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row for each pair_id of ``turns`` (pair_id, chosen boolean, turn, role, text).

    Turns stand in the order of turn, role, text; repeated rows count once.  A
    null role is "unknown", a null text is empty, and marks within texts and
    roles lose their bar, so no text can close a turn.  A side that is missing
    has no turns: then the prefix is empty and its completion is null.  Rows
    without a pair_id or a side are left out.  Null turn numbers stand first.
    """
    sides = turns.filter("pair_id is not null and chosen is not null").groupBy("pair_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("chosen") == flag, clean_turn()))).alias(name) for name, flag in (("c", True), ("r", False))])
    return format_sides(sides)


def format_sides(sides: DataFrame) -> DataFrame:
    """As ``format_pairs``, of ``sides``: pair_id and the clean turns of the chosen (c) and the rejected (r) conversation."""
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    n = F.array_position(same, F.lit(False)).cast("int")
    n = F.when(n == 0, F.least(F.size("c"), F.size("r"))).otherwise(n - 1)
    cut = sides.withColumn("n_prefix_turns", n)

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_prefix_turns") + 1, F.size(side))

    def of(side: str, what: Column) -> Column:
        return F.when(F.size(side) > 0, what)

    return cut.select(
        "pair_id",
        "n_prefix_turns",
        render(F.slice("c", F.lit(1), F.col("n_prefix_turns"))).alias("prompt"),
        of("c", render(rest("c"))).alias("chosen"),
        of("c", mask(rest("c"))).alias("chosen_mask"),
        of("r", render(rest("r"))).alias("rejected"),
        of("r", mask(rest("r"))).alias("rejected_mask"),
    )


def sides_of_conversations(conversations: DataFrame) -> DataFrame:
    """A preference pair of each conversation: (pair_id, c, r) for ``format_sides``.

    Chosen are the turns up to the last answer (assistant turn).  Rejected is
    the same conversation with another answer in its place: the answer before
    it, given to another question; where there is none, the last question is
    said again; where there is no question either, the answer is empty.  A
    conversation without an answer is both sides as it stands.  Rows without a
    conv_id are left out, repeated rows count once.
    """
    t = conversations.filter("conv_id is not null").groupBy(F.col("conv_id").alias("pair_id")).agg(F.array_sort(F.collect_set(clean_turn())).alias("t"))

    def last(role: str, before: Column) -> Column:
        places = F.transform("t", lambda x, i: F.when((x["role"] == role) & (i + 1 < before), i + 1))
        return F.array_max(F.array_compact(places))

    def text_at(i: Column) -> Column:
        return F.get("t", i - 1)["text"]

    t = t.withColumn("n", last(TRAINED, F.size("t") + 1)).withColumn("earlier", last(TRAINED, F.col("n"))).withColumn("asked", last("user", F.col("n")))
    other = F.struct(F.get("t", F.col("n") - 1)["turn"].alias("turn"), F.lit(TRAINED).alias("role"), F.coalesce(text_at(F.col("earlier")), text_at(F.col("asked")), F.lit("")).alias("text"))
    chosen = F.when(F.col("n").isNull(), F.col("t")).otherwise(F.slice("t", F.lit(1), F.col("n")))
    rejected = F.when(F.col("n").isNull(), F.col("t")).otherwise(F.concat(F.slice("t", F.lit(1), F.col("n") - 1), F.array(other)))
    return t.select("pair_id", chosen.alias("c"), rejected.alias("r"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of each conversation: its last answer, and another one, after the same prompt."""
    return format_sides(sides_of_conversations(table(spark, sf_dir, "conversations")))


ORACLE = """
WITH d AS (
  SELECT DISTINCT conv_id AS pair_id, turn, replace(coalesce(role, 'unknown'), '<|', '<') AS role, replace(coalesce(text, ''), '<|', '<') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
l AS (SELECT pair_id, max(i) FILTER (role = 'assistant') AS last FROM o GROUP BY pair_id),
e AS (
  SELECT l.pair_id, l.last, max(o.i) FILTER (o.role = 'assistant' AND o.i < l.last) AS earlier, max(o.i) FILTER (o.role = 'user' AND o.i < l.last) AS asked
  FROM l JOIN o ON o.pair_id = l.pair_id GROUP BY l.pair_id, l.last),
n AS (
  SELECT o.pair_id, true AS is_chosen, o.i, o.role, o.text FROM o JOIN e ON e.pair_id = o.pair_id WHERE e.last IS NULL OR o.i <= e.last
  UNION ALL
  SELECT o.pair_id, false, o.i, o.role, o.text FROM o JOIN e ON e.pair_id = o.pair_id WHERE e.last IS NULL OR o.i < e.last
  UNION ALL
  SELECT e.pair_id, false, e.last, 'assistant', coalesce(a.text, u.text, '')
  FROM e LEFT JOIN o a ON a.pair_id = e.pair_id AND a.i = e.earlier LEFT JOIN o u ON u.pair_id = e.pair_id AND u.i = e.asked WHERE e.last IS NOT NULL),
p AS (SELECT DISTINCT pair_id FROM n),
m AS (
  SELECT p.pair_id, CAST(coalesce(min(CASE WHEN c.role = r.role AND c.text = r.text THEN NULL ELSE coalesce(c.i, r.i) END) - 1, max(coalesce(c.i, 0))) AS INTEGER) AS n_prefix_turns
  FROM p LEFT JOIN (SELECT * FROM n WHERE is_chosen) c ON c.pair_id = p.pair_id
  FULL JOIN (SELECT * FROM n WHERE NOT is_chosen) r ON r.pair_id = c.pair_id AND r.i = c.i
  WHERE p.pair_id IS NOT NULL GROUP BY p.pair_id),
k AS (
  SELECT m.pair_id, coalesce(least(m.n_prefix_turns, s.c, s.r), 0) AS n_prefix_turns, s.c, s.r
  FROM m JOIN (SELECT pair_id, count(*) FILTER (is_chosen) AS c, count(*) FILTER (NOT is_chosen) AS r FROM n GROUP BY pair_id) s USING (pair_id)),
w AS (
  SELECT n.*, k.n_prefix_turns, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line
  FROM n JOIN k USING (pair_id)),
v AS (
  SELECT *, coalesce(sum(CASE WHEN i > n_prefix_turns THEN length(line) ELSE 0 END) OVER (PARTITION BY pair_id, is_chosen ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM w),
s AS (
  SELECT pair_id, is_chosen,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (i <= n_prefix_turns), '') AS prompt,
    coalesce(string_agg(line, '' ORDER BY i) FILTER (i > n_prefix_turns), '') AS body,
    coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(line) - 1 AS BIGINT), ',' ORDER BY i) FILTER (i > n_prefix_turns AND role = 'assistant'), '') AS mask
  FROM v GROUP BY pair_id, is_chosen)
SELECT k.pair_id, CAST(k.n_prefix_turns AS INTEGER) AS n_prefix_turns, coalesce(c.prompt, '') AS prompt, c.body AS chosen, c.mask AS chosen_mask, r.body AS rejected, r.mask AS rejected_mask
FROM k LEFT JOIN s c ON c.pair_id = k.pair_id AND c.is_chosen LEFT JOIN s r ON r.pair_id = k.pair_id AND NOT r.is_chosen
"""
