"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, by a time-major dynamic program over tensors.

States of the output so far: 0 nothing, 1 a system turn, 2 ends in user, 3
ends in assistant.  Costs run backward over time, for all conversations of a
bucket of equal length at once; every step's costs are stored and edits are
traced forward with them, for all conversations at once, too.

Rows are dealt by ranges of (conversation, turn), so no conversation is bound
to one task: it is cut into pieces, a piece is a matrix of costs from state to
state, and the matrices of a conversation are folded, not its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

#: Rows of a piece, as a power of two.
PIECE = 10
#: Costs of the edits, and of leaving a truncated row.
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
BLANK = " \t\n\x0b\x0c\r"
INF = 1 << 40
#: The state after a user or assistant turn, whichever comes next, and whether that is the assistant's.
NEXT = np.array([2, 2, 3, 2])
#: Costs of the end of a conversation by state: what is missing is inserted.
END = [0, 10, 5, 0]


def step(after: np.ndarray, ini: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (delete, keep, rerole) of a row for each conversation, end and state, from the costs after it."""
    c = COSTS
    ini, extra = ini[:, None], np.where(fault == 3, c["truncated"], 0)[:, None] + np.where((fault == 1) | (fault == 2), INF, 0)[:, None]
    keep = np.full(after.shape, INF)
    for s in range(4):
        keep[..., s] = np.where(ini == (2 if s == 2 else 1), after[..., NEXT[s]], INF)
    keep[..., 0] = np.where(ini == 0, after[..., 1], keep[..., 0])
    return after + c["delete"], np.minimum(keep + c["keep"] + extra[..., None], INF), np.minimum(after[..., NEXT] + c["rerole"] + extra[..., None], INF)


def backward(ini: np.ndarray, fault: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Costs before each row of ini, fault [time, conversation], and after the last: [conversation, end, state]."""
    costs = [end]
    for t in range(len(ini) - 1, -1, -1):
        v = np.minimum.reduce(step(costs[-1], ini[t], fault[t]))
        for _ in range(2):
            v = np.minimum(v, v[..., NEXT] + COSTS["insert"])
        costs.append(v)
    return costs[::-1]


def trace(ini: np.ndarray, fault: np.ndarray, costs: list[np.ndarray], state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(script, state): the letters [time, slot, conversation] of the ASCII-least cheapest edits, and where they end.

    Letters: D delete, K keep, U and A rerole to user and assistant, u and a
    insert one before the row; after the last row of a conversation (``last``)
    what is missing is inserted.
    """
    n, who = len(state), np.arange(len(state))
    script = np.zeros((len(ini), 6, n), np.uint8)
    state = state.copy()
    for t in range(len(ini)):
        drop, keep, rerole = (x[who, 0] for x in step(costs[t + 1], ini[t], fault[t]))
        open_ = np.ones(n, bool)
        for slot in range(4):
            now, to = costs[t][who, 0, state], NEXT[state]
            dropped = open_ & (drop[who, state] == now)
            inserted = open_ & ~dropped & (costs[t][who, 0, to] + COSTS["insert"] == now)
            kept = open_ & ~dropped & ~inserted & (keep[who, state] == now)
            changed = open_ & ~dropped & ~inserted & ~kept
            script[t, slot, dropped] = ord("D")
            script[t, slot, kept] = ord("K")
            script[t, slot, inserted] = np.where(to[inserted] == 3, ord("a"), ord("u"))
            script[t, slot, changed] = np.where(to[changed] == 3, ord("A"), ord("U"))
            state = np.where(inserted | changed | kept, np.where(kept & (ini[t] == 0), 1, to), state)
            open_ &= inserted
    for slot, states in ((4, (1,)), (5, (1, 2))):  # a system turn lacks two turns, a user turn one
        if len(ini):
            lacks = last & np.isin(state, states)
            script[-1, slot, lacks] = ord("u") if slot == 4 else ord("a")
            state = np.where(lacks, 2 if slot == 4 else 3, state)
    return script, state


def _pieces(t: pa.Table) -> tuple[pa.Table, list[int], list[int]]:
    """The rows of a piece in order, and where each conversation begins and ends."""
    t = t.sort_by("pos").combine_chunks()
    ids = t["conv"].to_pylist()
    cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    return t, cuts[:-1], cuts[1:]


def _buckets(t: pa.Table, begin: list[int], end: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which, rows, ini, fault) of the conversations of equal length: rows, ini and fault are [time, conversation]."""
    b, n = np.array(begin), np.array(end) - np.array(begin)
    ini, fault = t["ini"].to_numpy(), t["fault"].to_numpy()
    for length in np.unique(n):
        which = np.flatnonzero(n == length)
        rows = b[which][None, :] + np.arange(length)[:, None]
        yield which, rows, ini[rows], fault[rows]


def _matrices(codes: DataFrame, kind: str) -> DataFrame:
    """A row for each conversation of a piece: its cost matrix, counts, and what meets the neighbouring pieces."""
    schema = f"conv {kind}, piece long, costs array<long>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_ini int, last_ini int"

    def of(t: pa.Table) -> pa.Table:
        t, begin, end = _pieces(t)
        ini, fault = t["ini"].to_numpy(), t["fault"].to_numpy()
        turn = t["turn"].to_pylist()
        costs: list = [None] * len(begin)
        for which, _, i, f in _buckets(t, begin, end):
            to = np.full((len(which), 4, 4), INF)
            to[:, np.arange(4), np.arange(4)] = 0
            first = backward(i, f, to)[0]
            for k, c in zip(which.tolist(), first.transpose(0, 2, 1).reshape(len(which), 16).tolist(), strict=True):
                costs[k] = c
        pair = ini[:-1] * 4 + ini[1:]
        bad = ~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
        out = {"conv": t["conv"].combine_chunks().take(pa.array(begin)) if begin else t["conv"], "piece": [t["piece"][0].as_py()] * len(begin), "costs": costs}
        known = [[x for x in turn[b:e] if x is not None] for b, e in zip(begin, end, strict=True)]
        for name, code in (("blank", 1), ("duplicate", 2), ("truncated", 3)):
            out[name] = [int((fault[b:e] == code).sum()) for b, e in zip(begin, end, strict=True)]
        out["illegal"] = [int(bad[b : e - 1].sum()) for b, e in zip(begin, end, strict=True)]
        out |= {"turns": [len(set(x)) for x in known], "first_turn": [x[0] if x else None for x in known], "last_turn": [x[-1] if x else None for x in known]}
        out |= {"first_ini": ini[begin].astype(np.int32), "last_ini": ini[np.array(end) - 1].astype(np.int32)}
        longs = {"first_turn": pa.int64(), "last_turn": pa.int64(), "costs": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, longs[k]) if k in longs else v for k, v in out.items()})

    return codes.groupBy("piece").applyInArrow(of, schema)


def _folded(pieces: DataFrame, kind: str) -> DataFrame:
    """For each piece, last to first: the costs by state behind it; the first piece of a conversation bears the conversation's own figures."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the piece that waits: whether it is its conversation's first is known at the next row

        def row(p: dict, head: bool) -> dict:
            own = {k: p[k] if head else None for k in ("blank", "duplicate", "truncated", "illegal")}
            gaps = p["last_turn"] - p["first_turn"] + 1 - p["turns"] if p["first_turn"] is not None else 0
            return {"conv": p["conv"], "piece": p["piece"], "behind": p["behind"], "last": p["last"], "head": head, "cost": p["ahead"][0] if head else None, "gaps": gaps if head else None} | own

        schema = None
        for b in batches:
            schema = schema or pa.schema([("conv", b.schema.field("conv").type), ("piece", pa.int64()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()), ("head", pa.bool_()), *((c, pa.int64()) for c in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal"))])
            out = []
            for p in b.to_pylist():
                same = before is not None and before["conv"] == p["conv"]
                if before is not None:
                    out.append(row(before, not same))
                p["behind"], p["last"] = (before["ahead"], False) if same else (END, True)
                p["ahead"] = [min(p["costs"][4 * s + e] + p["behind"][e] for e in range(4)) for s in range(4)]
                if same:
                    for c in ("blank", "duplicate", "truncated", "illegal"):
                        p[c] += before[c]
                    p["illegal"] += (p["last_ini"], before["first_ini"]) not in ((0, 1), (1, 2), (2, 1))
                    p["turns"] += before["turns"] - (p["last_turn"] is not None and p["last_turn"] == before["first_turn"])
                    p["first_turn"] = before["first_turn"] if p["first_turn"] is None else p["first_turn"]
                    p["last_turn"] = p["last_turn"] if before["last_turn"] is None else before["last_turn"]
                before = p
            yield pa.RecordBatch.from_pylist(out, schema)
        if before is not None:
            yield pa.RecordBatch.from_pylist([row(before, True)], schema)

    dealt = pieces.repartition("conv").sortWithinPartitions(F.asc("conv"), F.desc("piece"))
    return dealt.mapInArrow(fold, f"conv {kind}, piece long, behind array<long>, last boolean, head boolean, cost long, gaps long, blank long, duplicate long, truncated long, illegal long")


def _scripts(codes: DataFrame, folded: DataFrame) -> DataFrame:
    """(piece, pos, start, head, last, script, end): the edits at each row; for a conversation's later pieces from each of the four states it may begin in."""
    types = pa.schema([("piece", pa.int64()), ("pos", pa.int64()), ("start", pa.int32()), ("head", pa.bool_()), ("last", pa.bool_()), ("script", pa.string()), ("end", pa.int32())])

    def of(t: pa.Table, ends: pa.Table) -> pa.Table:
        if not len(t):
            return types.empty_table()
        t, begin, end = _pieces(t)
        by_conv = {r["conv"]: r for r in ends.to_pylist()}
        ids = t["conv"].to_pylist()
        own = [by_conv[ids[b]] for b in begin]
        pos, parts = t["pos"].to_numpy(), []
        for which, rows, ini, fault in _buckets(t, begin, end):
            mine = [own[k] for k in which.tolist()]
            costs = backward(ini, fault, np.array([x["behind"] for x in mine])[:, None, :])
            last, head = np.array([x["last"] for x in mine]), np.array([x["head"] for x in mine])
            for start in range(4):
                if start and head.all():
                    continue
                script, to = trace(ini, fault, costs, np.full(len(which), start), last)
                take = np.flatnonzero(~head) if start else np.arange(len(which))
                for c in take.tolist():
                    words = [bytes(x[x > 0]).decode() for x in script[:, :, c]]
                    n = len(words)
                    parts.append((pos[rows[:, c]], [start] * n, [bool(head[c])] * n, [bool(last[c])] * n, words, [None] * (n - 1) + [int(to[c])]))
        columns = [np.concatenate([p[0] for p in parts]), *([x for p in parts for x in p[i]] for i in range(1, 6))]
        return pa.table([pa.array([t["piece"][0].as_py()] * len(columns[0]), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(types)[1:], strict=True))], schema=types)

    ends = folded.select("conv", "piece", "behind", "last", "head")
    return codes.groupBy("piece").cogroup(ends.groupBy("piece")).applyInArrow(of, "piece long, pos long, start int, head boolean, last boolean, script string, end int")


def _begun(ends: DataFrame, kind: str) -> DataFrame:
    """(piece, start): in which state each later piece of a conversation begins."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, begin, at, to, conv = None, 0, 0, {}, object()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["conv"] != conv or r["head"]:
                    conv, piece, to, at = r["conv"], r["piece"], {}, 0
                elif r["piece"] != piece:
                    piece, at, to = r["piece"], to[at], {}
                    out.append({"piece": piece, "begin": at})
                to[r["start"]] = r["end"]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("piece", pa.int64()), ("begin", pa.int32())]))

    dealt = ends.repartition("conv").sortWithinPartitions("conv", "piece", "start")
    return dealt.mapInArrow(walk, "piece long, begin int")


def repair(df: DataFrame, ws: Workspace, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, figures): every edit with its repaired row, and a row of figures for each conversation.

    ``turns`` has conv, pos and place (their order in a conversation), edit
    (K, R, D or I), role and text (null where the edit deletes).  ``figures``
    has conv, gaps, blank, duplicate, truncated, illegal and cost.

    Rows stand by turn, nulls first, then role, then a hash of the text; null
    roles and texts are one space.  A null conversation id is a conversation.
    Repeated rows are duplicates of the first.  Of an empty table both are
    empty.  Other columns are not looked at, whatever they are called.

    Rows go by ranges, so a conversation of any length is shared by tasks; a
    task holds 2**PIECE rows and, of them, only codes.  Texts are not sent to
    Python.
    """
    kind = df.schema[conv].dataType.simpleString()
    c = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(" "))
    given = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), c(role).alias("role"), c(text).alias("text"))
    tail = F.rtrim("text", F.lit(BLANK))
    plain = F.when(tail == "", 1).when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    given = given.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("plain", plain)
    order = ["conv", "turn", "role", "digest"]
    rows = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    rows = ws.save(rows.withColumn("piece", F.shiftright("pos", PIECE)), "rows")

    first = rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").select(*[F.col(x).alias(f"_{x}") for x in ("conv", "role", "digest")], "first")
    again = rows.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))).filter("pos > first").select("pos", F.lit(2).alias("again"))
    letter = F.left("role", F.lit(1))
    ini = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    fault = F.when(F.col("plain") == 1, 1).otherwise(F.coalesce("again", "plain"))
    codes = ws.save(rows.select("piece", "pos", "conv", "turn", "plain", ini.alias("ini")).join(again, "pos", "left").select("piece", "pos", "conv", "turn", "ini", fault.alias("fault")), "codes")

    folded = ws.save(_folded(_matrices(codes, kind), kind), "folded")
    scripts = ws.save(_scripts(codes, folded), "scripts")
    open_ends = "not (head and last)"  # of a piece, at most the first conversation has begun before it, and at most the last one goes on
    ends = scripts.filter("end is not null").filter(open_ends).join(folded.filter(open_ends).select("conv", "piece", "head", "last"), ["piece", "head", "last"]).select("conv", "piece", "start", "end", "head")
    begun = _begun(ends, kind)
    taken = scripts.filter("head").unionByName(scripts.filter("not head").join(begun, "piece").filter("start = begin").drop("begin")).select("pos", "script")

    edits = F.transform(F.filter(F.split("script", ""), lambda x: x != ""), lambda x, i: F.struct(i.alias("place"), x.alias("x")))
    opened = rows.select("conv", "pos", F.col("role").alias("_role"), F.col("text").alias("_text")).join(taken, "pos").select("conv", "pos", "_role", "_text", F.explode(edits).alias("e"))
    x = F.col("e.x")
    edit = F.when(x.isin("D", "K"), x).when(x.isin("U", "A"), "R").otherwise("I")
    whose = F.when(x == "K", F.col("_role")).when(x.isin("U", "u"), "user").when(x.isin("A", "a"), "assistant")
    turns = opened.select("conv", "pos", F.col("e.place").alias("place"), edit.alias("edit"), whose.alias("role"), F.when(x.isin("K", "U", "A"), F.col("_text")).when(x != "D", "").alias("text"))
    return turns, folded.filter("head").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(turns: DataFrame, kind: str) -> DataFrame:
    """(conv, audit, repaired_sha256): the edits' letters, and the hash of the lines role:text joined by newlines.

    A hash runs through a conversation in order, so the rows of one stream
    through one task; only the letters of its edits are held.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        conv, audit, h, some = None, None, None, False
        for b in batches:
            schema = schema or pa.schema([("conv", b.schema.field("conv").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            out = []
            for r in b.to_pylist():
                if audit is None or r["conv"] != conv:
                    if audit is not None:
                        out.append({"conv": conv, "audit": "".join(audit), "repaired_sha256": h.hexdigest()})
                    conv, audit, h, some = r["conv"], [], hashlib.sha256(), False
                audit.append(r["edit"])
                if r["role"] is not None:
                    h.update((("\n" if some else "") + r["role"] + ":" + r["text"]).encode("utf-8", "surrogatepass"))
                    some = True
            yield pa.RecordBatch.from_pylist(out, schema)
        if audit is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "repaired_sha256": h.hexdigest()}], schema)

    dealt = turns.repartition("conv").sortWithinPartitions("conv", "pos", "place")
    return dealt.mapInArrow(of, f"conv {kind}, audit string, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` damaged by crc32(conv_id:turn) % 20, nulls as one space: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    s = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(s("conv_id"), F.lit(":"), s("turn")).cast("binary")) % 20
    text: Column = F.when(h == 1, "").when(h == 2, F.regexp_replace(s("text"), "[.!?]", "")).otherwise(s("text"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.filter(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(s("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, cheapest edits and digest of every conversation, after the contract's damage."""
    given = table(spark, sf_dir, "conversations")
    kind = given.schema["conv_id"].dataType.simpleString()
    turns, figures = repair(damaged(given), Workspace(spark, "repair"))
    told = digests(turns, kind)
    ids = given.select("conv_id").distinct()
    x = ids.join(figures, F.col("conv_id").eqNullSafe(figures["conv"]), "left").drop("conv")
    x = x.join(told, F.col("conv_id").eqNullSafe(told["conv"]), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return x.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
