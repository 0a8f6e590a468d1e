"""Neighbours, conversation repair and periodic runs against brute force, and on nulls, empty and long rows, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidar.llm import conversation_repair as C
from evidar.llm import neighbours as N
from evidar.llm import periodic as P
from evidar.llm.common import Workspace

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# neighbours


def exact(ids, m, queries, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries:
        i = ids.index(q)
        near = sorted(((-float(u[i] @ u[j]), ids[j]) for j in range(len(ids)) if ids[j] != q))
        out[q] = near[:k]
    return out


def test_neighbours_recall(spark):
    got = N.op11_nearest_neighbours(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, m = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)
    want = exact(ids, m, [i for i in ids if i % 50 == 0], 5)
    true = {(q, r) for q, near in want.items() for _, r in near}
    assert len(got) == len(true)
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(true)
    u = dict(zip(ids, m / np.linalg.norm(m, axis=1, keepdims=True), strict=True))
    for r in got:
        assert abs(r["score"] - float(u[r["query_id"]] @ u[r["vec_id"]])) < 1e-12
    for q in want:
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)


@pytest.mark.parametrize("levels", [1, 2])
def test_neighbours_blocks_ties_and_odd_rows(spark, monkeypatch, levels):
    """Small blocks, copies, and every kind of row that takes no part; one and two rotations a table."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "QUERIES", 3)
    monkeypatch.setattr(N, "ROWS_ONE", 10**6 if levels == 1 else 1)
    r = np.random.RandomState(3)
    m = r.randn(120, 6)
    m[100:] = m[0]  # 20 copies: ties by id
    rows = [(i, v.tolist(), 1) for i, v in enumerate(m)]
    odd = [(200, None, 1), (201, [], 1), (202, [0.0] * 6, 1), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (204, [float("nan")] + [1.0] * 5, 1), (205, [float("inf")] + [1.0] * 5, 1), (None, [1.0] * 6, 1), (3, rows[3][1], 1), (206, [1.0, 2.0], 1), (207, [2.0, 1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = N.nearest(df.filter("vec_id % 10 = 0 or vec_id > 199"), df, Workspace(spark, "t")).collect()
    want = exact(list(range(120)), m, list(range(0, 120, 10)), 5)
    hit = 0
    for q, near in want.items():
        mine = sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])
        assert len(mine) == 5
        hit += len({n for _, n in near} & {x["vec_id"] for x in mine})
    assert hit >= 0.9 * 5 * len(want)
    assert [x["vec_id"] for x in sorted((x for x in got if x["query_id"] == 0), key=lambda x: x["rank"])] == [100, 101, 102, 103, 104]
    two = {x["query_id"]: x for x in got if x["query_id"] > 199}
    assert set(two) == {206, 207} and two[206]["vec_id"] == 207 and abs(two[206]["score"] - 0.8) < 1e-12  # vectors of another length meet each other only
    none = N.nearest(df.filter("vec_id < 0"), df, Workspace(spark, "t"))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert N.nearest(df, df.filter("vec_id < 0"), Workspace(spark, "t")).count() == 0


def test_neighbours_fewer_rows_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    got = {(x["query_id"], x["rank"], x["vec_id"]) for x in N.nearest(df.filter("vec_id = 0"), df, Workspace(spark, "t")).collect()}
    assert got == {(0, 1, 2), (0, 2, 1)}


# conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def brute_repair(rows):
    """Cheapest edits by memoised recursion over (row, state), whole audit strings compared."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    @cache
    def best(i, state, inserts):
        """(cost, audit, output) from row i on; state is the output's initials so far, shortened."""
        options = []
        if i == n and (state == "" or state[-1] == "a"):
            options.append((0, "", ()))
        if i < n and True:
            c, a, o = best(i + 1, state, 0)
            options.append((c + 2, "D" + a, o))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for edit, role, cost in (("K", rows[i][2], 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (to := follow(state, role[:1])) is not None:
                        c, a, o = best(i + 1, to, 0)
                        options.append((c + cost + extra, edit + a, ((role, rows[i][3]), *o)))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (to := follow(state, role[:1])) is not None:
                    c, a, o = best(i, to, inserts + 1)
                    options.append((c + 5, "I" + a, ((role, ""), *o)))
        return min(options) if options else (10**9, "", ())

    def follow(state, letter):
        if letter == "s":
            return "s" if state == "" else None
        if letter == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if letter == "a" and state == "u" else None

    cost, audit, out = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))


def random_conversations(n, seed, longest=14):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for turn in range(r.randint(1, longest)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"])
            text = r.choice(["Yes.", "No", "Why?", "", " \t", None, "so\n", "end. \n", f"t{turn}.", f"t{turn}!"])
            out.append((c, r.choice([turn, turn, turn, turn + 3, None]), role, text))
    return out


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece", [10, 1])
def test_repair_against_brute_force(spark, monkeypatch, piece):
    """Whole conversations in a piece, and pieces of two rows, so that conversations are cut everywhere."""
    monkeypatch.setattr(C, "PIECE", piece)
    rows = random_conversations(220, piece) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None)]
    df = spark.createDataFrame(rows, CONV).withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(1))
    turns, figures = C.repair(df, Workspace(spark, "t"))
    told = {r["conv"]: r for r in C.digests(turns, "bigint").collect()}
    filled = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    for f in figures.collect():
        want = brute_repair([r for r in filled if r[0] == f["conv"]])
        got = (*(f[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), told[f["conv"]]["audit"], told[f["conv"]]["repaired_sha256"])
        assert got == want, (f["conv"], [r for r in filled if r[0] == f["conv"]])
    assert figures.count() == len({r[0] for r in rows})


def test_repair_query(spark, tmp_path):
    want = {}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + random_conversations(60, 9)
    spark.createDataFrame(rows, CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    after = brute_damage(rows)
    for c in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == c]
        want[c] = brute_repair(mine) if mine else (0, 0, 0, 0, 0, 0, "", sha(""))
    got = C.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r


def test_repair_empty_and_long(spark, tmp_path):
    empty = spark.createDataFrame([], CONV)
    turns, figures = C.repair(empty, Workspace(spark, "t"))
    assert turns.count() == 0 and figures.count() == 0
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i}." + "x" * (300_000 if i == 7 else 0) + ".") for i in range(5001)] + [(1, 9000, "assistant", "0..")]
    turns, figures = C.repair(spark.createDataFrame(rows, CONV), Workspace(spark, "t"))
    f = figures.collect()[0]
    assert (f["gaps"], f["duplicate"], f["illegal"], f["cost"]) == (9001 - 5002, 0, 0, 0)
    assert C.digests(turns, "bigint").collect()[0]["repaired_sha256"] == sha("\n".join(f"{r[2]}:{r[3]}" for r in rows))


# periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            s, e = i, k + q
            if k > i and e - s >= max(6, 4 * q) and not any(all(w[x] == w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = k + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        w = []
        for _ in range(r.randint(0, 5)):
            u = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randint(1, 8))]
            w += (u * r.randint(1, 9))[: r.randint(1, 60)]
        assert P.runs_of(np.array(w, np.int32)) == brute_runs(w), w


def test_grid_in_pieces():
    for n in (0, 3, 9, 100, 1000):
        want = [(p, j * p) for p in range(1, n // 4 + 1) for j in range((n - 1 - 3 * p) // p + 1)]
        for at_once in (7, 300, 1 << 20):
            assert [(int(p), int(i)) for a, b in P.grid(n, at_once) for i, p in zip(a, b, strict=True)] == want


def brute_document(doc_id, text):
    words = re.findall(WORD, text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(words) if i not in drop)))


def test_runs_query(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefghijkl") for _ in range(r.randint(0, 90)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "é😀 " * 30 + "  x"), (503, "é😀 " * 30 + "  x"), (None, "a b " * 9), (504, "a a a a a a b c b c b c b c")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("period", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in P.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_document(*x) for x in rows), key=str)


def test_runs_long_text_clashing_names_and_empty_table(spark):
    words = [str(i) for i in range(30_000)] + ["tail", "piece"] * 40_000
    df = spark.createDataFrame([(" ".join(words), 1, 2)], "text string, Runs int, collapsed int")
    got = P.periodic_runs(df).collect()
    assert [tuple(x) for x in got[0]["runs"]] == [(30_000, 80_000, 2)] and got[0]["collapsed"] == " ".join(words[:30_002])
    assert P.periodic_runs(df.filter("false")).count() == 0
