"""The text operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidar.llm import chat_format, decontaminate, html_extract, lm_score, mixing, near_dedup, pii, quality, sharding, toxicity
from evidar.llm.common import Workspace, connected_components

DOCS = "doc_id long, text string"
random.seed(4)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def ws(spark):
    return Workspace(spark, "test")


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (None, "one two"), (6, prose(20_000, 1)), (7, "é😀 " * 60), (None, prose(80, 2))]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 3000 else None
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_quality_ledger(spark, edges, empty):
    rows = [*EDGES, (10, "a b c d a b c x\n\nsame line\nsame line\n# $ <x>"), (11, "A B C " * 3)]
    got = quality.ledger(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("failed_bits", F.lit(9))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]
        assert want[4] is None or r["n_repeat_words"] == want[4]
        assert (r["failed_bits"] & 1 == 1) == (want[0] < 50)
    assert quality.ledger(empty).count() == 0
    led = quality.ledger(spark.createDataFrame(rows, DOCS))
    ablation = {r["rule"]: r for r in quality.ablation(led, quality.DEFAULT).collect()}
    bits = [r["failed_bits"] for r in got]
    assert ablation["few_words"]["n_failed"] == sum(b & 1 for b in bits)
    assert ablation["few_words"]["n_only"] == sum(b == 1 for b in bits)
    assert quality.ablation(quality.ledger(empty), quality.BASE).count() == 2


# near duplicates


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                top[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def near_copies():
    r, rows = random.Random(3), []
    for g in range(6):
        base = prose(120, 100 + g).split()
        for k in range(14):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            rows.append((1000 - len(rows), " ".join(w)))
    return rows


def near_groups(spark, docs):
    return sorted(map(tuple, near_dedup.groups(docs, ws(spark)).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_near_dedup(spark, edges, empty):
    rows = [*EDGES[:3], *EDGES[3:7], *near_copies(), (20, "ONE two three four FIVE six"), (21, "one two three four five six")]
    assert near_groups(spark, spark.createDataFrame(rows, DOCS)) == sorted(brute_groups(rows), key=str)
    assert near_dedup.groups(empty, ws(spark)).count() == 0


def chains():
    """Families whose members drift away from each other, so that buckets hold several groups after their first round."""
    r, rows = random.Random(8), []
    for g in range(4):
        w = prose(100, 200 + g % 2).split()
        for k in range(40):
            w = list(w)
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
            rows.append((5000 - len(rows), " ".join(w)))
    return rows


def test_near_dedup_second_round_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 600)
    rows = chains()
    assert near_groups(spark, spark.createDataFrame(rows, DOCS)) == sorted(brute_groups(rows), key=str)


def test_near_dedup_rows_without_an_id_and_ids_with_two_texts(spark):
    base = prose(120, 31).split()
    near, far = " ".join([*base[:-1], "zzz"]), prose(120, 32)
    rows = [(None, near), (7, " ".join(base)), (5, far), (5, near), (9, far)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("set_key", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("h", F.lit(2))
    assert near_groups(spark, docs) == sorted(brute_groups(rows), key=str)
    kept = near_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"], r["set_key"], r["row"], r["h"]) for r in kept.collect()), key=str) == sorted([(None, near, "clash", 1, 2), (5, far, "clash", 1, 2), (5, near, "clash", 1, 2)], key=str)


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    rows = [*EDGES, (8, prose(80, 2))]
    kept = near_dedup.stage(spark, spark.createDataFrame(rows, DOCS).withColumn("label", F.lit("x")), "").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 7, 8]
    assert kept[0].asDict().keys() == {"doc_id", "text", "label"}


def test_odd_sketches_estimate_high_similarity():
    from evidar.llm.common import WordHashes

    words = prose(400, 9).split()
    other = [*words[:-12], *prose(12, 10).split()]
    a, b = (near_dedup.shingles(" ".join(w), WordHashes()) for w in (words, other))
    odd, _ = near_dedup.sketches(np.array([near_dedup.samples(a), near_dedup.samples(b)]))
    true = 1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pop = int(np.bitwise_count(odd[0].view(np.uint64) ^ odd[1].view(np.uint64)).sum())
    assert abs(-256 / (4 * near_dedup.SAMPLES) * np.log(1 - 2 * pop / 256) - true) < 0.08


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long"), ws(spark), "cc").collect()}
    assert set(got[i] for i in range(1, 61)) == {1} and got[100] == got[95] == got[90] == 90


# sharding


def brute_cuts(sizes, n):
    def shards(c):
        out, now = 1, 0
        for s in sizes:
            if s > c:
                return n + 1
            if now + s > c:
                out, now = out + 1, 0
            now += s
        return out

    c = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= n)
    ends, now, total = [], 0, 0
    for s in sizes:
        if now + s > c:
            ends.append(total)
            now = 0
        now, total = now + s, total + s
    return (ends + [total] * n)[:n]


@pytest.mark.parametrize(("n", "big"), [(1, 0), (5, 0), (40, 0), (300, 5000)])
def test_minimax_cuts(spark, n, big):
    r = random.Random(n)
    sizes = [r.randint(1, 60) for _ in range(n)]
    sizes[n // 2] = max(sizes[n // 2], big)
    ends = spark.createDataFrame([(int(x),) for x in np.cumsum(sizes)], "end long").coalesce(2)
    assert sharding.minimax_cuts(ends, sum(sizes), 16, blocks=32, exact=8) == brute_cuts(sizes, 16)


def test_sharding_keeps_groups_and_numbers_slots(spark, edges, empty):
    got = sharding.assign(edges.withColumn("size", F.lit("x")), ws(spark)).collect()
    assert len(got) == len(EDGES)
    slots, shard_of = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < 16
        shard_of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in shard_of.values())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in EDGES)
    assert sharding.assign(empty, ws(spark)).count() == 0


# personal data

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def good(kind, hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in re.finditer(p, text or "") if good(k, m[0]))


def test_pii_base_spans(spark, empty):
    rows = [*EDGES, (30, "😀 a@b.c_x@y.zz.@q.r 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 +1 (988) 555-2485 +12345678.) +1+22 4111 1111-1111 1111 41111111111111111 4111111111111111"), (31, "4111--1111111111111 a@b..c %a@b.c- 4111111111111111-1 x1@y.z1.2.3.4"), (32, "1 " * 3000 + "9" * 20000), (33, "a" * 20000 + "@" + ".x" * 3000)]
    got = pii.find(spark.createDataFrame(rows, DOCS), ws(spark)).select("doc_id", pii.joined("base"), pii.joined("spans")).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == sorted((str(d), brute_spans(t)) for d, t in rows)
    assert all(r[2].startswith(r[1]) for r in got)
    assert pii.find(empty, ws(spark)).count() == 0


def test_pii_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please write to contact: u{i}@site{i}.com today") for i in range(40)] + [(50, "please write to contact: u50#site50.com today"), (51, "it took 40 days and 3 nights")]
    spans = {r[0]: r[1] for r in pii.find(spark.createDataFrame(rows, DOCS), ws(spark)).select("doc_id", pii.joined("spans")).collect()}
    assert spans[50] == "id:25:39" and spans[51] == ""


def test_pii_addresses_without_digits_are_seeds(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"please write to contact: {a}{b}@site{a}.com today") for i, (a, b) in enumerate(zip(letters, letters[1:]))] + [(50, "please write to contact: u50#site50.com today"), (51, "please write to contact: alice#home today"), (52, "it is today and contact: is made"), (53, "a contact: was lost"), (54, "the contact: of today")]
    spans = {r[0]: r[1] for r in pii.find(spark.createDataFrame(rows, DOCS), ws(spark)).select("doc_id", pii.joined("spans")).collect()}
    assert spans[50] == "id:25:39" and spans[51] == "id:25:35" and spans[52] == ""


def test_pii_discoveries_support_further_patterns(spark):
    rows = [(i, f"please write to contact: u{i}@site{i}.com today") for i in range(600)]
    # The seeds' context discovers keys, which support a context where no seed stands, and that one gives a word away.
    rows += [(1000 + i, f"please write to contact: key#{i} today") for i in range(40)] + [(2000 + i, f"the vault opens with token key#{i} only") for i in range(40)]
    rows += [(3000, "the vault opens with token sesame only"), (3001, "a sesame roll")]
    spans = {r[0]: r[1] for r in pii.find(spark.createDataFrame(rows, DOCS), ws(spark)).select("doc_id", pii.joined("spans")).collect()}
    assert spans[1000] == "id:25:30" and spans[2000] == "id:27:32" and spans[3000] == "id:27:33" and spans[3001] == ""


def test_pii_patterns_that_secrets_seed_give_away_other_values(spark):
    rows = [(i, f'then token = "{hashlib.sha256(bytes([i])).hexdigest()}" was read, page {i} of the book') for i in range(30)]
    rows += [(40, 'so token = "hunter2x" went out'), (41, f"a lone {hashlib.sha256(b'x').hexdigest()} is a checksum")]
    spans = {r[0]: r[1] for r in pii.find(spark.createDataFrame(rows, DOCS), ws(spark)).select("doc_id", pii.joined("spans")).collect()}
    assert all(spans[i] == "id:14:78" for i in range(30)) and spans[40] == "id:12:20" and spans[41] == ""


def test_pii_of_two_texts_under_one_id(spark):
    rows = [(i, f"please write to contact: u{i}@site{i}.com today") for i in range(40)] + [(50, "please write to contact: u50#site50.com today"), (50, "x"), (50, "x"), (None, "please write to contact: u51#site51.com today")]
    got = pii.find(spark.createDataFrame(rows, DOCS), ws(spark)).filter("doc_id = 50 or doc_id is null").select("doc_id", pii.joined("spans")).collect()
    assert sorted((str(r[0]), r[1]) for r in got) == [("50", ""), ("50", ""), ("50", "id:25:39"), ("None", "")]


# stages


def test_decontamination_stage_goes_by_text(spark, tmp_path):
    """Of two texts under one id the clean one stays; a leaky row without an id goes."""
    item = prose(60, 77)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaky = f"{prose(40, 5)} {item} {prose(40, 6)}"
    rows = [(1, leaky), (1, prose(200, 8)), (2, prose(200, 9)), (None, leaky), (None, prose(90, 10)), (3, None), (4, "")]
    left = decontaminate.stage(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted((r for r in rows if r[1] != leaky), key=str)


def test_stages_keep_columns_of_any_name(spark, empty):
    names = ["doc_id", "text", "n_words", "failed_bits", "_m", "_n", "_w", "_x", "_c", "_p", "_own", "own", "size", "shard"]
    rows = [(i, prose(60, i), *["mine"] * 12) for i in range(6)] + [(7, None, *["mine"] * 12)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    for stage in (quality.stage, mixing.stage):
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == names and {r["n_words"] for r in out.collect()} == {"mine"}
    out = sharding.stage(spark, df, "")
    assert out.columns == [*names[:-2], "size", "text_crc32", "shard", "slot"] and out.filter("text is null").count() == 1


# toxicity


def test_toxicity_of_odd_words_and_rows(spark):
    """Superscripts end a word like any letter; repeated rows, ids without text, labels that disagree and rows without an id."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:120]
    rows = [(i, prose(30, i) + (" vile m² x³ filth" if n % 3 == 0 else "")) for n, i in enumerate(ids)]
    df = spark.createDataFrame([*rows, *rows[:30], (rows[0][0], "another text"), (None, "vile m² x³ filth"), (9999, None), (9998, "vile m² x³ filth " * 20_000)], DOCS)
    labels = spark.createDataFrame([(i, int(n % 3 == 0)) for n, i in enumerate(ids)] + [(ids[1], 1), (ids[1], 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    train = toxicity.train_rows(df, labels)
    assert train.count() == train.select("doc_id").distinct().count() <= len(ids) + 1
    got = toxicity.score(df, toxicity.fit(df, labels, ws(spark))).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == df.count() and all(r["h"] is not None and 0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id[None] == by_id[9998] == by_id[ids[3]] == 1 and by_id[9999] == by_id[ids[2]] == 0


def test_label_model_finds_good_and_bad_voters():
    r = np.random.RandomState(0)
    y = r.rand(4000) < 0.2
    votes = np.column_stack([np.where(y, r.rand(4000) < h, r.rand(4000) < f) for h, f in ((0.7, 0.01), (0.6, 0.02), (0.5, 0.01), (0.2, 0.15))])
    votes = np.column_stack([votes, votes[:, 0]])
    post, hit, false, share = toxicity.label_model(votes, 0.2)
    assert ((post > 0.5) == y).mean() > 0.93
    assert hit[0] > 0.5 and false[0] < 0.05 and share[0] < share[2]


def test_toxicity(spark, empty):
    docs = [(i, prose(30, i) + (f" grawlx{'abcdef'[i % 6]} grawlx{'bcdefa'[i % 6]}s" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([*docs, (1000, None), (1001, "")], DOCS).withColumn("score", F.lit("clash"))
    out = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, labels, ws(spark))).collect()}
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert np.mean([out[i]["predicted"] == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert out[1000]["predicted"] == out[1001]["predicted"] == 0
    none = toxicity.score(empty, toxicity.fit(df, labels.limit(0), ws(spark)))
    assert none.count() == 0
    held = spark.createDataFrame([(7,), (8,)], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert [r["h"] for r in held] == [zlib.crc32(b"7") % 4 == 2, zlib.crc32(b"8") % 4 == 2]


# pages


def test_html_rules():
    stops = "it was the one that they all had seen in the wood and by the river for a day " * 4
    page = f"<html><head><title>T</title></head><body><div class='cookie-notice'>{stops}</div><nav><a href=x>a</a></nav><div><h2>Head</h2><p>{stops}</p><p>Yes.</p><p>{stops}</p></div><ul><li><a href=y>{stops}</a></li></ul><div id=comments>{stops}</div><form>{stops}</form></body></html>"
    text = " ".join(stops.split())
    assert html_extract.main_text(page) == f"Head\n\n{text}\n\nYes.\n\n{text}"
    assert html_extract.main_text("<article><h1>A &amp; B</h1><p>one<br>two \n three<p>x &lt; y<script>if (a<b) '</p>'</script></article><footer>f") == "A & B\n\none two three\n\nx < y"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    html_extract.main_text("<" * 5000 + "<a href='" * 300)


def test_html_short_blocks_inherit_and_weak_words_do_not_decide():
    stops = " ".join(("it was the one that they all had seen in the wood and by the river for a day " * 4).split())
    # In an article, too, density and neighbours decide: a list of names is undecided, and takes the label around it.
    assert html_extract.main_text(f"<article><p>{stops}</p><p>Xq Zk Wv</p><p>{stops}</p></article>") == f"{stops}\n\nXq Zk Wv\n\n{stops}"
    assert html_extract.main_text(f"<article><p class='share-holders'>{stops}</p><div class='share'>Tell a friend</div><p>{stops}</p><a href=x>{stops}</a></article>") == f"{stops}\n\n{stops}"
    assert html_extract.main_text(f"<div><p>{stops}</p><p>Yes.</p><p>{stops}</p></div><p>Contact</p>") == f"{stops}\n\nYes.\n\n{stops}"
    assert "<" not in html_extract.main_text(f'<article><p title="x>{stops}</p><p>{stops}</p></article>')


def test_html_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 200_000 + '"', "<div>" * 60_000 + "</span>" * 60_000, "<p title=\"a\" " * 50_000, "<p x=" * 50_000 + "'" * 50_000, "<![CDATA[" * 50_000, "<" * 500_000):
        start = time.time()
        html_extract.main_text(page)
        assert time.time() - start < 5


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<article><p>é😀</p></article>"), (3, "u", "<p>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()) == [(1, "", 0), (2, "", 0), (2, "é😀", 2), (3, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_words_in_place_equal_plain_python_without_a_function_for_each_word(spark):
    """The words that stand in a pattern, against loops over words; no lambda is called for each word of the corpus."""
    r = random.Random(12)
    some = ["the", "The", "(see", "user=ab1", '"token="xy9",', "key:", "http://a", "a@b", "", "(((", "=", "it.", "Ünder:x", "to", "[id]", "\u00b2", "',:;"]
    texts = [None, "", " \n", *("".join(r.choice(some) + r.choice([" ", "  ", "\n", "\t", " \r\n"]) for _ in range(r.randint(0, 30))) for _ in range(60))]
    lead = re.compile(r"^[^\W\d_][^\W\d_.-]{0,23}[:=](?!/)")
    want = []
    for d, t in enumerate(texts):
        v = re.findall(r"[^ \t-\r]+", t or "")
        for i, w in enumerate(v):
            two, one, right = v[i - 2] if i > 1 else "", v[i - 1] if i else "", v[i + 1] if i + 1 < len(v) else ""
            bare = w.lstrip(pii.OPENS)
            led = lead.match(bare)
            value = (bare[led.end() :].lstrip(pii.OPENS) if led else bare).rstrip(pii.CLOSES)
            named = [f"two {two} {one}"] * bool(two) + [f"one {one} {w[: len(w) - len(bare)]}"] * bool(one) + [f"both {one} {right}"] * bool(one and right) + [f"lead {led[0]}" for _ in "x" if led]
            want += [(d, i, value, not re.search("[0-9@]", w), p.lower()) for p in named if value]
    chosen = sorted({x[-1] for x in want})[::2]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = pii.in_place(docs, spark.createDataFrame([(p,) for p in chosen], "pattern string"))
    got = [(x["doc_id"], x["place"], x["value"], x["plain"], x["pattern"]) for x in found.collect()]
    assert len(chosen) > 30 and sorted(got) == sorted(x for x in want if x[-1] in chosen)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


# decontamination


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.choice(b"abcd") for _ in range(r.randint(0, 20))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == brute_lcs(a, b)


def test_leaks(spark, edges, empty):
    items = [(i, prose(40, 500 + i).capitalize() + ".") for i in range(20)] + [(90, None), (91, ""), (92, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[3][1].split()
    para = w[:8] + ["xx"] + w[9:20] + w[21:30] + ["yy"] + w[31:]
    docs = [(100 + i, prose(200, i)) for i in range(60)] + [(200, prose(90, 7) + " " + items[5][1].upper() + " " + prose(90, 8)), (201, prose(50, 9) + "\n" + " ".join(para) + "\n" + prose(30, 1)), (202, items[7][1]), (202, items[7][1]), (203, " ".join(items[9][1].split()[:10]) + " " + prose(60, 2))]
    got = decontaminate.leaks(edges.union(spark.createDataFrame(docs, DOCS)), bench, ws(spark)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(200, 5), (201, 3), (202, 7), (202, 7)]
    assert decontaminate.leaks(empty, bench, ws(spark)).count() == 0
    assert decontaminate.leaks(edges, bench.limit(0), ws(spark)).count() == 0


def test_latent_basis_is_that_of_all_windows(spark):
    """Its span is that of the leading right singular vectors of the whole window matrix; no document is drawn for it."""
    words = [f"w{i}".encode() for i in range(40)]
    items = decontaminate.Items([1, 2, 3], [words[:20], words[10:34], words[5:40]], [[], [], []])
    space = decontaminate.Space(items.vocabulary, np.linspace(1, 3, 40))
    own = decontaminate.window_ids(items, space, items.windows())
    x = np.zeros((len(own), 40))
    for r, ids in zip(x, own, strict=True):
        r[ids] = space.idf[ids]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    basis = decontaminate.latent_basis(space, own)
    rank = np.linalg.matrix_rank(x)
    assert np.allclose(x @ basis[:, :rank] @ basis[:, :rank].T, x, atol=1e-3)
    shared = ws(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], DOCS), bench, shared).count() == 1
    assert not os.path.exists(f"{shared.root.removeprefix('file://')}/sample")


def test_latent_basis_holds_all_passages_of_all_documents(spark, monkeypatch):
    """What the basis is made from is the square of the matrix of all passages, foreign words counted, whatever the chunks."""
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 50)
    monkeypatch.setattr(decontaminate, "PAIRS", 100)
    r = random.Random(4)
    known = [f"w{i}" for i in range(30)]
    texts = [None, "", "alien " * 30, *(" ".join(r.choice([*known, "x", "y"]) for _ in range(r.randint(1, 70))) for _ in range(40))]
    items = decontaminate.Items([1], [[w.encode() for w in known]], [[b"elsewhere"]])
    space = decontaminate.Space(items.vocabulary, np.linspace(1, 3, 30))
    shared = ws(spark)
    codes, kind = decontaminate.coded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS), items)
    codes = shared.save(codes, "codes")
    passages = [w[i : i + 12] for w in map(decontaminate.words_of, texts) for i in range(0, len(w), 12)]
    want = np.zeros((30, 30))
    for p in passages:
        x = np.zeros(30)
        for w in p:
            if w in space.place:
                x[space.place[w]] += space.idf[space.place[w]]
        squares = sum(space.idf[space.place[w]] ** 2 if w in space.place else space.foreign**2 for w in p)
        want += np.outer(x, x) / squares
    times = decontaminate.corpus_square(codes, kind, space, shared, "square")
    got = times(np.eye(30))
    diagonal = sum(round(1 * y["product"]) for y in decontaminate.products(codes, kind, space).filter("a = b").collect()) / decontaminate.UNIT
    assert np.allclose(got * diagonal, want, atol=1e-4)
    assert decontaminate.corpus_square(codes.limit(0), kind, space, shared, "none") is None
    own = decontaminate.window_ids(items, space, items.windows())
    assert not np.allclose(*(abs(decontaminate.latent_basis(space, own, c)[:, 0]) for c in (None, times)), atol=1e-3)


def test_items_without_an_id_leak(spark):
    text = prose(40, 900)
    bench = spark.createDataFrame([(None, text), (None, prose(40, 901)), (3, prose(40, 902))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(50, 1) + " " + text), (2, prose(50, 2)), (None, prose(40, 902))], DOCS)
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, ws(spark)).collect()), key=str)
    assert got == [(1, None), (None, 3)]


def test_every_alignment_is_compared():
    """Two windows hit one passage; only the alignment of the second, two words on, has enough of the item in its region."""
    item = [b"a%02d" % i for i in range(24)]
    items = decontaminate.Items([1], [item], [[b"elsewhere"]])
    space = decontaminate.Space(items.vocabulary, np.array([1.0] * 12 + [0.3] * 6 + [3.0] * 6))
    words = [b"x%d" % i for i in range(72)]
    words[4:9], words[36:48] = item[7:12], item[12:]

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = decontaminate.search(Frame(), items, space, decontaminate.latent_basis(space, decontaminate.window_ids(items, space, items.windows())))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([b" ".join(words).decode()])], names=["doc_id", "text"])
    assert [(r["doc_id"], r["item_id"], r["lcs"]) for b in run(iter([batch])) for r in b.to_pylist()] == [(5, 1, 17)]


def test_documents_are_searched_together(monkeypatch):
    """Many short documents are multiplied at once, over the ends of batches; each has the leaks it has alone."""
    texts = [w.split() for w in (prose(40, 500 + i).lower() for i in range(6))]
    items = decontaminate.Items(list(range(6)), [[w.encode() for w in t] for t in texts], [[b"nowhere"]] * 6)
    space = decontaminate.Space(items.vocabulary, np.linspace(1, 3, len(items.vocabulary)))
    basis = decontaminate.latent_basis(space, decontaminate.window_ids(items, space, items.windows()))
    docs = [(None, None), (None, ""), (1, "..."), (2, "x")] + [(10 + i, prose(i % 9, i) + " " + " ".join(texts[i % 6][i % 5 : 41 - i % 3]).upper() + " " + prose(i % 25, 90 + i)) for i in range(120)]

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    products = []
    latent = decontaminate.latent
    monkeypatch.setattr(decontaminate, "latent", lambda ids, rows: products.append(len(ids)) or latent(ids, rows))
    run = decontaminate.search(Frame(), items, space, basis)
    batches = [pa.RecordBatch.from_arrays([pa.array([d[0] for d in part], pa.int64()), pa.array([d[1] for d in part], pa.string())], names=["doc_id", "text"]) for part in (docs[i : i + 20] for i in range(0, len(docs), 20))]
    rows = lambda batches: [r for b in run(iter(batches)) for r in b.to_pylist()]
    products.clear()
    together = rows(batches)
    assert len(products) == 1 and len(together) >= 120
    alone = [r for b in batches for i in range(b.num_rows) for r in rows([b.slice(i, 1)])]
    assert together == alone
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 100)
    monkeypatch.setattr(decontaminate, "HITS", 7)
    assert rows(batches) == alone


def test_common_subsequence_stops_at_the_bound():
    """Too few shared words give their number, a bound of the length below the least."""
    r = random.Random(9)
    for _ in range(200):
        a, b = ([bytes([r.choice(b"abcdefgh")]) for _ in range(r.randint(0, 20))] for _ in range(2))
        got, right = decontaminate.common_subsequence(a, b, decontaminate.places_of(a), 6), brute_lcs(a, b)
        assert got == right or right <= got < 6


def test_leaks_recall_against_brute_force(spark):
    """All pairs whose common subsequence is long enough, by brute force, against what the cosine search lets through."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    common = words[:40]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(15, 45)) for _ in range(60)]
    docs, planted = [], 0
    for i in range(300):
        item = items[i % 60]
        bent = {0: lambda w: [w], 1: lambda w: [rng.choice(words)] if rng.random() < 0.2 else [w], 2: lambda w: [] if rng.random() < 0.2 else [w], 3: lambda w: [w, rng.choice(words)] if rng.random() < 0.5 else [w], 4: lambda w: []}[i % 5]
        docs.append((i, " ".join(text(rng.randint(20, 200)) + [x for w in item for x in bent(w)] + text(rng.randint(20, 200)))))
    brute = {(i, j) for i, t in docs for j, item in enumerate(items) if brute_lcs(item, t.split()) >= 0.999 * len(item)} | {(i, i % 60) for i, _ in docs if i % 5 in (0, 3)}
    close = {(i, i % 60) for i, t in docs if i % 5 in (1, 2) and brute_lcs(items[i % 60], t.split()) >= 0.75 * len(items[i % 60])}
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, DOCS), bench, ws(spark)).collect()}
    assert len(got & (brute | close)) >= 0.9 * len(brute | close)
    assert not [x for x in got if x[0] % 5 == 4]


# mixing


def test_rates_meet_targets(spark):
    r = random.Random(5)
    rows = [(i, r.randint(1, 300), [p := r.random(), (1 - p) * (q := r.random()), (1 - p) * (1 - q)]) for i in range(500)]
    post = spark.createDataFrame(rows, "doc_id long, _n long, _p array<double>")
    targets = {"good": 0.2, "toxic": 0.5, "low": 0.3}
    steps = mixing.fit_rates(post, targets)
    rates = {x["doc_id"]: x["r"] for x in post.select("doc_id", mixing.rate(F.col("_p"), steps).alias("r")).collect()}
    total = sum(n for _, n, _ in rows)
    for k, d in enumerate(mixing.DOMAINS):
        assert sum(n * p[k] * rates[i] for i, n, p in rows) / total == pytest.approx(targets[d], abs=1e-4)
    assert min(rates.values()) >= 0
    assert mixing.fit_rates(post.limit(0), targets) == []


def test_mixing_without_labels_and_with_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mix, post = mixing.fit(edges, none, ws(spark))
    assert post.count() == len(EDGES) and mix.model is None
    assert mixing.fit(empty, none, ws(spark))[1].count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 1), (7, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    mix, post = mixing.fit(edges, labels, ws(spark))
    assert post.count() == len(EDGES) and all(abs(sum(r["_p"]) - 1) < 1e-4 for r in post.collect())


# language-model scores


@pytest.mark.parametrize("hot", [0.05, 0.4, 2.0])
def test_lm_scores(spark, edges, empty, monkeypatch, hot):
    """Brute force, with many, some and no n-grams counted apart, and small chunks."""
    import math
    from collections import Counter

    monkeypatch.setattr(lm_score, "HOT_SHARE", hot)
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", 40)

    docs = [(i, " ".join(random.Random(i % 7).choices("a b c d e f".split(), k=i % 12))) for i in range(40)] + [(98, "seen once only here"), (99, None), (None, "a b c"), (97, "z"), (97, "a b"), (97, "z")]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(docs, DOCS), ws(spark)).collect()}
    texts = [(i, (t or "").split()) for i, t in docs]
    counts = Counter(tuple(w[j : j + n]) for _, w in texts for n in (1, 2, 3) for j in range(len(w) - n + 1))
    total = sum(len(w) for _, w in texts)

    def s(h, w):
        if not h:
            return counts[w,] / total
        return counts[*h, w] / counts[h] if counts[*h, w] else 0.4 * s(h[1:], w)

    for d in {i for i, _ in docs}:
        x = [0.4 ** (2 - min(j, 2)) * s(tuple(w[max(0, j - 2) : j]), w[j]) for i, w in texts if i == d for j in range(len(w))]
        assert got[d]["n_words"] == len(x) and got[d]["n_backed_off"] == sum(min(2, len(w)) for i, w in texts if i == d)
        assert got[d]["log_score"] is None if not x else abs(got[d]["log_score"] - sum(map(math.log, x))) < 2e-3
    # Three of the four words of 98 have no other occurrence, and yet only its first two back off.
    assert abs(got[98]["log_score"] - math.log(0.4**3 / total)) < 2e-3
    assert lm_score.score(empty, ws(spark)).count() == 0
    assert lm_score.score(edges, ws(spark)).count() == 8


# chat


def test_preference_pairs(spark):
    rows = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "A"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "B<|end|>"), (1, False, 1, "assistant", "B<|end|>"), (2, True, 0, None, None), (3, True, 0, "u", "x"), (3, False, 0, "u", "x"), (3, False, 1, "assistant", "y"), (None, True, 0, "u", "x")]
    df = spark.createDataFrame(rows, "pair_id long, chosen boolean, turn long, role string, text string").withColumn("prompt", F.lit(1))
    got = {r["pair_id"]: r for r in chat_format.format_pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["n_prefix_turns"] == 1
    for side in ("chosen", "rejected"):
        a, b = map(int, got[1][f"{side}_mask"].split(":"))
        assert got[1][side][a:b] == {"chosen": "A<|end|>", "rejected": "B<end|><|end|>"}[side]
    assert got[2]["rejected"] is None and got[2]["chosen"] == "<|unknown|>\n<|end|>\n"
    assert got[3]["chosen"] == "" and got[3]["n_prefix_turns"] == 1
    assert chat_format.format_pairs(df.limit(0)).count() == 0


def test_preference_pairs_of_conversations(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "bye"), (1, 4, "user", "bye")]
    rows += [(2, 0, "user", "only"), (2, 1, "assistant", None), (3, 0, "user", "no answer"), (4, 0, "assistant", "unasked"), (None, 0, "user", "x")]
    out = {r["pair_id"]: r for r in chat_format.format_sides(chat_format.sides_of_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[1]["prompt"] == "<|user|>\nq1<|end|>\n<|assistant|>\na1<|end|>\n<|user|>\nq2<|end|>\n" and out[1]["n_prefix_turns"] == 3
    assert "a2" in out[1]["chosen"] and "a1" in out[1]["rejected"] and out[1]["chosen_mask"] == "14:23"
    assert out[2]["rejected"] == "<|assistant|>\nonly<|end|>\n" and out[3]["chosen"] == out[3]["rejected"] == "" and "unasked" in out[4]["chosen"]
    assert len(out) == 4


def test_base_digest_of_no_spans(spark, tmp_path):
    spark.createDataFrame([(1, "no data")], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    r = pii.op3_pii(spark, str(tmp_path)).first()
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == ""
