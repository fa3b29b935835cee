"""Brute-force twins of near-duplicates, archives and language-model counts."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brackwater.llm import dedup, language_model, queries, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def shingles(text, size):
    ws = words(text)
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def groups(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    of = {i: i for i, _ in sets if i is not None}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                of[y] = x
    return Counter((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets)


def check(df, rows, size, percent):
    got = dedup.near_duplicates(df, shingle=size, percent=percent)
    assert Counter(map(tuple, got.collect())) == groups(rows, size, percent)


def test_groups_match_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size in (2, 5):
        check(docs, rows, size, 80)
    assert Counter(map(tuple, queries.op8_minhash(spark, sf_dir).collect())) == groups(rows, 2, 80)


def test_groups_of_odd_texts_and_families(spark):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a b"), (7, "a b"), (None, "a b"), (None, "other words here"), (8, "x " * 3000)]
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    for k in range(120):  # chains: each differs a little from the one before
        base = list(base)
        base[rng.randrange(len(base))] = f"n{k}"
        rows.append((1000 - k, " ".join(base)))
    for k in range(60):  # short sets that share one shingle
        rows.append((2000 + k, f"the of {rng.randrange(99)} {rng.randrange(99)} {rng.randrange(99)}"))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    check(df, rows, 2, 80)
    kept = dedup.keep_first(df, shingle=2)
    assert kept.columns == df.columns and kept.filter("doc_id = 7").count() == 0 and kept.filter("doc_id is null").count() == 2
    twice = df.unionByName(df.filter("doc_id in (4, 8)")).withColumns({"dropped": F.lit(1), "_dropped": F.lit(2)})
    kept = dedup.keep_first(twice, shingle=2)
    assert kept.columns == twice.columns and [kept.filter(f"doc_id = {k}").count() for k in (4, 5, 8)] == [1, 0, 1] and kept.filter("doc_id is null").count() == 2
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    from brackwater.llm.common import Scratch

    edges = [(k, k + 1) for k in range(0, 40) if k != 20] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r["node"]: r["least"] for r in dedup.components(spark.createDataFrame(edges, "x long, y long"), Scratch(spark, "t")).collect()}
    want = {k: 0 for k in range(1, 21)} | {k: 21 for k in range(22, 41)} | {k: 100 for k in range(101, 130)}
    assert got == want
    assert dedup.components(spark.createDataFrame([], "x long, y long"), Scratch(spark, "t")).count() == 0


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def want_records(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    return Counter((i, len(t.encode()), digest(t.encode()), "response" if first.get(t, i) == i else "revisit", None if first.get(t, i) == i else first[t]) for i, t in rows)


def test_archives_come_back(spark, sf_dir, tmp_path):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert Counter(map(tuple, queries.op4_warc(spark, sf_dir).collect())) == want_records(rows)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    odd = [(1, None), (2, ""), (3, fake), (4, fake * 3 + "é\U0001f600"), (5, "x" * 70_000 + fake), (6, "same"), (7, "same"), (7, "same"), (None, "same"), (8, "WARC/1.1\r\n"), (9, "\r\n\r\n"), (10, "a\r\n\r\nWARC/1.1\r\n\r\n")] + [(k, f"{k} " * k + fake) for k in range(20, 60)]
    df = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}", t, "z") for i, t in odd], "page_id long, url string, html string, file string").withColumns({k: F.lit("own") for k in ("_least", "_digest", "digest", "payload", "id", "first")}).repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", old):  # small blocks: chains run over many of them, and records over their borders
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.round_trip(df, f"{tmp_path}/a{size}")
            assert Counter(map(tuple, got.collect())) == want_records([(i, t or "") for i, t in odd])
            texts = warc.read(spark, f"{tmp_path}/a{size}", payloads=True).filter("type = 'response'").select("page_id", "payload").collect()
            plain = {i: t or "" for i, t in odd}
            assert all(plain[int(r["page_id"])] == r["payload"] for r in texts if r["page_id"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert warc.round_trip(df.limit(0), f"{tmp_path}/none").count() == 0


def test_language_model_counts_and_gain(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    tokens = {i: [*words(t), "\n"] for i, t in docs.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = queries.op5_context_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        ws = tokens[r["doc_id"]]
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["score"] < 0
    out = [r for r in got if r["held_out"]]
    assert sum(r["event_score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "a " * 500), (4, "Z" * 5000), (4, "é\U0001f600 x"), (None, "null id"), (6, "a\n\tb")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = language_model.score(df, train=F.col("doc_id") == 3).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert all(r["train_tokens"] == 501 for r in got)
    assert language_model.score(df.limit(0)).count() == 0
    none = language_model.score(df, train=F.lit(False)).collect()
    assert all(r["n_known"] == 0 for r in none)


def test_word_order_counts(spark):
    """Texts of the same words, with the same kinds of neighbour, differ by the order of words alone; long texts are read in pieces that hide nothing."""
    rng = random.Random(5)
    names = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath"]
    line = lambda: " ".join(["start", *[w for k in [rng.randrange(4) for _ in range(30)] for w in (names[2 * k], names[2 * k + 1])]])
    rows = [(k, line()) for k in range(60)]
    seen = rows[0][1].split()
    rows += [(100, " ".join(seen)), (101, " ".join(["start", *seen[1::2], *seen[2::2]]))]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), train=F.col("doc_id") < 100).collect()}
    assert got[100]["n_known"] == got[101]["n_known"] and got[100]["score"] > got[101]["score"] + 5 and got[100]["bits_per_byte"] < got[101]["bits_per_byte"]


def small_tables(words, frequent=()):
    """Tables of equally frequent symbols, all counts empty."""
    names = sorted({*words, language_model.END})
    rank = np.array([frequent.index(w) + 1 if w in frequent else 0 for w in names] + [0])
    symbols, letters = language_model.balanced(np.ones(len(names) + 1)), language_model.balanced(np.arange(1, 257))
    shape = language_model.sized(1_000, 23)
    n = int(language_model.regions(len(names) + 1, shape)[-1])
    return names, language_model.Tables(symbols, rank, letters, shape, np.zeros(n, np.uint16), np.zeros(1 << shape.follows, np.uint32))


def test_blocks_hide_nothing():
    """Tokens read in small blocks have the decisions, slots and contexts that they have by themselves."""
    rng = random.Random(6)
    words = [f"w{k}".encode() for k in range(50)]
    names, t = small_tables(words, words[:3])
    texts = [[*(rng.choice(words) for _ in range(n)), language_model.END] for n in (0, 1, 40, 3, 900)]
    flat, starts = [w for x in texts for w in x], np.cumsum([0, *[len(x) for x in texts][:-1]])
    ids, hashes = np.array([names.index(w) for w in flat]), np.array([abs(hash(w)) for w in flat], np.uint64)
    contexts = np.array([words.index(w) + 1 if w in words[:3] else 5_000 + names.index(w) for w in flat])
    s = language_model.stream(ids, hashes, contexts, starts)
    for x, at in zip(texts, starts):
        for k in range(len(x)):
            assert s.before[at + k] == np.uint64(int(contexts[at + k - 1] if k else 0) * int(language_model.M3) % 2**64) and s.place[at + k] == k
            frequent = [w for w in x[:k] if w in words[:3]]
            assert s.frequent[at + k] == np.uint64((words.index(frequent[-1]) + 1 if frequent else 0) * int(language_model.M3) % 2**64)
            if k > 1:
                same = [j for j in range(len(flat)) if s.place[j] > 1 and flat[j - 1] == x[k - 1] and flat[j - 2] == x[k - 2]]
                assert all(s.key[j] == s.key[at + k] for j in same)
    whole = language_model.token_slots(t, s, 0, len(ids))
    parts = [language_model.token_slots(t, s, lo, lo + 7) for lo in range(0, len(ids), 7)]
    for k in (0, 1):
        assert np.array_equal(np.concatenate([p[k] for p in parts]), whole[k])
    assert all(np.array_equal(np.concatenate([p[2][c] for p in parts]), whole[2][c]) for c in range(3))
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 2, 30, 40_000, 5)]
    alone = [np.concatenate([np.stack([bit, *slots]) for _, bit, slots in language_model.spelled_slots(t, [w])], 1) for w in words]
    both = list(language_model.spelled_slots(t, words))
    assert len(both) > 2 and np.array_equal(np.concatenate([np.stack([bit, *slots]) for _, bit, slots in both], 1), np.concatenate(alone, 1))


def test_codes_keep_order_and_are_short():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 300):
        weights = rng.pareto(1.0, n) + 0.01
        code = language_model.balanced(weights)
        paths = ["".join("01"[int(s >= m)] for m in code.node[code.first[s] :][: code.length[s]]) for s in range(n)]
        assert paths == sorted(paths) and len(set(paths)) == n and abs(sum(0.5 ** len(p) for p in paths) - 1) < 1e-9
        p = weights / weights.sum()
        assert (p * code.length).sum() <= -(p * np.log2(p)).sum() + 2


def test_what_prevails_after_two_tokens():
    """Majority votes: a value that has more than half of a slot's votes is what remains, however they are dealt."""
    rng = random.Random(9)
    key, ids = np.zeros(90, np.uint64), np.array([7] * 50 + [rng.randrange(100, 900) for _ in range(40)])
    for _ in range(5):
        ids = ids[np.array(rng.sample(range(90), 90))]
        table = np.zeros(1, np.uint32)
        for part in np.split(ids, [13, 40, 41]):
            at, value, n = language_model.prevailing(key[: len(part)], part, 1)
            table[at] = language_model.prevailed(table[at], value, n)
        assert table[0] >> 6 == 7 and 0 < table[0] & 63 <= 50
    t = small_tables([b"x"])[1]
    s = language_model.Stream(ids, key, key, key, np.arange(90))
    t.follows[0] = (7 << 6) | 1
    found, _ = language_model.follower(t, s, ids == 7)
    assert all((f == -1) == (i == 7 or k < 2) for k, (f, i) in enumerate(zip(found, ids)))


def test_whole_texts_are_scored(spark):
    """A longer unknown word costs more in score, which is what bits_per_byte says for all bytes; event_score has it as one event."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("qxzjkvw") for _ in range(n))
    rows = [(k, "the quick brown fox jumps over the lazy dog " * 4) for k in range(20)] + [(100, "the quick " + word(5)), (101, "the quick " + word(50))]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), train=F.col("doc_id") < 100).collect()}
    assert got[100]["n_known"] == got[101]["n_known"] == 3 and got[101]["score"] < 2 * got[100]["score"] < 0
    assert abs(got[100]["event_score"] - got[101]["event_score"]) < 1e-3 and got[100]["event_score"] > got[100]["score"]
    assert all(abs(r["score"] * math.log2(10) + r["bits_per_byte"] * len(dict(rows)[i])) < 1e-6 for i, r in got.items())


def test_copies_are_told_apart(spark, sf_dir):
    """A held-out copy of a training text takes few bits, and followed tells training texts that occur twice from others."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))
    rows = [(k, text(120)) for k in range(150)]
    rows += [(500 + k, rows[k][1]) for k in range(40, 80)] + [(1000, rows[5][1]), (1001, text(120))]
    got = {r["doc_id"]: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string"), train=F.col("doc_id") < 1000).collect()}
    assert got[1000]["bits_per_byte"] < 0.9 * got[1001]["bits_per_byte"]
    assert all(got[k]["followed"] > 60 for k in (*range(40, 80), *range(540, 580), 1000))
    assert all(got[k]["followed"] < 40 for k in (*range(40), *range(80, 150), 1001))


def test_language_model_learns_from_all_decisions(spark, sf_dir):
    """Every decision of every training text is in each table and in the refinement, and every distinct word is spelled; tables grow with the tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).limit(40).repartition(3)
    texts = [language_model.tokens_of(bytes(r["text"])) for r in docs.collect()]
    totals = Counter(t for ts in texts for t in ts)
    counted = language_model.token_counts(docs)
    want = np.bincount(np.frombuffer(b"".join(t + b" " for t in totals if t != language_model.END), np.uint8), minlength=256)
    assert np.array_equal(language_model.letter_counts(counted), want)
    names = sorted(t for t, c in totals.items() if c > 1 or t == language_model.END)
    index = {t: k for k, t in enumerate(names)}
    symbols = language_model.balanced(np.array([*(totals[t] for t in names), 1.0]))
    n_tokens = sum(totals.values())
    shape = language_model.sized(n_tokens, 22)
    none = np.zeros(0, np.uint16)
    empty = language_model.Tables(symbols, np.zeros(len(names) + 1, np.int64), language_model.balanced(want + 1), shape, none, none)
    given = spark.sparkContext.broadcast((index, np.arange(len(names) + 1)))
    tables, mixed = language_model.gathered(language_model.counted(docs, counted, given, empty), empty)
    pair = np.stack([tables.counts & 255, tables.counts >> 8], 1).astype(int)
    ids = np.array([index.get(t, len(names)) for ts in texts for t in ts])
    true = np.zeros((len(names) + 1, 2), int)
    for i in ids:
        for m in symbols.node[symbols.first[i] :][: symbols.length[i]]:
            true[m, int(i >= m)] += 1
    assert np.array_equal(pair[: len(names) + 1], np.ceil(true / np.maximum(1, true.max(1, keepdims=True) / 254)).astype(int))
    first = language_model.regions(len(names) + 1, shape)
    spelled = np.zeros((int(first[-1]), 2), int)
    for word, bit, slots, times in language_model.spelled_of(pa.record_batch({"token": list(totals), "c": list(totals.values())}), empty, lambda t, c: 1 if t in index else c):
        for part in slots:
            np.add.at(spelled, (part, bit.astype(int)), times[word])
    want = np.ceil(spelled / np.maximum(1, spelled.max(1, keepdims=True) / 254)).astype(int)
    assert np.array_equal(pair[first[3] :], want[first[3] :]) and want[first[6] :].sum() > 1000
    assert mixed.weights.shape == (language_model.INPUTS, language_model.GATES) and np.isfinite(mixed.weights).all() and np.isfinite(mixed.log10s).all()
    once = next(t for t, c in totals.items() if c == 1 and len(t) > 5)
    assert all((tables.counts[k] > 0).all() for _, _, slots in language_model.spelled_slots(tables, [once]) for k in slots)
    assert language_model.sized(10_000, 22) < language_model.sized(300_000, 22) < language_model.sized(1_000_000, 22)
    back, same = language_model.unpacked(language_model.packed(tables, mixed))
    assert np.array_equal(back.counts, tables.counts) and np.array_equal(back.symbols.node, tables.symbols.node) and back.shape == shape and np.array_equal(same.log10s, mixed.log10s)


def test_workers_hold_little(monkeypatch):
    """A batch of 7 MB of text takes a worker little room in counting and in scoring, however many words it knows, and the results are those of one text after the other; a model is held once."""
    rng = np.random.default_rng(4)
    words = [f"w{k}".encode() for k in range(200)]
    names, t = small_tables(words, words[:3])
    t = t._replace(counts=rng.integers(0, 2**16, len(t.counts)).astype(np.uint16))
    m = language_model.refined(rng.normal(0.3, 0.1, (language_model.GATES, language_model.INPUTS)), rng.integers(0, 50, (language_model.GATES, language_model.STEPS, 2)).astype(float))
    texts = [b"", b" ".join(words), *(b" ".join(words[k] for k in rng.integers(0, 200, n)) for n in rng.integers(5_000, 9_000, 200)), b"Unknown \t w3", b""]
    batch = pa.record_batch({"doc_id": np.arange(len(texts)), "held_out": np.arange(len(texts)) % 3 == 0, "text": pa.array(texts, pa.binary())})
    index, value = {w: k for k, w in enumerate(names)}, types.SimpleNamespace
    known = value(value=(index, np.arange(len(names) + 1)))
    model = value(value=language_model.packed(t, m))
    counts = value(value=(np.array([*[3.0] * len(names), 0.0]), np.zeros(len(names) + 1)))
    monkeypatch.setattr(language_model, "TaskContext", value(get=lambda: value(partitionId=lambda: 0)))
    run = language_model._scored(value(mapInArrow=lambda f, kind: f), known, counts, model)

    def whole(batches):
        return pa.Table.from_batches(run(batches)).drop_columns("chunk").to_pylist()

    want = [r for k in range(len(texts)) for r in whole(iter([batch.slice(k, 1)]))]
    tables, _ = language_model.unpacked(model.value)
    assert tables.counts is language_model.unpacked(model.value)[0].counts and not any(isinstance(x, tuple) for x in model.value[1:])
    streams = lambda: language_model.streams(iter([x.select(["text"]) for x in (batch.slice(0, 0), batch)]), language_model.Vocabulary(*known.value, t.rank))
    peaks = []
    for work in (streams, lambda: run(iter([batch]))):
        tracemalloc.start()
        total = sum(1 for _ in work())
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
        assert total
    assert max(peaks) < 50, peaks
    assert [{**r, "rare": len(r["rare"])} for r in whole(iter([batch]))] == [{**r, "rare": len(r["rare"])} for r in want]
    sizes = [len(s.ids) for s in streams()]
    assert sum(sizes) == sum(len(language_model.tokens_of(x)) for x in texts) and all(100_000 <= n < 110_000 for n in sizes[:-1]) and len(sizes) > 10


def test_token_probabilities_add_up():
    """The probabilities of all symbols at one place sum to 1, and so do those of all bytes."""
    rng = np.random.default_rng(0)
    names, t = small_tables([f"w{k}".encode() for k in range(40)])
    t = t._replace(counts=rng.integers(0, 2**16, len(t.counts)).astype(np.uint16))
    m = language_model.refined(rng.normal(0.3, 0.1, (language_model.GATES, language_model.INPUTS)), rng.integers(0, 50, (language_model.GATES, language_model.STEPS, 2)).astype(float))
    hashes = np.array([5, 6, 7], np.uint64)
    t.follows[:] = (np.arange(len(t.follows)) % 256 << 24) | (9 << 6) | 3
    total = 0.0
    for last in range(len(names) + 1):
        s = language_model.stream(np.array([1, 2, last]), hashes, np.array([1, 2, 3]), np.array([0]))
        s = s._replace(key=np.repeat((s.key[2] >> np.uint64(8) << np.uint64(8)) | ((s.key[2] >> np.uint64(64 - t.shape.follows)) & np.uint64(255)), 3))
        total += 10 ** float(language_model.log10_of_tokens(s, t, m)[2])
    assert abs(total - 1) < 1e-3 and language_model.follower(t, s)[0][2] == 9
    at_start = lambda b: 10 ** float(next(m.log10(*language_model.spelled_inputs(language_model.known(t.counts, slots)), bit).astype(float)[: t.letters.length[b]].sum() for _, bit, slots in language_model.spelled_slots(t, [bytes([b]) * 2])))
    assert abs(sum(at_start(b) for b in range(256)) - 1) < 1e-3


def test_tokens_numbered_by_arrow_are_those_of_python():
    """Odd white space, letters beyond ASCII, bytes that are no UTF-8, empty texts, and none at all; names are the same whether they come at once or in turn."""
    texts = [b"", b" ", b"A b\x0ba\x0c\rB  a ", "É é ß\u00a0x\u0085y \u2003z".encode(), b"\xff\xfe \xc3\x28 \x1c\x1fq", b"\n\n", b"a" * 70 + b" a", b"Z", b"\x00 \x00a"]
    for kind in (pa.binary(), pa.large_binary()):
        for some in (texts, texts[:2], [], texts * 3):
            column = pa.concat_arrays([pa.array([b"left out"], kind), pa.array(some, kind)]).slice(1)
            got = language_model.coded(column)
            assert [[got.distinct[k] for k in got.keys[a : a + n]] for a, n in zip(got.starts, got.sizes)] == [language_model.tokens_of(t) for t in some]
            assert len(set(got.distinct)) == len(got.distinct) and got.sizes.sum() == len(got.keys)
    names = language_model.Vocabulary({b"a": 0, b"b": 1}, np.array([0, 1, 2]), np.array([0, 7, 0]))
    for part in (texts[:3], texts[3:], texts):
        keys = names.keys_of(language_model.coded(pa.array(part, pa.binary())))
        assert [names.tokens[k] for k in keys] == [w for t in part for w in language_model.tokens_of(t)]
    rest = language_model.COMMON + 1
    assert [(p, i, c) for p, i, c in zip(names.places, names.ids, names.contexts)] == [(q := {b"a": 0, b"b": 1}.get(t, 2), q, 7 if q == 1 else rest + int.from_bytes(t[-2:])) for t in names.tokens]
