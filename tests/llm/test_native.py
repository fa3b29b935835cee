"""Brute-force twins of the operators that run in DataFrame operations only."""

import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from brackwater.llm import mixing, quality_rules, queries, winnowing

SPACE = re.compile("[\x20\x09-\x0d]+")
ODD = [
    (1, None, "a", None),
    (2, "", None, None),
    (3, "one", "a", None),
    (4, "a b c d e f g h i j a b c d e k\nx\nx\n \n \n", "b", "clash"),
    (4, "a b c d e f g h i j a b c d e k\nx\nx\n \n \n", "b", "clash"),
    (None, "no id but text \U0001f600 \U0001f601 é", "b", None),
    (7, "# * $ % & | < > word" * 3, "c", None),
    (9, "x" * 3000, "a", None),
    (8, "the same words " * 200, "a", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, rules string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def signals(text):
    ws, text = words(text), text or ""
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {p for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_signals(spark, sf_dir, documents, odd):
    got = {r["doc_id"]: tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in queries.op9_quality_rules(spark, sf_dir).collect()}
    for i, text, _ in documents:
        s = signals(text)
        assert got[i] == (*s, s[0] < 10 or 100 * s[4] > 20 * s[0])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.apply_rules(odd, none).collect()
    assert sorted(tuple(r["rules"])[:5] for r in rows) == sorted(signals(x[1]) for x in ODD)
    assert all(r["rules"]["ratio"] == 0 and r["rules"]["kept"] == (not r["rules"]["base_failed"]) for r in rows)
    assert quality_rules.apply_rules(odd.limit(0), none).count() == 0
    clash = spark.createDataFrame([(1, "twelve words that stand here only once and make no rule fail", "own", "too")], "doc_id long, text string, rules string, _rules string")
    assert [tuple(r) for r in quality_rules.keep_good(clash, none).collect()] == [tuple(r) for r in clash.collect()]


def spark_hash(*values):
    """Spark's xxhash64 of strings, longs (int) and ints (as 4 bytes)."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
    return seed


def verdicts(rows, labels, buckets=16_384, smoothing=0.5, doubt=0.5, keep=0.99):
    """ratio and kept of every document, by plain loops."""
    long = lambda i: struct.pack("<q", i)
    good = sorted({i for i, q in labels if q == 1 and i is not None})
    half = {i: spark_hash(long(i), struct.pack("<i", 29)) % 2 for i in good}  # the last bit is the same with and without sign
    grams = {}
    for k, (_, text, _) in enumerate(rows):
        ws = words(text)
        grams[k] = [spark_hash(w) % buckets for w in ws] + [spark_hash(b, a) % buckets for a, b in zip(ws, ws[1:])]
    raw, target = Counter(), Counter()
    for k, (i, _, _) in enumerate(rows):
        raw.update(grams[k])
        if half.get(i) == 0:
            target.update(grams[k])
    n, m = raw.total(), target.total()
    weight = [round(1000 * (math.log((target[b] + smoothing) / (m + smoothing * buckets)) - math.log((raw[b] + smoothing) / (n + smoothing * buckets)))) for b in range(buckets)] if m else [0] * buckets
    total = {k: sum(weight[b] for b in g) for k, g in grams.items()}
    reached = sorted((total[k] / 1000 + doubt * math.sqrt(len(grams[k]))) / len(grams[k]) for k, (i, _, _) in enumerate(rows) if half.get(i) == 1 and grams[k])
    least = math.floor(1000 * reached[int((1 - keep) * len(reached))]) / 1000 if len(reached) >= 10 else -0.03
    out = []
    for k, (i, text, _) in enumerate(rows):
        c = signals(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        g = len(grams[k])
        out.append((i, failed, not failed and total[k] >= 1000 * (least * g - doubt * math.sqrt(g)), total[k] / (1000 * g) if g else 0.0))
    return out


def test_ratios_and_verdicts(spark, documents):
    """Labels of every fourth document: the threshold comes from a half of the good ones."""
    labels = [(i, int(k % 3 > 0)) for k, (i, text, _) in enumerate(documents)] * 2
    docs = spark.createDataFrame([d[:2] for d in documents], "doc_id long, text string")
    for given in (labels, labels[:20], []):
        got = quality_rules.apply_rules(docs, spark.createDataFrame([(i, q, 0) for i, q in given], "doc_id long, quality int, toxic int")).collect()
        want = {i: (f, k, r) for i, f, k, r in verdicts(documents, given)}
        assert len(got) == len(want)
        for r in got:
            f, k, ratio = want[r["doc_id"]]
            assert (r["rules"]["base_failed"], r["rules"]["kept"]) == (f, k) and abs(r["rules"]["ratio"] - ratio) < 1e-9


def test_quality_verdicts_follow_labels(spark, sf_dir):
    kept = {r["doc_id"]: r["kept"] for r in queries.op9_quality_rules(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good, bad = ([kept[r["doc_id"]] for r in labels if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.85 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_water_filling_and_taken(spark, sf_dir, documents, odd):
    def check(rows, df):
        sizes = Counter()
        for _, text, source in rows:
            sizes[source] += len(words(text))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        budget, open_, target = 1.5 * sum(sizes.values()), set(order), {}
        while True:
            level = (budget - sum(target.values())) / sum(weight[s] for s in open_) if open_ else 0
            over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
            if not over:
                break
            target |= {s: 2.0 * sizes[s] for s in over}
            open_ -= over
        target |= {s: weight[s] * level for s in open_}
        source_of = {i: s for i, _, s in rows}
        taken = Counter()
        out = df.collect()
        assert len(out) == len(rows)
        for r in out:
            s = source_of[r["doc_id"]]
            assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
            taken[s] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
        return sorted(map(tuple, out), key=str)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = check(documents, mixing.mix(docs))
    assert first == check(documents, mixing.mix(docs.repartition(7)))
    check([x[:3] for x in ODD], mixing.mix(odd))
    assert mixing.mix(odd.limit(0)).count() == 0
    total = Counter()
    for r in mixing.mix(docs).collect():
        total[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == +total
    assert mixing.mixed_documents(odd).columns == odd.columns
    clash = docs.limit(40).withColumns({k: F.lit(f"own {k}") for k in ("_size", "_h", "_s", "_taken", "row", "_copy")}).cache()
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns and {tuple(r) for r in out.select("_size", "_h", "_s", "_taken", "row", "_copy").collect()} == {tuple(f"own {k}" for k in ("_size", "_h", "_s", "_taken", "row", "_copy"))}


def test_like_rows_meet_the_target(spark, monkeypatch):
    """A third of the rows are alike in id and size: their fractional repetitions add up, too, however many there are and however they are dealt."""
    rows = [(None, "one two three four five six seven", "a")] * 300 + [(None, "other words of the same number here", "a")] * 40 + [(k, "w " * (k % 50 + 1), "ab"[k % 2]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = []
    for many, parts in ((20_000, 4), (100, 4), (100, 7), (7, 3)):
        monkeypatch.setattr(mixing, "MANY", many)
        dealt = df.repartition(parts)
        out = mixing.mix(dealt).collect()
        taken = Counter()
        for r in out:
            assert r["taken"] <= 2 * r["size"]
            taken[r["target"]] += r["taken"]
        assert all(abs(t - target) <= 1 for target, t in taken.items())
        mixed = Counter(map(tuple, mixing.mixed_documents(dealt).collect()))
        words_of = Counter()
        for (_, text, source), n in mixed.items():
            words_of[source] += n * len(words(text))
        assert sorted(words_of.values()) == sorted(taken.values())
        results.append((Counter(map(tuple, out)), mixed))
    assert all(r == results[0] for r in results)


def choose(values):
    """Winnowing as published: of each window the least hash, the rightmost of equal ones."""
    if not values:
        return []
    out = []
    for i in range(max(1, len(values) - winnowing.WINDOW + 1)):
        window = values[i : i + winnowing.WINDOW]
        at = i + max(k for k, v in enumerate(window) if v == min(window))
        if (values[at], at) not in out:
            out.append((values[at], at))
    return out


def test_windows_choose_rightmost(spark):
    import random

    rng = random.Random(5)
    cases = [[rng.randrange(6) for _ in range(n)] for n in (0, 1, 5, 15, 16, 17, 40, 300)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, h array<int>")
    v = winnowing.selected(winnowing.placed(F.col("h")))
    got = {r["k"]: r["f"] for r in df.select("k", F.transform(v, lambda x: F.struct(winnowing.hash_of(x) - (1 << 31), winnowing.position_of(x))).alias("f")).collect()}
    assert all([tuple(x) for x in got[k]] == choose(c) for k, c in enumerate(cases))


def test_fingerprints_of_edited_texts(spark, sf_dir, documents, odd):
    from pyspark.sql import functions as F

    for rows, df in ((documents, spark.read.parquet(f"{sf_dir}/documents.parquet")), ([x[:3] for x in ODD], odd)):
        order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            m = len(t) // 3
            want.append((i, len(t), hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()))
        found = winnowing.neighbours(df)
        whole = found.withColumn("scratch", winnowing.found(F.col("edited"))).withColumn("near", winnowing.likeness(F.col("own"), F.col("changed"))).collect()
        assert Counter((r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest()) for r in whole) == Counter(want)
        assert all(r["scratch"] == r["changed"] for r in whole)
        assert all(0 <= r["near"] <= 1 for r in whole)
    same = winnowing.neighbours(spark.createDataFrame([(1, "again " * 40), (2, "again " * 40)], "doc_id long, text string")).select(winnowing.likeness(F.col("own"), F.col("following")).alias("n")).collect()
    assert [r["n"] for r in same] == [1.0, 1.0]
    assert winnowing.neighbours(odd.limit(0)).count() == 0
    one = winnowing.neighbours(odd.filter("doc_id = 9")).first()
    assert one["following"] == one["own"] and len(one["own"]) > 0
