import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from brackwater.llm import quality_model, queries, toxicity


def area(scores, y):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    s = np.asarray(scores)[order]
    ranks[order] = [np.mean(np.flatnonzero(s == v)) + 1 for v in s]
    y = np.asarray(y)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / max((y == 1).sum() * (y == 0).sum(), 1)


def check(spark, sf, query, label, divisor, rest, least):
    got = {r["doc_id"]: r for r in query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(got) == sorted(r["doc_id"] for r in docs)
    for r in got.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(got[r["doc_id"]]["score"], r[label], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert area([h[0] for h in held], [h[1] for h in held]) >= least
    assert np.mean([h[1] == h[2] for h in held]) >= least


def test_quality_on_held_out(spark):
    check(spark, "/root/testdata/sf0.1", queries.op2_quality, "quality", 3, 1, 0.95)


def test_toxicity_on_held_out(spark):
    check(spark, "/root/testdata/sf0.1", queries.op6_toxicity, "toxic", 5, 0, 0.9)


def test_scores_do_not_depend_on_other_columns_or_order(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for model in (quality_model, toxicity):
        one = {r["doc_id"]: r["score"] for r in model.classify(docs, labels).collect()}
        two = {r["doc_id"]: r["score"] for r in model.classify(docs.withColumns({"lang": F.lit("x"), "score": F.lit(1), "quality": F.lit(0), "toxic": F.lit(1)}).repartition(3), labels).collect()}
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (None, "no id"), (5, "# " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, None, None), (5, 0, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (quality_model, toxicity):
        for labels in (none, some):
            got = model.classify(docs, labels).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert model.classify(docs.limit(0), some).count() == 0


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(quality_model.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(float)
    rules, intercept = quality_model.fitted(x, y, trees=10, depth=3, strength=0.002, seed=1)
    assert 0 < len(rules) < 60
    z = intercept + sum(w * quality_model.holds(r, x) for r, w in rules)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, " + ", ".join(f"{s} double" for s in quality_model.STATISTICS))
    got = np.array([r[0] for r in df.orderBy("k").select(quality_model.compiled(rules, intercept)).collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and np.mean((got > 0.5) == y) > 0.95


def test_label_model_finds_accuracies(spark):
    """Accuracies and correlations come out of votes alone, as a brute-force run of the same rounds has them."""
    rng = np.random.default_rng(6)
    y = (rng.random(6000) < 0.15).astype(float)
    fires = lambda hit, noise: ((y == 1) & (rng.random(6000) < hit) | (y == 0) & (rng.random(6000) < noise)).astype(int)
    good, n = fires(0.6, 0.002), len(toxicity.FIXED)
    votes = np.zeros((6000, n + 3), int)
    for k, v in enumerate((good, fires(0.6, 0.002), fires(0.5, 0.003), good, fires(0.03, 0.03))):
        votes[:, k if k < 3 else n + k - 3] = v
    rows = [([j for j in range(3) if v[n + j]], v[:n].tolist()) for v in votes]
    df = spark.createDataFrame(rows, "hits array<int>, votes array<int>").groupBy("hits", "votes").agg(F.count(F.lit(1)).alias("n")).repartition(3)
    prior, hit, false, weight = toxicity.label_model(df, np.array([n, n + 1, n + 2]), n + 3)
    assert abs(prior - 0.15) < 0.03 and abs(hit[1] - 0.6) < 0.1 and false[1] < 0.02 and hit[n + 1] / max(false[n + 1], 1e-9) < 4
    assert weight[0] < 0.7 and weight[n] < 0.7 and weight[1] > 0.9
    post = toxicity.posterior(votes.astype(float), (prior, hit, false, weight))
    assert np.mean((post > 0.5) == y) > 0.93
    model = None
    for _ in range(8):
        toxic = toxicity.posterior(votes.astype(float), model)
        sums = [np.array([6000.0, toxic.sum()]), *(np.array([sum(w * v[a] for w, v in zip(c, votes)) for a in range(n + 3)]) for c in (toxic, 1 - toxic))]
        sums += [sum(w * np.outer(v, v) for w, v in zip(c, votes)) for c in (toxic, 1 - toxic)]
        model = toxicity.next_model(sums)
    assert np.isclose(model[0], prior) and all(np.allclose(a, b) for a, b in zip(model[1:], (hit, false, weight)))


def test_votes_are_what_texts_hold(spark):
    texts = ["You are an idiot! idiots", "nothing at all", "", "du bist dumm, dumm", "f*** off, I will hurt you", None, "THE Vermin and pigs"]
    features = {"idi": 0, "idiot$": 1, "dumm$": 2, "ver": 3}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text")
    got = {r["doc_id"]: (r["hits"], r["votes"]) for r in toxicity._observed(df, features, "doc_id long").collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        want = sorted({v for f, v in features.items() for w in words if (f == w + "$" if f.endswith("$") else w.startswith(f) and len(w) > len(f))})
        fixed = [int(any(w in v.split() for w in words)) for v in toxicity.INSULTS.values()] + [int(p.search(t or "") is not None) for p in toxicity.PATTERNS.values()]
        assert got[k] == (want, fixed)


def test_statistics_of_a_text():
    """The statistics of the quality model, by plain loops."""
    texts = ["", "one", "A b! A b! a, C. 12 | x\n\nA b!\n \nlast line", "w " * 500, "é \u00df €5", "#tag word# plain & *"]
    for t in texts:
        got = dict(zip(quality_model.STATISTICS, quality_model.statistics(t)))
        ws = t.encode().split()
        if not ws:
            assert not any(got.values())
            continue
        n, raw = len(ws), t.encode()
        lines = [x for x in raw.split(b"\n") if x.split()]
        pairs = {(a, b) for a, b in zip(ws, ws[1:])}
        want = {
            "words": n, "word_length": sum(len(w) for w in ws) / n, "longest_word": max(len(w) for w in ws), "distinct": len(set(ws)) / n, "distinct_pairs": len(pairs) / max(n - 1, 1), "top_share": max(ws.count(w) for w in set(ws)) / n,
            "same_as_last": sum(a == b for a, b in zip(ws, ws[1:])) / n, "upper": sum(65 <= c <= 90 for c in raw) / max(sum(65 <= c <= 90 or 97 <= c <= 122 for c in raw), 1), "digits": sum(48 <= c <= 57 for c in raw) / len(raw),
            "symbols": sum(c in b"#*$%&|<>@^~_=+{}[]\\" for c in raw) / len(raw), "bars": raw.count(b"|") / n, "shouts": raw.count(b"!") / n, "stops": raw.count(b".") / n, "commas": raw.count(b",") / n,
            "line_words": n / max(len(lines), 1), "dup_lines": 1 - len(set(lines)) / max(len(lines), 1), "other_bytes": sum(c > 127 for c in raw) / len(raw), "loud_words": sum(w[0] in b"!#*$%&|" or w[-1] in b"!#*$%&|" for w in ws) / n,
        }
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and got.keys() == want.keys()


def test_texts_of_one_id_give_one_threshold(spark):
    """An id with two texts, dealt in two ways: scores and thresholds are the same."""
    rows = [(k, ("you vile scum " if k % 3 == 0 else "a kind note ") + f"w{k % 7} x{k % 5}", int(k % 3 == 0)) for k in range(120)] + [(3, "a kind note w1", 1), (4, "you vile scum", 0)] * 2
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:120]], "doc_id long, toxic int")
    out = [sorted(map(tuple, toxicity.classify(d, labels, least_texts=3).collect())) for d in (docs.repartition(1), docs.repartition(5), docs.orderBy("text"))]
    assert out[0] == out[1] == out[2]


def test_toxic_texts_of_a_rare_language(spark):
    """Ten lexicons of one language speak together, and two of a rarer one: silence of the first is no sign that a text of the second is clean."""
    rng = np.random.default_rng(9)
    common, rare = [f"{a}ax" for a in "bcdfghjklm"], ["veqo", "zujo"]
    rows = []
    for k in range(2400):
        lang, toxic = int(k % 4 == 0), int(k % 10 == 1 or k % 40 == 0)
        says = [w for w in (rare if lang else common) if toxic and rng.random() < (0.7 if lang else 0.45)] or [(rare if lang else common)[0]] * toxic
        rows.append((k, " ".join([*says, *(f"{'pq'[lang]}{rng.integers(30)}" for _ in range(8))]), toxic if k % 2 == 0 or k % 20 == 1 else None, lang))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    true = {k: int(k % 10 == 1 or k % 40 == 0) for k in got}
    for lang in (0, 1):
        toxic, clean = ([got[k]["score"] for k, _, _, own in rows if own == lang and true[k] == y] for y in (1, 0))
        assert min(toxic) > 0.5 > max(clean) and len(toxic) >= 50, lang
