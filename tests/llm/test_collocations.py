"""Collocations against counting all phrases in dictionaries."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from brackwater.llm import collocations as co
from brackwater.llm import queries

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain(rows, max_n=5, least=100, top=2000, percent=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(A_TO_Z)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for i in range(len(words)) for k in range(1, max_n + 1) if i + k <= len(words))
    found = {p: a for p, a in f.items() if len(p) >= 3 and a >= least}
    out = {}
    for (lang, *w), a in found.items():
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        wider = (q for q in found if q[0] == lang and len(q) > len(w) + 1 and 100 * found[q] >= percent * a)
        if not any(list(q[i : i + len(w)]) == w for q in wider for i in range(1, len(q) - len(w) + 1)):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def check(df, rows, **options):
    got = co.collocations(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and all(t == "bigint" for c, t in got.dtypes if c not in ("lang", "phrase"))
    want = plain(rows, **{k: v for k, v in options.items() if k != "salts"})
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert check(docs, rows, least=30)
    check(docs, rows, least=30, top=7, percent=60)
    assert sorted(map(tuple, queries.op13_collocations(spark, sf_dir).collect())) == plain(rows)


def test_odd_texts_and_overlaps(spark):
    rng = random.Random(3)
    odd = [None, "", " \t ", "...", "A a A a a a a a a a. a a", "\x00 \x01\x00 \x00", "a\x0bb\x0ca\rb", "É é É é", "x" * 5000, "to be or not to be, to be or not to be", "\U0001f600 \U0001f600 \U0001f600", "a\u00a0b a\u00a0b", "ab a b", "a\x01 a\x01 a b"] * 4
    rows = [(rng.choice(["en", "de", None, "und", "", "a\nb"]), t) for t in odd]
    rows += [("en", " ".join(rng.choice(["the", "of", "a", "B", "b,", "c\n", "dd"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(5)
    for options in ({"least": 3}, {"least": 5, "max_n": 2}, {"least": 2, "max_n": 4, "percent": 50}, {"least": 4, "max_n": 6, "top": 3, "salts": 3}):
        assert check(df, rows, **options)
    counted, _ = co.frequent_phrases(df, least=3)
    assert counted.filter("phrase = 'a' and lang = 'en'").first()["n"] == sum(re.split("[ \t.,;:!?\x0a-\x0d]+", (t or "").lower()).count("a") for lg, t in rows if lg == "en")


def test_hot_first_word_over_many_partitions(spark):
    """A word before nearly all others: its suffixes lie in many partitions, whose parts of a count are added up."""
    rng = random.Random(4)
    rows = [("en", " ".join(f"the {rng.choice('abcdefgh')}{rng.randrange(4)} of" for _ in range(80))) for _ in range(60)] + [("en", "same words again here now")] * 900
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert check(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(7), rows, least=20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_tables_and_clashing_names(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert co.collocations(spark.createDataFrame([("en", "too few words")], "lang string, text string")).collect() == []
    names = ("n", "phrase", "word", "suffix", "score", "l", "k")
    rows = [("en", "of the of the")] * 5
    df = spark.createDataFrame([(*r, *names) for r in rows], "lang string, text string, " + ", ".join(f"{c} string" for c in names))
    check(df, rows, least=2)


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(6)
    rows = [(a, n, left, right) for _ in range(300) for left, right in [(rng.randrange(1, 10**15), rng.randrange(1, 10**15))] for a in [rng.randrange(1, min(left, right) + 1)] for n in [rng.randrange(10**15, 10**17)]]
    rows.append((10**15 - 1, 10**15, 10**15 - 1, 10**15 - 1))
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = df.select(*df.columns, co.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score")).filter("score is not null").collect()
    assert len(got) == len(rows) and all(s == 1000 * a * n // (left * right) for a, n, left, right, s in got)
