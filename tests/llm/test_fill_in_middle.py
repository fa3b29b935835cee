"""Fill-in-the-middle against plain regular expressions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brackwater.llm import fill_in_middle as fim
from brackwater.llm import queries

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
ODD = [None, "", " ", "a", "<P>", "<", "<<P", "a<S>b", "<PP>", "<p>", "x<M", "é" * 300 + "<", "word " * 400, "Ünïcödé \U0001f600 text\n\n\t<P ><S", "a" * 1000, "<" * 700, "\x00\x01 ", "ab<P" * 90 + "<P>", "é" * 127 + "a<M>" + "é" * 90, "漢字" * 200]


def plain(doc_id, text, percent=90, spm_percent=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    units = TOKEN.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def result(df, **options):
    out = fim.transform(df, **options)
    return out.select("doc_id", "fim.*", "text", fim.restored(out["fim.output"], out["fim.form"]).alias("back")).collect()


def check(df, rows, **options):
    got = result(df, **options)
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain(i, t, **{k: v for k, v in options.items() if "percent" in k}) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in got)


@pytest.mark.parametrize("options", [{}, {"giant": 10, "chunk": 7}, {"giant": 100, "chunk": 300, "percent": 100, "spm_percent": 50}])
def test_equals_plain_code(spark, options):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "no id at all"), (3, "same id, other text"), (7, ODD[7]), (7, ODD[7]), (12, ODD[12])]
    rows += [(100 + k, "".join(rng.choice(["é", "<", "P", "S", ">", "word", "x ", "\n", "\U0001f600"]) for _ in range(rng.randrange(900)))) for k in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, **options)


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()], giant=5000, chunk=700)
    assert queries.op11_fill_in_middle(spark, sf_dir).filter("restored_sha256 is null").isEmpty()


def test_one_very_long_text_and_one_hot_id(spark):
    text = "".join(random.Random(1).choices(["lorem ", "é", "ipsum\n", "<P", "7"], k=400_000))
    rows = [(5, text), (6, text + "<M>")] + [(1, "copies of one row")] * 200
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_empty_tables_and_clashing_names(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    names = ("doc_id", "text", "cut", "key", "row", "fim", "n", "place", "part", "h1")
    df = spark.createDataFrame([(1, "some text here, and more", *names[2:]), (2, "x " * 50, *names[2:])], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[2:]))
    for options in ({}, {"giant": 5, "chunk": 4}):
        out = fim.transform(df, **options)
        assert sorted(out.columns) == sorted(names)
        assert {(r["doc_id"], r["fim"]["output"], r["cut"], r["n"]) for r in out.collect()} == {(i, plain(i, t)[5], "cut", "n") for i, t in ((1, "some text here, and more"), (2, "x " * 50))}


def test_functions_compose_as_the_whole_text(spark):
    """Any cutting of a text into chunks, and any bracketing, gives the function and the counts of the whole."""
    rng = random.Random(9)
    for _ in range(40):
        data = "".join(rng.choice("aPSM<>é \U0001f600") for _ in range(rng.randrange(1, 600))).encode()
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(5))})
        whole = fim._functions(pa.array([data]))[0].as_py()
        state, n, marks, points = np.arange(4), np.zeros(4, int), np.zeros(4, int), 0
        for part in fim._functions(pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])])).to_pylist():
            n, marks, points = n + np.array(part["tokens"])[state], marks + np.array(part["marks"])[state], points + part["points"]
            state = np.array(part["exit"])[state]
        assert (state.tolist(), n.tolist(), marks.tolist(), points) == (whole["exit"], whole["tokens"], whole["marks"], whole["points"])
