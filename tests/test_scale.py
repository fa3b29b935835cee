"""Queries that were too slow, too large or sampled at size, against plain loops."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brackwater.functions import java
from brackwater.llm import quality_rules
from brackwater.operators import graph, indexing, store, vector


def test_first_others_are_those_of_all_pairs(spark):
    """Nobody's own row, ids that come twice or under two names, keys that nobody offers; and rows that are joined are few, not all pairs."""
    rows = [(f"m{k % 90}", f"n{k * 7 % 40}", "ab"[k % 2]) for k in range(150)] + [("m1", None, "a"), (None, "n0", "a")]
    asked = [(f"m{k}", t, t[:1]) for k in range(0, 90, 9) for t in ("a", "a1", "b", "c")] * 2
    got = store.first_others(spark.createDataFrame(asked, "q string, t string, key string"), spark.createDataFrame(rows, "id string, name string, key string"), 5)
    want = set()
    for q, t, key in asked:
        met = {(n or "", i) for i, n, k in rows if k == key and i is not None and i != q}
        want |= {(q, t, i, n or None) for n, i in sorted(met)[:5]}
    assert sorted(map(str, want)) == sorted(str((r["q"], r["t"], r["id"], r["name"])) for r in got.collect())
    many = spark.range(40_000).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("name"), F.lit("k").alias("key"))
    wanted = many.select(F.col("id").alias("q"), F.lit("k").alias("t"), "key")
    assert store.first_others(wanted, many, 3).count() == 120_000


def test_every_labelled_row_counts_for_the_rules(spark):
    """45,000 good rows, more than the 20,000 of a half that counted before: weights and threshold against a plain loop over all of them."""
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(11)))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    half = {r["doc_id"]: r["half"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)).alias("half")).collect()}
    ids = [{r[0] for r in quality_rules.labelled_ids(labels, k).collect()} for k in (0, 1)]
    assert ids == [{i for i, h in half.items() if h == k and i % 10} for k in (0, 1)] and min(map(len, ids)) > 20_000
    buckets = 64
    rows = docs.select("doc_id", quality_rules.grams(F.split("text", " "), buckets).alias("g")).collect()
    raw, good = [0] * buckets, [0] * buckets
    for r in rows:
        for b in r["g"]:
            raw[b] += 1
            good[b] += r["doc_id"] in ids[0]
    share = lambda n, of: math.log((n + 0.5) / (of + 0.5 * buckets))
    want = [round(1000 * (share(g, sum(good)) - share(n, sum(raw)))) for n, g in zip(raw, good)]
    assert quality_rules.ratio_weights(docs, labels, buckets=buckets, smoothing=0.5) == want
    reached = sorted((sum(want[b] for b in r["g"]) / 1000 + 0.5 * math.sqrt(len(r["g"]))) / len(r["g"]) for r in rows if r["doc_id"] in ids[1])
    table = F.array(*[F.lit(w) for w in want])
    for keep in (0.99, 0.5, 0.013):
        assert quality_rules.threshold(docs, labels, table, buckets=buckets, doubt=0.5, keep=keep) == math.floor(1000 * reached[int((1 - keep) * len(reached))]) / 1000


def test_closest_of_blocks_equal_all_pairs():
    """Blocks of points, each smaller, larger and equal to the number kept, with copies, zero vectors and own points, in each metric."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(900, 16)), np.zeros((3, 16)), np.repeat(rng.normal(size=(2, 16)), 60, 0)])
    points = points[rng.permutation(len(points))]
    for metric in ("Cosine", "Dot", "Euclid", "Manhattan"):
        seen, got = vector.Closest(points[:200], metric, 5, 9), {}
        for lo, hi in ((0, 2), (2, 7), (7, 300), (300, len(points))):
            here = points[lo:hi]
            asked = np.arange(200)
            own = np.where((asked >= lo) & (asked < hi), asked - lo, -1)
            handed = 0
            for r, c, v in zip(*seen.block(here, vector._unit(here) if metric == "Cosine" else None, asked, own)):
                got.setdefault(r, []).append((-v, lo + c))
                handed += 1
            assert handed <= 5 * 200
        scores = np.round(vector._scores(points, points[:200], metric), 9)
        for q in range(200):
            want = sorted((-scores[q, p], p) for p in range(len(points)) if p != q)[:5]
            assert [(round(a, 8), b) for a, b in sorted(got[q])[:5]] == [(round(a, 8), b) for a, b in want]


def test_index_search_meets_no_pair_as_a_row(spark):
    """The plan of a search of cells joins queries with centres only; before, every pair of a query and a point of its cells was a row."""
    points = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(k).cast("float") for k in range(8)]).alias("embedding")).localCheckpoint()
    wanted = points.filter("vec_id % 50 = 0").selectExpr("vec_id as query", "embedding as vector")
    found = vector.ivf_search(vector.ivf_index(points, cells=8), wanted, probes=8, limit=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    exact = vector.search_many(points, wanted, limit=5)
    assert sorted(map(tuple, found.select("query", "vec_id").collect())) == sorted(map(tuple, exact.select("query", "vec_id").collect()))


def test_files_are_parsed_in_bounded_pieces(spark):
    """Many small files and a few large ones: each once, in order, no piece above the bounds but for a file that is; and nodes and edges parse no file again."""
    sources = ["x" * n for n in [10] * 250 + [java.PIECE_CHARS + 5, 7, java.PIECE_CHARS // 2, java.PIECE_CHARS // 2, 3]] + [None]
    pieces = list(java._pieces(pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(sources))]), pa.array(sources)], names=["path", "source"])))
    assert [s for _, part in pieces for s in part] == sources and [p for part, _ in pieces for p in part] == [str(k) for k in range(len(sources))]
    assert all(len(part) <= java.PIECE_FILES and (len(part) == 1 or sum(len(s or "") for s in part) <= java.PIECE_CHARS) for _, part in pieces)
    files = spark.range(300).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("package p; class C"), F.col("id"), F.lit(" { int f; void m() { m(); } }")).alias("source"))
    edges = indexing.relationships(java.parsed(files))
    assert "MapInArrow" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert {r["rel_type"]: r["count"] for r in edges.groupBy("rel_type").count().collect()} == {"CONTAINS": 900, "CALLS": 300}
    assert indexing.entities(java.parsed(files)).count() == 901


def test_graph_queries_group_only_edges_at_their_nodes(spark):
    """Walks, ways of two edges and neighbours from plain relationships equal those from the whole graph's edges; edges repeat, some go both ways, some are loops."""
    rows = [(f"n{k * 7 % 23}", f"n{k * k % 29}", "CALLS" if k % 3 else "USES") for k in range(200)] * 2 + [("n1", "n1", "CALLS"), ("n1", "n7", "USES")]
    rels = spark.createDataFrame(rows, "source_id string, target_id string, rel_type string")
    plan = [*graph.standard(6, 4), graph.Strategy("many", 2, 1100)]
    walked = lambda edges: sorted(map(str, graph.walk(edges, "n1", plan).collect()))
    assert walked(rels) == walked(graph.ways(rels))
    out, into = graph.ways(rels), rels.groupBy(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "rel_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, graph.two_step_counts(rels).collect())) == sorted(map(tuple, graph.two_steps(out, into).collect()))
    some = spark.createDataFrame([("n1",), ("n7",)], "node string")
    for both in (True, False):
        whole = graph.neighbours(rels, include_reverse=both)
        assert sorted(map(tuple, graph.neighbours(rels, include_reverse=both, nodes=some, parts=3).collect())) == sorted(map(tuple, whole.filter("node in ('n1', 'n7')").collect()))
