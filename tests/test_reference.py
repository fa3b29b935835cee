"""Each query against its SQL in DuckDB, and cases of single operators."""

import math

import duckdb
import pytest

from brackwater.functions import weights
from brackwater.operators import graph, store, vector
from brackwater.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), df.columns
    if name not in catalog.ORACLES:
        assert len(columns) == len(set(columns))
        return
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    other = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(other)
    order = sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == sorted(tuple(plain(r[other.index(c)]) for c in order) for r in cursor.fetchall())


@pytest.fixture(scope="module")
def small(spark):
    edges = [("c", f"m{k}", "CONTAINS") for k in range(5)] + [("m0", "m1", "CALLS"), ("m1", "m2", "CALLS"), ("m2", "m3", "CALLS"), ("m0", "m3", "CALLS")] + [("m0", "m1", "CALLS")] * 2
    return spark.createDataFrame(edges, "source_id string, target_id string, rel_type string")


def test_neighbours_are_a_set_both_ways_and_a_bag_forward(small):
    both = graph.neighbours(small).filter("node = 'm0' and neighbour = 'm1'").collect()
    one = graph.neighbours(small, include_reverse=False).filter("node = 'm0' and neighbour = 'm1'").collect()
    assert [r["n"] for r in both] == [1] and [(r["n"], r["w"]) for r in one] == [(3, 30_000)]


def test_simple_paths_and_degrees(small):
    calls = small.filter("rel_type = 'CALLS'")
    assert [r["path"] for r in graph.simple_paths(calls, "m0", "m3", 5).collect()] == ["m0 > m3", "m0 > m1 > m2 > m3"]
    assert {r["node"]: r["degree"] for r in graph.degrees(small).collect()}["m4"] == 1
    assert {r["node"]: r["level"] for r in graph.reach(calls, "m0", 2).collect()} == {"m1": 1, "m3": 1, "m2": 2}


def test_walks_follow_edges_and_do_not_depend_on_partitions(spark, small):
    edges = graph.ways(small)
    pairs = {(r["node"], r["neighbour"]) for r in edges.filter("not forward").collect()}
    plan = [graph.Strategy("s", 8, 6), graph.Strategy("ahead", 3, 2, forward=True)]
    one, two = ({(r["strategy"], r["walk"]): r["path"] for r in graph.walk(e, "m0", plan).collect()} for e in (edges, edges.repartition(3)))
    assert one == two and all(len(one["s", k]) == 9 for k in range(6)) and all(len(one["ahead", k]) <= 4 and one["ahead", k][-1] in ("m1", "m2", "m3") for k in range(2))
    assert all((a, b) in pairs for k in range(6) for a, b in zip(one["s", k], one["s", k][1:]))
    assert graph.walk(edges, "lonely", plan[:1]).first()["path"] == ["lonely"]
    probs = graph.visits(graph.walk(edges, "m0", plan[:1])).groupBy("strategy").agg({"prob": "sum"}).first()[1]
    assert abs(probs - 1) < 1e-9


def test_walks_follow_weights(spark, small):
    """From m0 edges forward weigh 3 (three calls of m1) and 1 (m3); guidance makes m3 likelier."""
    edges = graph.ways(small.filter("rel_type = 'CALLS'"))
    share = lambda **more: sum(r["path"][1] == "m1" for r in graph.walk(edges, "m0", [graph.Strategy("s", 1, 2000, forward=True, guidance=1.0, all_guided=True)], **more).collect()) / 2000
    assert abs(share() - 0.75) < 0.03
    assert abs(share(guidance=spark.createDataFrame([("m3", 4.0)], "node string, score double")) - 0.5) < 0.04
    boosted = graph.walk(graph.ways(small), "m0", [graph.Strategy("s", 1, 2000, factors=(("CONTAINS", 10.0),))]).collect()
    assert abs(sum(r["path"][1] == "c" for r in boosted) / 2000 - 3 / 5) < 0.04


def test_adapted_weights():
    gui = weights.adapted("gui_application", 2.5, 0)
    assert (gui["CALLS"], gui["USES"], gui["CONTAINS"]) == (1.56, 1.43, 0.56)
    framework = weights.adapted("framework_library", 3.0, 0)
    assert (framework["EXTENDS"], framework["IMPLEMENTS"], framework["RETURNS"]) == (1.12, 1.05, 0.65)


def test_store_edges(spark, small):
    assert store.filter_relationships(small).count() == small.count()
    out = store.incident(small, "m0", "both", "CALLS", strict_precedence=False).count()
    assert out == 4 and store.incident(small, "c", "both", "CALLS", strict_precedence=True).count() == 5
    empty = spark.createDataFrame([], "id string, seq bigint")
    assert store.upsert(empty, empty).count() == 0


def test_search_of_zero_vectors(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in vector.search(points, [1.0, 0.0]).collect()]
    assert got == [(2, 1.0), (1, 0.0), (3, 0.0)] and vector.preset("no such").name == "default"
    with pytest.raises(ValueError):
        vector.search_many(points, points.selectExpr("vec_id as query", "embedding as vector"), most_queries=1)


def test_search_of_many_queries_goes_in_blocks(spark):
    points = spark.createDataFrame([(k, [float(k % 7), float(k % 11), 1.0]) for k in range(60)], "vec_id long, embedding array<float>")
    wanted = points.selectExpr("vec_id as query", "embedding as vector")
    rows = lambda **more: sorted(map(tuple, vector.search_many(points, wanted, limit=3, **more).collect()))
    assert rows(block=17) == rows() and len(rows(block=17)) == 180
    many = spark.range(10_001).selectExpr("id as query", "array(1f, 0f, 1f) as vector")
    assert vector.search_many(points.limit(2), many, limit=1).count() == 10_001


def test_ivf_recall(spark):
    points = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    wanted = points.filter("vec_id % 50 = 0").selectExpr("vec_id as query", "embedding as vector")
    pairs = lambda df: {(r["query"], r["vec_id"]) for r in df.collect()}
    exact = pairs(vector.search_many(points, wanted, limit=5))
    found = pairs(catalog.QUERIES["ivf_search"](spark, "/root/testdata/sf0.01"))
    assert len(exact & found) >= 0.9 * len(exact)


def test_files(spark, tmp_path):
    from brackwater.sources import files

    (tmp_path / "src" / ".svn").mkdir(parents=True)
    (tmp_path / "src" / "build").mkdir()
    (tmp_path / "src" / "A.java").write_text("class A {}")
    (tmp_path / "src" / "B.java").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / ".svn" / "C.java").write_text("class C {}")
    (tmp_path / "src" / "build" / "D.java").write_text("class D {}")
    got = {r["path"]: r["source"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/A.java": "class A {}", "src/B.java": None, "src/build/D.java": "class D {}"}
    assert files.scan(spark, str(tmp_path), patterns=["*.java", "!A.java"]).count() == 1
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, hash string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3")], "path string, hash string")
    assert {(r["path"], r["change"]) for r in files.diff(a, b).collect()} == {("y", "modified"), ("z", "deleted"), ("w", "new")} and files.diff(a, a).count() == 0


def test_method_bodies_are_balanced(spark, sf_dir):
    """What lies between the first brace behind a method's head and the one that closes it, found by counting."""

    def body(source):
        at = source.find("{", max(source.find("public int total"), 0))
        depth = 0
        for k in range(at, len(source)) if at >= 0 else ():
            depth += (source[k] == "{") - (source[k] == "}")
            if not depth:
                return source[at : k + 1]
        return ""

    rows = catalog.QUERIES["method_body"](spark, sf_dir).collect()
    assert len({r["body"] for r in rows}) > 3 and all(r["body"] == body(r["source"]) for r in rows)


def test_complexity_neighbours_by_pairs(spark):
    rows = [(f"m{k}", f"c{k % 3}", k * 7 % 12 + 1) for k in range(60)]
    got = {r["id"]: r["n"] for r in store.complexity_neighbours(spark.createDataFrame(rows, "id string, class_id string, complexity int")).collect()}
    span = lambda c: (1, 3) if c <= 2 else (c - 1, c + 2) if c <= 5 else (c - 2, c + 3)
    want = {i: sum(j != i and d == e and span(c)[0] <= x <= span(c)[1] for j, e, x in rows) for i, d, c in rows}
    assert got == {i: n for i, n in want.items() if n}


def test_streams_and_trees_and_positions(spark, sf_dir):
    from brackwater.operators import presentation
    from brackwater.sources import files

    paths = [("a/x.java", "1"), ("a/b/y.java", "2"), ("a/b/z.java", "3"), ("w.txt", "4")]
    import hashlib

    sha = lambda *kids: hashlib.sha256("".join(h + n for n, h in sorted(kids)).encode()).hexdigest()
    b = sha(("y.java", "2"), ("z.java", "3"))
    a = sha(("x.java", "1"), ("b", b))
    got = {r["path"]: r["hash"] for r in files.tree_hashes(spark.createDataFrame(paths, "path string, hash string")).collect()}
    assert got == dict(paths) | {"a/b": b, "a": a, "": sha(("a", a), ("w.txt", "4"))}
    rows = spark.range(500).selectExpr("(id * 7919) % 1009 as k").repartition(7)
    places = {r["k"]: r["_pos"] for r in presentation.numbered(rows, "k").collect()}
    assert places == {k: n + 1 for n, k in enumerate(sorted(r["k"] for r in rows.collect()))}
    with pytest.raises(ValueError):
        presentation.zipped(rows, rows.limit(3), "k")


def test_stored_index(spark, tmp_path):
    """Recall against brute force, folders that are read, the full-scan switch, and a cell that holds a third of all points."""
    import random

    from brackwater.operators import vector_index as vi
    from brackwater.session import table

    sf = "/root/testdata/sf0.1"
    pairs = lambda df: {(r["query"], r["vec_id"]) for r in df.collect()}
    p = table(spark, sf, "embeddings")
    wanted = p.filter("vec_id % 50 = 0").selectExpr("vec_id as query", "embedding as vector")
    exact = pairs(vector.search_many(p, wanted, limit=5))
    assert len(exact & pairs(catalog.QUERIES["stored_index_search"](spark, sf))) >= 0.9 * len(exact)
    index = vi.build(p, str(tmp_path / "index"), cells=20, parts=16)
    few = vi.search(index, wanted.limit(1), probes=2, limit=5)
    assert {r["query"] for r in few.collect()} == {wanted.limit(1).first()["query"]}
    every = vi.search(vi.opened(spark, str(tmp_path / "index")), wanted, probes=20, limit=5, candidates=2000)
    assert pairs(every) == exact
    assert pairs(vi.search_as(index, p, wanted, vector.preset("large_scale"), limit=5)) == exact
    codes = index.table("codes", "code binary").filter("cell in (3, 4)")
    assert "PartitionFilters: [cell" in codes._jdf.queryExecution().toString() and index.count == p.count() == index.table("vectors", "v array<double>").count()
    rng = random.Random(2)
    hot = [1.0] + [0.0] * 15
    rows = [(k, hot) for k in range(100)] + [(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(100, 300)] + [(300, None), (301, []), (302, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = vi.build(df, str(tmp_path / "small"), cells=8, parts=4)
    got = vi.search(small, spark.createDataFrame([(0, hot), (7, None)], "query long, vector array<double>"), probes=8, limit=3, candidates=300)
    assert [(r["query"], r["vec_id"]) for r in got.orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]
    empty = vi.build(df.limit(0), str(tmp_path / "empty"), parts=4)
    assert vi.search(empty, spark.createDataFrame([(0, [0.0] * 4)], "query long, vector array<double>")).collect() == []


def test_edges_in_buckets(spark, small):
    """Grouped and joined by node without a shuffle; walks on them are those of fresh edges; a node with most edges changes nothing."""
    from pyspark.sql import functions as F

    rels = small.unionByName(spark.range(500).select(F.lit("hub").alias("source_id"), F.concat(F.lit("m"), (F.col("id") % 5).cast("string")).alias("target_id"), F.lit("CALLS").alias("rel_type")))
    out, into = graph.stored(rels, buckets=4)
    ends = lambda df, name: df.groupBy("node").agg(F.sum("n").alias(name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ends(into, "a").join(ends(out.filter("forward"), "b"), "node")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in out.filter("node = 'hub'")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    plan = [graph.Strategy("s", 6, 4), graph.Strategy("f", 3, 3, forward=True)]
    walks = lambda **more: sorted((r["strategy"], r["walk"], r["path"]) for r in graph.walk(start="hub", strategies=plan, **more).collect())
    assert walks(edges=out, on_disk=True) == walks(edges=graph.ways(rels))
    r = [tuple(x) for x in rels.collect()]
    want = {}
    for a, b, t in r:
        for c, _, u in r:
            if b == c:
                want[t, u] = want.get((t, u), 0) + 1
    assert {(x["first"], x["second"]): x["n"] for x in graph.two_steps(out, into).collect()} == want


def _method(k, **more):
    base = {"id": f"m{k}", "name": f"name{k}", "class_id": "c", "package": "p", "source_code": "return x;", "annotations": [], "modifiers": [], "parameter_types": [], "complexity": 2, "return_type": "void", "class_name": "C"}
    return base | more


METHOD = "id string, name string, class_id string, package string, source_code string, annotations array<string>, modifiers array<string>, parameter_types array<string>, complexity int, return_type string, class_name string"


def test_all_branches_of_adaptive_walks(spark, small):
    entities = spark.createDataFrame([(f"m{k}", "Method", f"name{k}") for k in range(5)] + [("c", "Class", "C")], "id string, type string, name string")
    gui = spark.createDataFrame([_method(k, source_code="JFrame f = new JFrame();") for k in range(5)], METHOD)
    large = spark.createDataFrame([_method(k) for k in range(40)], METHOD)
    guide = spark.createDataFrame([("m3", 0.8)], "node string, score double")
    run = lambda m, **more: graph.adaptive_walk(small, m, entities, "m0", steps=4, walks=3, **more).collect()
    standard, enterprise, hybrid, none = run(gui), run(large), run(gui, guidance=guide), run(gui.limit(0))
    assert {(r["project_type"], r["strategies_used"]) for r in standard} == {("gui_application", 4)}
    assert {(r["project_type"], r["strategies_used"]) for r in enterprise} == {("large_enterprise", 5)}
    assert {(r["project_type"], r["strategies_used"]) for r in hybrid} == {("gui_application", 3)}
    assert {(r["project_type"], r["strategies_used"]) for r in none} == {("unknown", 4)}
    plan = graph.hybrid(4, 3)
    top = graph.with_guidance(graph.most_visited(graph.visits(graph.walk(graph.ways(small), "m0", plan, guidance=guide)), entities, "m0"), guide, plan)
    for r in graph.contributions(top).collect():
        shares = {"vector_guided": 0.7, "markov_heavy": 0.3, "balanced_hybrid": 0.5}
        assert all(abs(c["score"] - c["visit_prob"] - 0.3 * c["guidance_score"]) < 1e-12 and c["guidance_score"] == (0.8 * shares[c["strategy"]] if r["node"] == "m3" else 0.0) for c in r["contributions"])
        assert abs(r["score"] - sum(c["score"] for c in r["contributions"])) < 1e-9
    changes = {r["rel_type"]: tuple(r)[1:] for r in graph.weight_changes(spark, "gui_application", 2.5, 0).collect()}
    assert changes["CALLS"] == (1.0, 1.56, 0.56) and changes["USES"] == (0.8, 1.43, 0.63)


def test_fallbacks_when_walks_meet_too_little(spark, small):
    entities = spark.createDataFrame([(f"m{k}", "Method", f"name{k}") for k in range(5)] + [("x", "Method", "x")], "id string, type string, name string")
    methods = spark.createDataFrame([_method(k) for k in range(8)], METHOD)
    me = methods.first()
    edges = graph.ways(small.unionByName(spark.createDataFrame([("x", "m0", "CALLS")], small.schema)).filter("source_id = 'x' or source_id = 'm0'"))
    few = graph.visits(graph.walk(edges, "lonely", [graph.Strategy("s", 5, 3)]))
    top = graph.most_visited(few, entities, "lonely")
    assert graph.needs_fallback(few, top)
    out = graph.expanded(few, top, methods, me).collect()
    assert {r["strategy"] for r in out} <= set(graph.FALLBACKS) and "m0" not in {r["id"] for r in out} and len(out) > 0
    many = graph.visits(graph.walk(edges, "m0", [graph.Strategy("s", 5, 30)]))
    top = graph.most_visited(many, entities, "m0")
    assert not graph.needs_fallback(many, top) and {r["strategy"] for r in graph.expanded(many, top, methods, me).collect()} == {"walk"}


def test_pages_by_cursor(spark, tmp_path):
    """The pages together are the table; each reads its own files and columns; a key of a third of all rows is one page's."""
    from brackwater.sources.paging import PagedTable

    rows = [(k, f"v{k}") for k in range(300)] + [(77, f"again{k}") for k in range(150)] + [(None, "lost")]
    df = spark.createDataFrame(rows, "id long, vector string")
    held = PagedTable.write(df.repartition(5), str(tmp_path / "paged"), "id", rows_per_file=40)
    pages = [[tuple(r) for r in p.collect()] for p in held.scroll(50)]
    assert sorted(r for p in pages for r in p) == sorted(r for r in rows if r[0] is not None)
    assert all(len(p) == (50 if not any(r[0] == 77 for r in p[-1:]) else len(p)) for p in pages[:-1])
    assert all(a[-1][0] < b[0][0] for a, b in zip(pages, pages[1:]))
    assert len(held.files(200, 20)) <= 3 and held.page(299)[1] is None and held.page(299)[0].count() == 0
    page, cursor = held.page(10, 5, without=("vector",))
    assert page.columns == ["id"] and [r["id"] for r in page.collect()] == [11, 12, 13, 14, 15] and cursor == 15
    empty = PagedTable.write(df.limit(0), str(tmp_path / "none"), "id")
    assert [p.count() for p in empty.scroll(10)] == [0]


def test_any_number_of_patterns(spark):
    """5,000 patterns in one and in many blocks against running each on each text; patterns without a literal, and literals inside groups and repeats."""
    import re

    from brackwater.functions import patterns as P

    assert [P.literal_of(x) for x in (r"\.save\(", r"new\s+[A-Z]\w*\(", r"(?:abc)+de", r"a|bcd", r"x(yz)?w", r"[0-9]+", r"^Foo$", r"(ab(cd))ef")] == [".save(", "new", "abc", "", "x", "", "foo", "abcdef"]
    table = [("c", "high", rf"word{k}\(", k % 2 == 0) for k in range(5000)] + [("d", "medium", r"\d{3,}", False), ("d", "medium", r"(?:get|set)[A-Z]\w+", False), ("e", "high", r"Repo\w*\.(?:save)+\(", True)]
    texts = [(k, f"Word{k * 7}(x); word{k * 3}( word{k * 3}( getName() repository.save(1234)") for k in range(60)] + [(60, None), (61, ""), (62, "nothing here")]
    want = sorted((i, p, len(re.findall(p, t, re.I if any_case else 0))) for i, t in texts if t for _, _, p, any_case in table if re.search(p, t, re.I if any_case else 0))
    df = spark.createDataFrame(texts, "id long, source string")
    dimension = spark.createDataFrame(table, "category string, criticality string, pattern string, any_case boolean")
    for block in (1500, 50_000):
        assert sorted((r["id"], r["pattern"], r["matches"]) for r in P.matching(df, dimension, block=block).collect()) == want
    assert P.matching(df, dimension.limit(0)).collect() == []
