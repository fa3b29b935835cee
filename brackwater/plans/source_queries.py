"""Queries over code files, reports, logs and caches made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import java
from ..operators import indexing
from ..operators.presentation import signature
from ..session import table
from ..sources import reports
from .graph_model import GRAPH_SQL, classes
from .registry import query

G = f"WITH {GRAPH_SQL} "
#: Customers by a block of keys, so that files stay small however many there are.
BLOCK = 1000


def code_files(spark, sf):
    """A Java file for each nation and block of keys: fields for its suppliers, methods of three shapes for its customers."""
    c = classes(spark, sf)
    key, n = F.col("c_custkey"), table(spark, sf, "customer").count()
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    plain = text("  @Override\n  public int m", key, "(int a, List<String> b) throws Exception {\n    // no { here\n    if (a > 0 && b != null) { return m", (key * 3) % n, "(a, b); }\n    String s = \"}\"; return other(s);\n  }\n")
    loops = text("  private static void m", key, "() {\n    for (int i = 0; i < 3; i++) { while (go()) { step(i); } }\n    switch (kind()) { case 1: break; }\n  }\n")
    open_ = text("  abstract Map<String, Integer> m", key, "(Map<String, Integer> x);\n")
    m = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.floor(key / BLOCK).alias("block"), F.when(key % 3 == 0, plain).when(key % 3 == 1, loops).otherwise(open_).alias("t"))
    m = m.groupBy("n_nationkey", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "t"))), lambda x: x["t"]), "").alias("methods"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"), F.floor(F.col("s_suppkey") / BLOCK).alias("block"))
    s = s.groupBy("n_nationkey", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit("  private final Store f"), k.cast("string"), F.lit(" = new Store(1);\n"))), "").alias("fields"))
    c = m.join(c, "n_nationkey").join(s, ["n_nationkey", "block"], "left")
    name = F.concat("class_name", F.lit("_b"), F.col("block").cast("string"))
    parent = text(" extends NATION_", (F.col("n_nationkey") + 1) % 30, "_b", F.col("block"))
    source = F.concat(F.lit("package "), F.col("package"), F.lit(";\nimport java.util.List;\npublic abstract class "), name, parent, F.lit(" implements Runnable, Shop {\n"), F.coalesce("fields", F.lit("")), "methods", F.lit("}\nclass Extra"), F.col("n_nationkey").cast("string"), F.lit(" { int x; }\n"))
    return c.select(F.concat("package", F.lit("/"), name, F.lit(".java")).alias("path"), source.alias("source"))


FILES_SQL = f"""{G}, files AS (SELECT c.*, block, class_name || '_b' || block AS name, n_methods, coalesce(n_fields, 0) AS n_fields FROM (SELECT c_nationkey, c_custkey // {BLOCK} AS block, count(*) AS n_methods FROM customer GROUP BY 1, 2) JOIN classes c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, s_suppkey // {BLOCK} AS s_block, count(*) AS n_fields FROM supplier GROUP BY 1, 2) ON s_nationkey = n_nationkey AND s_block = block) """


@query(FILES_SQL + "SELECT package || '/' || name || '.java' AS path, name, 'NATION_' || ((n_nationkey + 1) % 30) || '_b' || block AS extends, 'Runnable,Shop' AS implements, 'java.util.List' AS imports, CAST(n_methods AS INTEGER) AS methods, CAST(n_fields AS INTEGER) AS fields FROM files")
def java_parse(spark, sf):
    return java.parsed(code_files(spark, sf)).select("path", "name", "extends", F.array_join("implements", ",").alias("implements"), F.array_join("imports", ",").alias("imports"), F.size("methods").alias("methods"), F.size("fields").alias("fields"))


@query("""SELECT 'm' || c_custkey AS name, CAST([3, 4, 0][1 + c_custkey % 3] AS INTEGER) AS complexity, CAST([6, 4, 1][1 + c_custkey % 3] AS INTEGER) AS loc, CASE c_custkey % 3 WHEN 0 THEN 'm' || ((c_custkey * 3) % (SELECT count(*) FROM customer)) || ',other' WHEN 1 THEN 'go,step,kind' ELSE '' END AS calls, ['Override', '', ''][1 + c_custkey % 3] AS annotations,
['public int m' || c_custkey || '(int a, List<String> b)', 'private static void m' || c_custkey || '()', 'abstract Map<String, Integer> m' || c_custkey || '(Map<String, Integer> x)'][1 + c_custkey % 3] AS signature FROM customer""")
def java_methods(spark, sf):
    m = java.parsed(code_files(spark, sf)).select(F.explode("methods").alias("m"))
    return m.select("m.name", "m.complexity", "m.loc", F.array_join("m.calls", ",").alias("calls"), F.array_join("m.annotations", ",").alias("annotations"), signature(F.col("m")).alias("signature"))


# Statements, and the points that the kinds of their syntax nodes give: a for over a collection and ? : have none.
BODIES = (("if (a) { b(); } else if (c) { d(); }", 2), ("for (int x : xs) { f(x); }", 0), ("for (int i = 0; i < n; i++) { f(i); }", 1), ("for (Map.Entry<String, List<Integer>> e : m.get(k(1, 2)).entries()) { g(); }", 0), ("do { f(); } while (a > 0 && b);", 2), ("while (x) { y(); }", 1), ("int y = b ? 1 : 2;", 0), ("switch (k) { case 1: break; case 2: return; default: }", 1), ("try { f(); } catch (A | B e) { g(); } finally { h(); }", 1), ('String s = "if (x) && for (;;)"; // while || do', 0), ("for (;;) { if (a || b) break; }", 3), ("run(() -> { if (a) { return; } });", 1))


@query(f"SELECT doc_id AS id, CAST(1 + {' + '.join(f'CASE WHEN (((doc_id + 1) * 2654435761) % 1048576 >> {k}) & 1 = 1 THEN {n} ELSE 0 END' for k, (_, n) in enumerate(BODIES))} AS INTEGER) AS complexity FROM documents")
def syntax_complexity(spark, sf):
    bits = ((F.col("doc_id") + 1) * 2_654_435_761) % 1_048_576
    body = F.concat_ws("\n", *[F.when(F.shiftright(bits, k).bitwiseAND(F.lit(1)) == 1, F.lit(b)) for k, (b, _) in enumerate(BODIES)])
    source = F.concat(F.lit("class A {\n  void m() {\n"), body, F.lit("\n  }\n}\n"))
    m = java.parsed(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), source.alias("source")))
    return m.select(F.col("path").cast("long").alias("id"), F.col("methods")[0]["complexity"].alias("complexity"))


@query(FILES_SQL + ", f AS (SELECT 's_' AS x, s_suppkey, s_nationkey FROM supplier) SELECT 'f' || s_suppkey AS name, 'Store' AS type, 'private,final' AS modifiers, 'new Store(1)' AS initial_value FROM f JOIN files ON n_nationkey = s_nationkey AND block = s_suppkey // 1000")
def java_fields(spark, sf):
    f = java.parsed(code_files(spark, sf)).select(F.explode("fields").alias("f"))
    return f.select("f.name", "f.type", F.array_join("f.modifiers", ",").alias("modifiers"), "f.initial_value")


@query(FILES_SQL + "SELECT path, unnest([name, 'Extra' || n_nationkey]) AS name FROM (SELECT *, package || '/' || name || '.java' AS path FROM files)")
def class_split(spark, sf):
    return java.parsed(code_files(spark, sf), first_only=False).select("path", "name")


@query(FILES_SQL + "SELECT 'Class' AS type, count(*) AS n FROM files UNION ALL SELECT 'Package', count(DISTINCT package) FROM files UNION ALL SELECT 'Method', CAST(sum(n_methods) AS BIGINT) FROM files UNION ALL SELECT 'Field', CAST(sum(n_fields) AS BIGINT) FROM files")
def index_entities(spark, sf):
    return indexing.entities(java.parsed(code_files(spark, sf))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(FILES_SQL + "SELECT 'CONTAINS' AS rel_type, CAST(sum(1 + n_methods + n_fields) AS BIGINT) AS n FROM files UNION ALL SELECT 'EXTENDS', count(*) FROM files UNION ALL SELECT 'IMPLEMENTS', 2 * count(*) FROM files UNION ALL SELECT 'IMPORTS', count(*) FROM files UNION ALL SELECT 'CALLS', count(*) FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey * 3) % (SELECT count(*) FROM customer) IN (SELECT c_custkey FROM customer)")
def index_relationships(spark, sf):
    return indexing.relationships(java.parsed(code_files(spark, sf))).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT doc_id, ['LINE', 'BRANCH', 'METHOD'][CAST(1 + (doc_id + i) % 3 AS INTEGER)] AS type, (doc_id * (i + 1)) % 37 AS covered, (doc_id * (i + 2)) % 11 AS missed, i FROM documents, range(5) AS r(i)) SELECT doc_id AS path, type, round(max_by(100.0 * covered / (covered + missed), i), 4) AS percent FROM c WHERE covered + missed > 0 GROUP BY 1, 2")
def coverage_report(spark, sf):
    i = F.col("doc_id")
    tag = lambda k: F.concat(F.lit('<counter type="'), F.element_at(F.array(*[F.lit(x) for x in ("LINE", "BRANCH", "METHOD")]), (1 + (i + k) % 3).cast("int")), F.lit('" missed="'), ((i * (k + 2)) % 11).cast("string"), F.lit('" covered="'), ((i * (k + 1)) % 37).cast("string"), F.lit('"/>'))
    xml = F.concat(F.lit('<?xml version="1.0"?><report name="r">'), *[tag(k) for k in range(5)], F.lit("</report>"))
    return reports.coverage(table(spark, sf, "documents").select(i.alias("path"), xml.alias("xml"))).select("path", "type", F.round("percent", 4).alias("percent"))


@query("WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'INFO Indexing completed in ' || (event_id % 50) || '.5s' ELSE 'INFO other' END AS value FROM events), s AS (SELECT CAST(regexp_extract(value, '([0-9.]+)s$', 1) AS DOUBLE) AS s FROM l WHERE contains(value, 'Indexing completed')) SELECT count(*) AS sessions, round(avg(s), 6) AS mean, min(s) AS least, max(s) AS most FROM s")
def log_sessions(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("INFO Indexing completed in "), (F.col("event_id") % 50).cast("string"), F.lit(".5s"))).otherwise("INFO other")
    return reports.sessions(table(spark, sf, "events").select(line.alias("value"))).withColumn("mean", F.round("mean", 6))


@query("WITH cache AS (SELECT 'embedding:' || user_id AS key, max_by(value, event_id) AS value, max_by(ts, event_id) AS expires_at FROM events GROUP BY 1) SELECT key, round(value, 6) AS value FROM (SELECT DISTINCT 'embedding:' || c_custkey AS key FROM customer) LEFT JOIN (SELECT key, value FROM cache WHERE expires_at > TIMESTAMP '2024-01-29 00:00:00') USING (key)")
def cache_lookup_ttl(spark, sf):
    key = lambda c: F.concat(F.lit("embedding:"), F.col(c).cast("string"))
    cache = table(spark, sf, "events").groupBy(key("user_id").alias("key")).agg(F.max_by("value", "event_id").alias("value"), F.max_by("ts", "event_id").alias("expires_at"))
    wanted = table(spark, sf, "customer").select(key("c_custkey").alias("key")).distinct()
    return reports.get(cache, wanted, F.expr("timestamp_ntz'2024-01-29 00:00:00'")).select("key", F.round("value", 6).alias("value"))


@query("SELECT DISTINCT 'embedding:' || user_id AS key FROM events WHERE ('embedding:' || user_id) LIKE 'embedding:1%'")
def cache_keys_glob(spark, sf):
    keys = table(spark, sf, "events").select(F.concat(F.lit("embedding:"), F.col("user_id").cast("string")).alias("key")).distinct()
    return reports.keys_like(keys, "embedding:1*")


# Of each agent calls = hour x a + hour % b, tokens = hour x c + hour % d, latency = e + (hour % f) x g.
SERIES = (("IndexerAgent", 2, 3, 500, 100, 1.2, 5, 0.1), ("ResearcherAgent", 1, 2, 300, 50, 0.8, 3, 0.1), ("GeneratorAgent", 3, 4, 800, 200, 2.5, 7, 0.2), ("CriticAgent", 1, 2, 400, 80, 1.5, 4, 0.15))


@query("SELECT * FROM (VALUES ('IndexerAgent', CAST(576 AS BIGINT), CAST(138276 AS BIGINT), 0.2766::DOUBLE, 1.39::DOUBLE), ('ResearcherAgent', 288, 83076, 0.1662, 0.90), ('GeneratorAgent', 864, 221076, 0.4422, 3.05), ('CriticAgent', 288, 110676, 0.2214, 1.72)) AS t(agent, calls, tokens, cost, avg_latency)")
def synthetic_series_golden(spark, sf):
    rows = spark.createDataFrame(SERIES, "agent string, a int, b int, c int, d int, e double, f int, g double").withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    tokens = F.col("h") * F.col("c") + F.col("h") % F.col("d")
    rows = rows.select("agent", (F.col("h") * F.col("a") + F.col("h") % F.col("b")).cast("bigint").alias("calls"), tokens.cast("bigint").alias("tokens"), F.round(tokens * F.lit(2e-6), 6).alias("cost"), (F.col("e") + (F.col("h") % F.col("f")) * F.col("g")).alias("latency"))
    return rows.groupBy("agent").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.bround(F.round(F.avg("latency"), 6), 2).alias("avg_latency"))


@query("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events)")
def streaming_distinct(spark, sf):
    from ..streaming.windows import run_to_table, stream

    return run_to_table(stream(spark, f"{sf}/events.parquet").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query()
def streaming_ttl_dedupe(spark, sf):
    from ..streaming.windows import run_to_table, stream, without_repeats

    rows = stream(spark, f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return run_to_table(without_repeats(rows, ["user_id", "event_type"], "ts")).select("user_id", "event_type")
