"""Queries over templates, code structure, searches by text, caches, logs and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code_text as C
from ..functions import similarity
from ..operators import metrics as M
from ..operators import presentation as P
from ..operators import store, vector
from ..operators.vector import Collection
from ..session import new_folder, table
from ..sources import files, reports
from .graph_model import GRAPH_SQL, entities, methods
from .metric_queries import E, events
from .registry import query
from .texts import S, sources

G = f"WITH {GRAPH_SQL} "


@query(G + "SELECT id, name FROM entities WHERE type = 'Method' AND name >= 'Customer#000000010' ORDER BY name LIMIT 15")
def parameterised_sql(spark, sf):
    return store.sql(spark, "select id, name from {e} where type = :kind and name >= :least order by name limit :most", {"kind": "Method", "least": "Customer#000000010", "most": 15}, e=entities(spark, sf))


IGNORED_DIRECTORIES = ("src", ".git", "a/node_modules/b", "out", "gen/keep", "gen", ".svn", "build", "dist/target", "x/.env", "env", ".gradle", "venv/lib", ".hg/y")
IGNORED_FILES = ("{}.java", "{}.class", "{}.pyc", ".DS_Store", "{}.java")


@query(
    """WITH p AS (SELECT doc_id AS id, ['src', '.git', 'a/node_modules/b', 'out', 'gen/keep', 'gen', '.svn', 'build', 'dist/target', 'x/.env', 'env', '.gradle', 'venv/lib', '.hg/y'][CAST(1 + doc_id % 14 AS INTEGER)] || '/' || replace(['A{}.java', 'A{}.class', 'A{}.pyc', '.DS_Store', 'A{}.java'][CAST(1 + doc_id % 5 AS INTEGER)], '{}', doc_id::VARCHAR) AS path FROM documents)
SELECT id, path FROM p WHERE NOT list_has_any(string_split(path, '/'), ['.git', '.svn', '.hg', '__pycache__', '.pytest_cache', '.mypy_cache', 'node_modules', 'venv', 'env', '.env', '.idea', '.vscode', '.DS_Store', 'Thumbs.db'])
  AND NOT regexp_matches(path, '[.](pyc|pyo|class)$') AND (NOT starts_with(path, 'gen/') OR starts_with(path, 'gen/keep/')) AND NOT starts_with(path, 'out/')"""
)
def ignored_paths(spark, sf):
    k = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + k % len(xs)).cast("int"))
    path = F.concat(pick(IGNORED_DIRECTORIES), F.lit("/"), F.replace(pick(IGNORED_FILES), F.lit("{}"), F.concat(F.lit("A"), k.cast("string"))))
    rows = table(spark, sf, "documents").select(k.alias("id"), path.alias("path"))
    return rows.filter(~files.ignored(F.col("path")) & ~files.ignored_by(F.col("path"), ["# built", "/gen/**", "/out/", "!/gen/keep/**"]))


@query("SELECT source AS directory, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def file_counts(spark, sf):
    path = F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".java").otherwise(".txt"))
    return files.file_count(table(spark, sf, "documents").filter("source is not null").select(path.alias("path")), "*.java")


@query(f"{S} SELECT id, replace(replace(replace(source, '<% out.print(user) %>', 'GROOVY_EXPRESSION_0'), '${{greeting}}', 'TEMPLATE_VAR_0'), '${{name}}', 'TEMPLATE_VAR_1') AS value FROM s")
def template_placeholders(spark, sf):
    return sources(spark, sf).select("id", C.placeholders(F.col("source")).alias("value"))


@query(f"{S} SELECT id, array_to_string(list_filter(['greeting', 'name', 'user', 'price', 'kind'], lambda v: contains(source, v)), ',') AS value FROM s")
def template_variables_used(spark, sf):
    return sources(spark, sf).select("id", F.array_join(C.used_variables(F.col("source"), ["greeting", "name", "user", "price", "kind"]), ",").alias("value"))


@query()
def method_body(spark, sf):
    return sources(spark, sf).select("id", "source", C.balanced_body(F.col("source"), "public int total").alias("body"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'com.shop' || (doc_id % 7) END AS package, CASE doc_id % 4 WHEN 0 THEN 'TestClass' WHEN 1 THEN 'Open' || doc_id WHEN 2 THEN 'Plain' || doc_id ELSE 'Second' || doc_id END AS class FROM documents")
def package_and_class(spark, sf):
    k, key = F.col("doc_id"), F.col("doc_id").cast("string")
    head = F.when(k % 3 == 0, "// none\n").otherwise(F.concat(F.lit("package com.shop"), (k % 7).cast("string"), F.lit(" ;\n")))
    body = F.when(k % 4 == 0, "interface X { }").when(k % 4 == 1, F.concat(F.lit("public class Open"), key, F.lit(" { }"))).when(k % 4 == 2, F.concat(F.lit("final class Plain"), key, F.lit(" { }"))).otherwise(F.concat(F.lit("class First { } public class Second"), key, F.lit(" { }")))
    code = F.concat(head, body)
    return table(spark, sf, "documents").select(k.alias("id"), C.package_name(code).alias("package"), C.class_name(code).alias("class"))


BUILT_IN_SQL = ", ".join(f"'{x}'" for x in C.BUILT_IN)


@query(f"{S} SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(source, 'new\\s+(\\w+)\\s*\\(', 1), regexp_extract_all(source, '(\\w+)\\s+\\w+\\s*[,\\)]', 1))), lambda x: x NOT IN ({BUILT_IN_SQL}) AND x <> 'Service')), ',') AS value FROM s")
def class_references(spark, sf):
    return sources(spark, sf).select("id", F.array_join(F.array_sort(C.class_references(F.col("source"), F.lit("Service"))), ",").alias("value"))


WORDS = "({})".format(" + ".join(f"CAST((length(source) - length(replace(source, '{w}', ''))) // {len(w)} AS INTEGER)" for w in ("if", "for", "while", "switch", "catch", "try")) + " + length(replace(source, ')', '')) - length(replace(source, '(', '')) + length(replace(source, '}', '')) - length(replace(source, '{', ''))")


@query(f"{S} SELECT id, CAST({WORDS} AS INTEGER) AS score, CASE WHEN {WORDS} > 20 THEN 'comprehensive' WHEN {WORDS} > 10 THEN 'moderate' ELSE 'minimal' END AS strategy FROM s")
def generator_strategy(spark, sf):
    score = C.generator_score(F.col("source"))
    return sources(spark, sf).select("id", score.cast("int").alias("score"), C.mock_strategy(score, F.lit(0)).alias("strategy"))


@query("SELECT doc_id AS id, concat_ws(',', CASE WHEN l IN ('High', 'Very High') THEN 'branches' END, CASE WHEN doc_id % 3 > 0 THEN 'mocks' END, CASE WHEN doc_id % 6 > 3 THEN 'edge cases' END, CASE WHEN doc_id % 2 = 0 THEN 'performance' END, 'happy path,exceptions,boundaries,messages') AS priorities, concat_ws(',', CASE WHEN l = 'Very High' THEN 'refactor' END, CASE WHEN doc_id % 3 > 0 THEN 'mocking' END, CASE WHEN doc_id % 5 = 0 THEN 'futures' END, CASE WHEN doc_id % 7 = 0 THEN 'cleanup' END) AS considerations, CASE WHEN l IN ('High', 'Very High') THEN 'branch-focused' ELSE 'comprehensive' END AS approach, concat_ws(',', CASE WHEN l IN ('High', 'Very High') THEN 'branches' END, CASE WHEN doc_id % 3 > 0 THEN 'dependencies' END, CASE WHEN doc_id % 6 > 0 THEN 'edge cases' END) AS focus, 'arrange-act-assert' || CASE doc_id % 3 WHEN 0 THEN ',transactions' WHEN 1 THEN ',http' ELSE '' END AS patterns FROM (SELECT doc_id, ['Low', 'Medium', 'High', 'Very High'][CAST(1 + doc_id % 4 AS INTEGER)] AS l FROM documents)")
def test_plan(spark, sf):
    k = F.col("doc_id")
    level = F.element_at(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Very High")]), (1 + k % 4).cast("int"))
    category = F.when(k % 3 == 0, F.array(F.lit("database"))).when(k % 3 == 1, F.array(F.lit("network"))).otherwise(F.array().cast("array<string>"))
    plan = C.test_strategy(level, k % 3, k % 6, category)
    considerations = C.special_considerations(level, k % 3, k % 5 == 0, F.when(k % 7 == 0, "file_operations").otherwise(""))
    rows = table(spark, sf, "documents").select(k.alias("id"), C.test_priorities(level, k % 3, k % 6, F.when(k % 2 == 0, "High Impact").otherwise("Low Impact")).alias("priorities"), considerations.alias("considerations"), plan.alias("p"))
    return rows.select("id", "priorities", "considerations", "p.approach", "p.focus", "p.patterns")


@query("SELECT user_id, kind, value, CASE kind WHEN 'hours' THEN value BETWEEN 1 AND 168 WHEN 'limit' THEN value BETWEEN 1 AND 100 WHEN 'points' THEN value BETWEEN 10 AND 500 ELSE false END AS ok FROM (SELECT DISTINCT user_id, ['hours', 'limit', 'points', 'other'][CAST(1 + user_id % 4 AS INTEGER)] AS kind, user_id % 600 - 5 AS value FROM events)")
def request_checks(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("hours", "limit", "points", "other")]), (1 + F.col("user_id") % 4).cast("int"))
    rows = table(spark, sf, "events").select("user_id").distinct().select("user_id", kind.alias("kind"), (F.col("user_id") % 600 - 5).alias("value"))
    return rows.withColumn("ok", P.valid(F.col("kind"), F.col("value").cast("string")))


@query(f"{E} SELECT agent, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, round(avg(latency), 2) AS avg_latency FROM e GROUP BY 1")
def metrics_json(spark, sf):
    """The summary written as JSON and read again."""
    out = M.summary(events(spark, sf), "agent")
    path = new_folder(spark, "metrics")
    out.write.json(path)
    return spark.read.schema(out.schema).json(path)


@query(f"{E}, t AS (SELECT avg(latency) AS score FROM (SELECT latency FROM e ORDER BY latency DESC, event_id LIMIT 10)) SELECT round(avg(latency), 1) AS latency, round(avg(tokens), 3) AS results, round((SELECT score FROM t), 3) AS top_score, round(avg(CASE WHEN tokens % 3 <> 0 THEN 1.0 ELSE 0.0 END), 3) AS cache_hit, count(*) AS n FROM e")
def rag_summary(spark, sf):
    e = events(spark, sf)
    top = e.orderBy(F.col("latency").desc(), "event_id").limit(10).agg(F.round(F.avg("latency"), 3).alias("top_score"))
    out = e.agg(F.round(F.avg("latency"), 1).alias("latency"), F.round(F.avg("tokens"), 3).alias("results"), F.round(F.avg((F.col("tokens") % 3 != 0).cast("double")), 3).alias("cache_hit"), F.count(F.lit(1)).alias("n"))
    return out.join(F.broadcast(top))  # a row each


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') + 5) // 10 / 100.0 AS elapsed_ms, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') + 5000) // 10000 / 100.0 AS elapsed_s FROM events")
def elapsed_times(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", *M.elapsed(micros))


@query("SELECT vec_id, 36 AS id_length, true AS timely FROM embeddings")
def stamped_points(spark, sf):
    out = store.stamped(table(spark, sf, "embeddings").select("vec_id"))
    return out.select("vec_id", F.length("point_id").alias("id_length"), (F.col("indexed_at") > F.lit("2020-01-01").cast("timestamp")).alias("timely"))


TEXT_SQL = "list_transform(range(1, 17), lambda i: ('0x' || substr(md5({} || '|' || i), 1, 8))::UBIGINT / 4294967296.0)"
TEXTS_SQL = f"SELECT doc_id, list_cosine_similarity({TEXT_SQL.format('text')}, {TEXT_SQL.format(chr(39) + 'add an order' + chr(39))}) AS score FROM documents"


def _text_points(spark, sf):
    return table(spark, sf, "documents").select("doc_id", similarity.hash_embedding(F.col("text"), 16).alias("embedding"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({TEXTS_SQL}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def text_search(spark, sf):
    return vector.search_text(_text_points(spark, sf), "add an order", size=16, limit=10, key="doc_id", places=9).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM ({TEXTS_SQL}) ORDER BY round(score, 9) DESC, doc_id LIMIT 40) WHERE score >= 0.9")
def rag_context(spark, sf):
    return vector.rag_context(_text_points(spark, sf), "add an order", size=16, limit=40, least=0.9, key="doc_id", places=9).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 7")
def configured_search(spark, sf):
    p = table(spark, sf, "embeddings")
    wanted = [float(x) for x in p.filter("vec_id = 3").first()["embedding"]]
    return vector.configured(p, wanted, Collection("methods", size=len(wanted), threshold=0.6), limit=7, threshold=0.2).select("vec_id", F.round("score", 6).alias("score"))


@query("WITH cache AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, CASE WHEN key IS NULL THEN 'miss' ELSE 'hit' END AS found, length(text) AS value, (SELECT count(DISTINCT text) FROM documents) AS cached FROM documents LEFT JOIN cache ON key = sha256(text)")
def cache_read_through(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "text")
    size = lambda t: F.length(t).cast("long")
    cache = docs.filter("doc_id % 4 = 0").dropDuplicates(["key"]).select("key", size(F.col("text")).alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    now = F.lit("2024-01-01").cast("timestamp")
    found, after = reports.read_through(cache, docs, size, now, F.lit("2024-01-02").cast("timestamp"))
    found = found.groupBy("key").agg(F.first("value").alias("value"), F.first("found").alias("found"))
    return docs.select("doc_id", "key").join(found, "key").select("doc_id", "found", "value", F.lit(after.count()).cast("long").alias("cached"))


@query("SELECT count(DISTINCT user_id) FILTER (WHERE NOT starts_with(user_id::VARCHAR, '1')) AS kept FROM events")
def cache_delete(spark, sf):
    cache = table(spark, sf, "events").select(F.concat(F.lit("embedding:"), F.col("user_id").cast("string")).alias("key")).distinct()
    return reports.delete(cache, reports.keys_like(cache, "embedding:1*")).agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT event_type AS level, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 5 <> 0 GROUP BY 1 UNION ALL SELECT NULL, count(*), NULL FROM events WHERE event_id % 5 = 0")
def json_log_lines(spark, sf):
    line = F.when(F.col("event_id") % 5 == 0, "not JSON").otherwise(F.to_json(F.struct(F.col("event_type").alias("level"), "value")))
    return reports.json_lines(table(spark, sf, "events").select(line.alias("value")), "level string, value double").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(G + "SELECT id FROM methods WHERE lower(name) LIKE 'customer#0000000_5'")
def inexact_name(spark, sf):
    """A name as a pattern of LIKE without anything around it."""
    wanted = spark.createDataFrame([(1, "customer#0000000_5", "none")], "query int, method_name string, class_name string")
    m = methods(spark, sf)
    return m.join(F.broadcast(wanted), F.expr("name ilike method_name")).select("id")


@query("SELECT p_partkey, 'Issues: ' || array_to_string(list_transform(range(1, least(p_size % 8, 5) + 1), lambda i: 'i' || i), '; ') || '. Suggestions: ' || array_to_string(list_transform(range(1, least(p_size % 6, 3) + 1), lambda i: 's' || i), '; ') AS feedback FROM part")
def improvement_feedback_many(spark, sf):
    listed = lambda name, n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(name), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", P.feedback(listed("i", F.col("p_size") % 8), listed("s", F.col("p_size") % 6)).alias("feedback"))
