"""Display, routing and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code_text as C
from ..operators import presentation as P
from ..operators.vector import PRESETS, for_collection, preset, search
from ..session import table
from .graph_model import GRAPH_SQL, entities, methods
from .registry import query
from .texts import S, sources

G = f"WITH {GRAPH_SQL} "


@query("SELECT vec_id, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS colour FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS s FROM embeddings)")
def score_colour(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", P.colour((F.col("vec_id") % 100) / 100).alias("colour"))


@query("SELECT doc_id, CASE WHEN doc_id % 101 >= 90 THEN 'A' WHEN doc_id % 101 >= 75 THEN 'B' WHEN doc_id % 101 >= 60 THEN 'C' ELSE 'D' END AS tier FROM documents")
def quality_tier(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.tier(F.col("doc_id") % 101).alias("tier"))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 100")
def log_tail(spark, sf):
    return P.tail(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 100)


@query("SELECT p_partkey, 'Issues: ' || p_brand || '; ' || p_type || '. Suggestions: ' || p_name AS feedback FROM part")
def improvement_feedback(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", P.feedback(F.array("p_brand", "p_type"), F.array("p_name")).alias("feedback"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'class X' || doc_id || ' {}' ELSE 'plain ' || doc_id END AS code FROM documents")
def code_block_extract(spark, sf):
    key = F.col("doc_id").cast("string")
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here:\n```java\nclass X"), key, F.lit(" {}\n```\nDone."))).otherwise(F.concat(F.lit(" plain "), key, F.lit(" ")))
    return table(spark, sf, "documents").select("doc_id", P.code_block(answer).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'int,' || c_mktsegment || '<T>' END AS types FROM customer")
def signature_parameter_types(spark, sf):
    signature = F.when(F.col("c_custkey") % 3 == 0, "void run()").otherwise(F.concat(F.lit("int run(int a, "), "c_mktsegment", F.lit("<T> b)")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(P.parameter_types(signature), ",").alias("types"))


@query("SELECT analysis, n, round(100.0 * n / sum(n) OVER (), 4) AS percent FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'fallback' WHEN event_id % 2 = 0 THEN 'llm' ELSE 'regex' END AS analysis, count(*) AS n FROM events GROUP BY 1)")
def analysis_mix(spark, sf):
    kind = F.when(F.col("event_id") % 7 == 0, "fallback").when(F.col("event_id") % 2 == 0, "llm").otherwise("regex")
    n = table(spark, sf, "events").groupBy(kind.alias("analysis")).agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf, "events").count()
    return n.withColumn("percent", F.round(100 * F.col("n") / total, 4))


@query("SELECT event_type AS op, count(*) AS operations, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean, round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY 1")
def client_stats(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("op"))
    return e.agg(F.count(F.lit(1)).alias("operations"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.try_divide(F.count(F.lit(1)), F.sum("value")), 6).alias("per_second"))


@query(G + "SELECT project_id, count(DISTINCT class_id) AS classes, count(*) AS methods, count(DISTINCT package) AS packages FROM methods GROUP BY 1")
def index_counts(spark, sf):
    return methods(spark, sf).groupBy("project_id").agg(F.countDistinct("class_id").alias("classes"), F.count(F.lit(1)).alias("methods"), F.countDistinct("package").alias("packages"))


@query(G + "SELECT type, array_to_string(list_sort(list(name))[1:5], ',') AS names, count(*) AS n FROM entities GROUP BY 1")
def context_by_type(spark, sf):
    e = entities(spark, sf)
    names = e.select("type", "name")
    from ..operators.store import top_of

    five = top_of(names, ["type"], ["name"], 5).groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return five.join(e.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type")


@query("SELECT p_partkey, a.k AS key, a.v AS value FROM (SELECT p_partkey, unnest([{'k': 'brand', 'v': p_type}, {'k': 'size', 'v': p_size::VARCHAR}, {'k': 'name', 'v': p_name}]) AS a FROM part)")
def properties_merge(spark, sf):
    left = F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    right = F.create_map(F.lit("brand"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.explode(P.merged(left, right)).alias("key", "value"))


@query("SELECT r_regionkey, r_name, n_name FROM region JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation WHERE n_nationkey < (SELECT count(*) FROM region)) ON i = r_regionkey")
def zip_by_position(spark, sf):
    left = table(spark, sf, "region").select("r_regionkey", "r_name")
    right = table(spark, sf, "nation").filter(F.col("n_nationkey") < left.count()).select(F.col("n_nationkey").alias("r_regionkey"), "n_name")
    return P.zipped(left, right, "r_regionkey")


@query("SELECT user_id, sha256('embedding:model:' || user_id) AS text_key, md5('search|' || user_id) AS cache_key FROM (SELECT DISTINCT user_id FROM events)")
def cache_keys(spark, sf):
    key = F.col("user_id").cast("string")
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", F.sha2(F.concat(F.lit("embedding:model:"), key), 256).alias("text_key"), F.md5(F.concat(F.lit("search|"), key)).alias("cache_key"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS seconds, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def timestamps_iso(spark, sf):
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(ts).alias("seconds"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query(
    """WITH p AS (SELECT * FROM (VALUES ('default', 10, CAST(0.7 AS DOUBLE), 10000), ('high_quality', 20, 0.8, 5000), ('fast_indexing', 10, 0.6, 10000), ('memory_efficient', 10, NULL, 10000), ('large_scale', 50, NULL, 100000),
('java_methods', 20, 0.6, 5000), ('java_classes', 10, 0.7, 10000), ('java_documentation', 15, 0.5, 10000), ('no such', 10, 0.7, 10000), ('changed', 5, 0.2, 10000)) AS t(name, search_limit, threshold, full_scan_threshold)),
s AS (SELECT list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)) AS score FROM embeddings)
SELECT name, search_limit, threshold, full_scan_threshold, least(count(*) FILTER (WHERE threshold IS NULL OR score >= threshold), search_limit) AS found FROM p, s GROUP BY name, search_limit, threshold, full_scan_threshold"""
)
def collection_presets(spark, sf):
    """Each preset, and how many points a search with its limit and threshold finds."""
    p = table(spark, sf, "embeddings")
    wanted = [float(x) for x in p.filter("vec_id = 3").first()["embedding"]]
    sets = [(n, for_collection(n) if n.startswith("java_") else preset(n)) for n in (*PRESETS, "no such")] + [("changed", preset("default").having(limit=5, threshold=0.2))]
    rows = spark.createDataFrame([(n, c.limit, c.threshold, c.full_scan_threshold) for n, c in sets], "name string, search_limit int, threshold double, full_scan_threshold int")
    scored = search(p, wanted, limit=max(c.limit for _, c in sets)).select("score")
    met = rows.join(scored, F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")), "left").groupBy(*rows.columns).agg(F.count("score").alias("n"))  # at most 50 scores
    return met.select(*rows.columns, F.least("n", F.col("search_limit").cast("long")).alias("found"))


@query(f"{S} SELECT id, CAST((length(source) - length(replace(source, '{{', ''))) - (length(source) - length(replace(source, '}}', ''))) AS INTEGER) AS open_braces, (length(source) - length(replace(source, '{{', ''))) = (length(source) - length(replace(source, '}}', ''))) AND length(source) >= 50 AND regexp_matches(rtrim(source, chr(10) || ' '), '\\}}$') AS complete FROM s")
def class_completeness(spark, sf):
    c = F.col("source")
    opened = C.plain_count(c, "{") - C.plain_count(c, "}")
    return sources(spark, sf).select("id", opened.alias("open_braces"), ((opened == 0) & (F.length(c) >= 50) & F.rtrim(c).rlike(r"\}$")).alias("complete"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT a.page_id, a.url FROM pages a WHERE a.page_id % 2 = 0 EXCEPT SELECT page_id, url FROM pages WHERE page_id % 3 = 0")
def pages_except(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.filter("page_id % 2 = 0").exceptAll(p.filter("page_id % 3 = 0"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def conversation_roles(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", "turns", F.array_join(F.transform("r", lambda x: x["role"]), ",").alias("roles"))
