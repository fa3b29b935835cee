"""Relational queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..session import table
from .graph_model import GRAPH_SQL, classes, entities, methods, relationships
from .registry import query

G = f"WITH {GRAPH_SQL} "
SOME_METHOD = "(SELECT id FROM methods WHERE c_custkey = 7)"
PARSED = "id, CAST(json_extract(properties, '$.complexity') AS INTEGER) AS complexity, CAST(json_extract(properties, '$.loc') AS INTEGER) AS loc, json_extract_string(properties, '$.return_type') AS return_type"


def some_method(spark, sf, key: int = 7) -> str:
    return methods(spark, sf).filter(F.col("c_custkey") == key).first()["id"]


@query(G + "SELECT * FROM entities")
def entities_union(spark, sf):
    return entities(spark, sf)


@query(G + "SELECT source_id, target_id, rel_type, count(*) AS n FROM relationships GROUP BY ALL")
def relationships_union(spark, sf):
    return relationships(spark, sf).groupBy("source_id", "target_id", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(G + "SELECT coalesce(type, 'total') AS type, count(*) AS n FROM entities GROUP BY ROLLUP (type)")
def stats_entities_by_type(spark, sf):
    return store.counts_with_total(entities(spark, sf), "type")


@query(G + "SELECT coalesce(rel_type, 'total') AS rel_type, count(*) AS n FROM relationships GROUP BY ROLLUP (rel_type)")
def stats_relationships_by_type(spark, sf):
    return store.counts_with_total(relationships(spark, sf), "rel_type")


@query(G + "SELECT * FROM entities WHERE id = 'class:' || (SELECT r_name || '.' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3)")
def entity_by_id(spark, sf):
    wanted = classes(spark, sf).filter("n_nationkey = 3").first()["class_id"]
    return store.by_id(entities(spark, sf), wanted)


@query(G + "SELECT id, name, package FROM entities WHERE type = 'Method' AND project_id = 'BUILDING'")
def entities_by_type_project(spark, sf):
    return store.by_type(entities(spark, sf), "Method", "BUILDING").select("id", "name", "package")


@query(G + "SELECT id, seq FROM entities WHERE type = 'Method' ORDER BY seq, id LIMIT 25")
def all_methods_limited(spark, sf):
    return store.by_type(entities(spark, sf), "Method", limit=25).select("id", "seq")


@query(G + f"SELECT source_id, target_id, rel_type FROM relationships WHERE source_id = {SOME_METHOD} AND rel_type = 'USES'")
def relationships_filter(spark, sf):
    return store.filter_relationships(relationships(spark, sf), source_id=some_method(spark, sf), rel_type="USES").select("source_id", "target_id", "rel_type")


def _incident(name: str, direction: str, where: str, strict: bool = False):
    @query(G + f" SELECT source_id, target_id, rel_type FROM relationships WHERE {where.replace('@', SOME_METHOD)}", name)
    def run(spark, sf):
        return store.incident(relationships(spark, sf), some_method(spark, sf), direction, "CALLS", strict).select("source_id", "target_id", "rel_type")


_incident("incident_edges_outgoing", "outgoing", "source_id = @ AND rel_type = 'CALLS'")
_incident("incident_edges_incoming", "incoming", "target_id = @ AND rel_type = 'CALLS'")
_incident("incident_edges_both", "both", "(source_id = @ OR target_id = @) AND rel_type = 'CALLS'")
_incident("incident_edges_both_strict", "both", "source_id = @ OR target_id = @ AND rel_type = 'CALLS'", True)


def _search(name: str, limit: int, offset: int):
    @query(G + f"SELECT id, name, package, (SELECT count(*) FROM methods WHERE name ILIKE '%00001%') AS total, (SELECT count(*) FROM methods WHERE name ILIKE '%00001%') > {offset + limit} AS has_more FROM methods WHERE name ILIKE '%00001%' ORDER BY name, package NULLS FIRST, id LIMIT {limit} OFFSET {offset}", name)
    def run(spark, sf):
        return store.search_methods(methods(spark, sf), name="00001", limit=limit, offset=offset).select("id", "name", "package", "total", "has_more")


_search("search_methods_page1", 20, 0)
_search("search_methods_page3_has_more", 3, 6)


@query(G + "SELECT id FROM methods WHERE name ILIKE '%r#0000_\\1%' OR name ILIKE '%R#000000_1%'")
def search_like_escape(spark, sf):
    m = methods(spark, sf)
    return m.filter(store.contains_like("name", "r#0000_\\1") | store.contains_like("name", "R#000000_1")).select("id")


@query(G + "SELECT id, complexity FROM methods WHERE package ILIKE '%asi%' AND project_id = 'MACHINERY'")
def search_by_package_pattern(spark, sf):
    m = methods(spark, sf)
    return m.filter(store.contains_like("package", "asi") & store.conjunction(project_id="MACHINERY")).select("id", "complexity")


@query(
    G
    + """, wanted AS (SELECT c_custkey AS query, name AS method_name, CASE WHEN c_custkey % 2 = 0 THEN class_name ELSE 'none' END AS class_name FROM methods WHERE c_custkey % 50 = 0),
met AS (SELECT query, m.id, m.name, CASE WHEN m.class_name = w.class_name THEN 0 WHEN contains(lower(m.package), lower(w.class_name)) THEN 1 ELSE 2 END AS priority FROM wanted w JOIN methods m ON m.name = w.method_name)
SELECT query, id, priority FROM met QUALIFY row_number() OVER (PARTITION BY query ORDER BY priority, name, id) = 1"""
)
def find_method_class_priority(spark, sf):
    m = methods(spark, sf)
    wanted = m.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("query"), F.col("name").alias("method_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("class_name")).otherwise("none").alias("class_name"))
    return store.find_by_signature(m, wanted).select("query", "id", "priority")


@query(G + "SELECT id, name FROM methods WHERE package ILIKE '%europe%' ORDER BY name, id LIMIT 30")
def methods_by_class(spark, sf):
    return methods(spark, sf).filter(store.contains_like("package", "europe")).orderBy("name", "id").limit(30).select("id", "name")


@query(G + f"SELECT {PARSED} FROM entities")
def json_props_merge(spark, sf):
    return store.with_properties(entities(spark, sf)).select("id", "complexity", "loc", "return_type")


@query(
    G
    + """, changed AS (SELECT id, type, name || '!' AS name, seq + 5000000000 AS seq FROM entities WHERE seq % 7 = 0 UNION ALL SELECT id || '+', type, name, seq FROM entities WHERE type = 'Class'),
everything AS (SELECT id, type, name, seq FROM entities UNION ALL SELECT * FROM changed)
SELECT * FROM everything QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""
)
def entity_upsert_last_wins(spark, sf):
    e = entities(spark, sf).select("id", "type", "name", "seq")
    changed = e.filter("seq % 7 = 0").select("id", "type", F.concat("name", F.lit("!")).alias("name"), (F.col("seq") + 5_000_000_000).alias("seq"))
    new = e.filter("type = 'Class'").withColumn("id", F.concat("id", F.lit("+")))
    return store.upsert(e, changed.unionByName(new))


@query(G + "SELECT id, project_id FROM entities WHERE project_id <> 'BUILDING'")
def clear_project(spark, sf):
    return store.clear_project(entities(spark, sf), "BUILDING").select("id", "project_id")


@query(G + ", fewer AS (SELECT * FROM entities WHERE seq % 10 <> 3) SELECT rel_type, 'source' AS missing, count(*) AS n FROM relationships WHERE source_id NOT IN (SELECT id FROM fewer) GROUP BY 1 UNION ALL SELECT rel_type, 'target', count(*) FROM relationships WHERE target_id NOT IN (SELECT id FROM fewer) GROUP BY 1")
def dangling_edges(spark, sf):
    fewer = entities(spark, sf).filter("seq % 10 <> 3")
    return store.dangling(relationships(spark, sf), fewer).groupBy("rel_type", "missing").agg(F.count(F.lit(1)).alias("n"))


@query(G + ", fewer AS (SELECT * FROM entities WHERE seq % 10 <> 3) SELECT rel_type, count(*) AS n FROM relationships WHERE source_id IN (SELECT id FROM fewer) AND target_id IN (SELECT id FROM fewer) GROUP BY 1")
def both_endpoints_exist(spark, sf):
    return store.between_known(relationships(spark, sf), entities(spark, sf).filter("seq % 10 <> 3")).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(G + "SELECT r.source_id, min_by(e.id, e.seq) AS field_id FROM relationships r JOIN entities e ON e.id = r.target_id WHERE r.rel_type = 'CONTAINS' AND e.type = 'Field' GROUP BY 1")
def field_in_class_join(spark, sf):
    fields = entities(spark, sf).filter("type = 'Field'").select("id", "seq")
    met = relationships(spark, sf).filter("rel_type = 'CONTAINS'").join(fields, F.col("target_id") == F.col("id"))
    return met.groupBy("source_id").agg(F.min_by("id", "seq").alias("field_id"))


@query(G + ", calls AS (SELECT id AS caller, 'Customer#' || lpad(CAST((c_custkey * 3) % 400 AS VARCHAR), 9, '0') AS name FROM methods), firsts AS (SELECT name, min_by(id, seq) AS target_id FROM methods GROUP BY 1) SELECT caller AS source_id, target_id FROM calls JOIN firsts USING (name)")
def call_resolution(spark, sf):
    m = methods(spark, sf)
    calls = m.select(F.col("id").alias("caller"), F.concat(F.lit("Customer#"), F.lpad(((F.col("c_custkey") * 3) % 400).cast("string"), 9, "0")).alias("name"))
    return store.resolve_calls(calls, m.select("id", "name", "seq"))


@query(G + ", uses AS (SELECT id, class_id, 'Supplier#' || lpad(CAST(c_custkey % 50 AS VARCHAR), 9, '0') AS s_name FROM methods) SELECT u.id AS source_id, f.field_id AS target_id FROM uses u JOIN fields f USING (class_id, s_name)")
def field_use_resolution(spark, sf):
    uses = methods(spark, sf).select("id", "class_id", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 50).cast("string"), 9, "0")).alias("name"))
    fields = entities(spark, sf).filter("type = 'Field'").select(F.col("id").alias("target_id"), "name", F.regexp_replace("id", "^field:(.*):[^:]*$", "$1").alias("class_id"))
    return uses.join(fields, ["class_id", "name"]).select(F.col("id").alias("source_id"), "target_id")


@query(G + ", refs AS (SELECT id AS source_id, CASE WHEN c_custkey % 2 = 0 THEN class_name ELSE 'Ext' || (c_custkey % 5) END AS name FROM methods), firsts AS (SELECT name, min_by(id, seq) AS id FROM entities GROUP BY 1) SELECT source_id, name, coalesce(id, 'virtual:' || name) AS target_id FROM refs LEFT JOIN firsts USING (name)")
def virtual_nodes(spark, sf):
    refs = methods(spark, sf).select(F.col("id").alias("source_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("class_name")).otherwise(F.concat(F.lit("Ext"), (F.col("c_custkey") % 5).cast("string"))).alias("name"))
    return store.virtual_targets(refs, entities(spark, sf))


@query(G + f"SELECT DISTINCT e.type, e.id, e.name FROM relationships r JOIN entities e ON e.id = r.target_id WHERE r.source_id = {SOME_METHOD} AND e.type IN ('Method', 'Class', 'Field')")
def direct_dependencies(spark, sf):
    return store.dependencies(relationships(spark, sf), entities(spark, sf), some_method(spark, sf))


@query(G + "SELECT a.id, count(*) AS n FROM methods a JOIN methods b ON a.class_id = b.class_id AND a.id <> b.id AND b.complexity BETWEEN CASE WHEN a.complexity <= 2 THEN 1 WHEN a.complexity <= 5 THEN a.complexity - 1 ELSE a.complexity - 2 END AND CASE WHEN a.complexity <= 2 THEN 3 WHEN a.complexity <= 5 THEN a.complexity + 2 ELSE a.complexity + 3 END GROUP BY 1")
def complexity_range_join(spark, sf):
    return store.complexity_neighbours(methods(spark, sf))


@query(G + ", wanted AS (SELECT id AS q, unnest(parameter_types) AS t FROM methods WHERE c_custkey % 50 = 0), met AS (SELECT DISTINCT q, t, m.id, m.name FROM wanted w JOIN methods m ON m.id <> w.q AND (list_contains(m.parameter_types, t) OR list_contains(list_transform(m.parameter_types, lambda x: string_split(x, '.')[-1]), string_split(t, '.')[-1]))) SELECT q, t, id FROM met QUALIFY row_number() OVER (PARTITION BY q, t ORDER BY name, id) <= 10")
def param_type_overlap(spark, sf):
    m = methods(spark, sf)
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    wanted = m.filter("c_custkey % 50 = 0").select(F.col("id").alias("q"), F.explode("parameter_types").alias("t")).withColumn("key", last(F.col("t")))
    offered = m.select("id", "name", F.explode(F.array_distinct(F.transform("parameter_types", last))).alias("key"))
    return store.first_others(wanted, offered, 10).select("q", "t", "id")


@query(G + ", met AS (SELECT a, id, name FROM (SELECT unnest(annotations) AS a, id, name FROM methods)) SELECT a, id FROM met QUALIFY row_number() OVER (PARTITION BY a ORDER BY name, id) <= 8")
def annotation_top8(spark, sf):
    met = methods(spark, sf).select(F.explode("annotations").alias("a"), "id", "name")
    return store.top_of(met, ["a"], ["name", "id"], 8).select("a", "id")


@query(G + "SELECT id FROM methods WHERE starts_with(package, 'A')")
def package_prefix(spark, sf):
    return methods(spark, sf).filter(F.startswith("package", F.lit("A"))).select("id")


@query(G + ", refs AS (SELECT class_id AS a, unnest(['NATION_' || ((n_nationkey * 5) % 25), class_name, 'String']) AS ref FROM classes) SELECT a AS source_id, c.class_id AS target_id FROM refs JOIN classes c ON c.class_name = ref WHERE c.class_id <> a")
def dependency_closure(spark, sf):
    c = classes(spark, sf)
    refs = c.select(F.col("class_id").alias("source_id"), F.explode(F.array(F.concat(F.lit("NATION_"), ((F.col("n_nationkey") * 5) % 25).cast("string")), F.col("class_name"), F.lit("String"))).alias("class_name"))
    return refs.join(c.select("class_name", F.col("class_id").alias("target_id")), "class_name").filter("source_id <> target_id").select("source_id", "target_id")


@query("SELECT l_partkey, l_orderkey, l_extendedprice, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn <= 2")
def top_two_per_part(spark, sf):
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_quantity"]
    return store.top_of(table(spark, sf, "lineitem"), ["l_partkey"], order, 2).select("l_partkey", "l_orderkey", "l_extendedprice", F.col("rank").alias("rn"))
