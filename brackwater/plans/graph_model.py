"""The property graph as a projection of the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table


def classes(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = table(spark, sf, "nation").join(region, "n_regionkey")
    return nation.select("n_nationkey", "n_regionkey", F.col("n_name").alias("class_name"), F.col("r_name").alias("package"), F.concat(F.lit("class:"), "r_name", F.lit("."), "n_name").alias("class_id"))


def methods(spark: SparkSession, sf: str) -> DataFrame:
    """One flattened view of methods: hot properties are columns, not JSON."""
    own = table(spark, sf, "customer").join(classes(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.select(
        F.concat(F.lit("method:"), "class_id", F.lit(":"), "c_name").alias("id"),
        F.col("c_name").alias("name"),
        "class_name",
        "package",
        "class_id",
        F.col("c_mktsegment").alias("project_id"),
        F.col("c_mktsegment").alias("return_type"),
        (F.lit(1) + F.col("c_custkey") % 12).cast("int").alias("complexity"),
        (F.lit(3) + F.col("c_custkey") % 40).cast("int").alias("loc"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("String"), F.lit("java.util.List"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("int"))).otherwise(F.array().cast("array<string>")).alias("parameter_types"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("Override"))).when(F.col("c_custkey") % 5 == 1, F.array(F.lit("Test"), F.lit("Autowired"))).otherwise(F.array().cast("array<string>")).alias("annotations"),
        (F.lit(1_000_000) + F.col("c_custkey")).alias("seq"),
        "c_custkey",
    )


def _entity(df: DataFrame, id_, type_: str, name, package, project, properties, seq) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(type_).alias("type"), name.alias("name"), package.alias("package"), project.alias("project_id"), properties.alias("properties"), seq.cast("bigint").alias("seq"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Package, class, method and field nodes: one projection for each type and a union."""
    region, cls, m = table(spark, sf, "region"), classes(spark, sf), methods(spark, sf)
    fields = table(spark, sf, "supplier").join(cls, F.col("s_nationkey") == F.col("n_nationkey"))
    none, default = F.lit(None).cast("string"), F.lit("default")
    properties = F.concat(F.lit('{"complexity":'), F.col("complexity").cast("string"), F.lit(',"loc":'), F.col("loc").cast("string"), F.lit(',"return_type":"'), "return_type", F.lit('"}'))
    return (
        _entity(region, F.concat(F.lit("package:"), "r_name"), "Package", F.col("r_name"), F.col("r_name"), default, none, F.col("r_regionkey"))
        .unionByName(_entity(cls, F.col("class_id"), "Class", F.col("class_name"), F.col("package"), default, none, F.lit(1000) + F.col("n_nationkey")))
        .unionByName(_entity(m, F.col("id"), "Method", F.col("name"), F.col("package"), F.col("project_id"), properties, F.col("seq")))
        .unionByName(_entity(fields, F.concat(F.lit("field:"), "class_id", F.lit(":"), "s_name"), "Field", F.col("s_name"), F.col("package"), default, none, F.lit(2_000_000_000) + F.col("s_suppkey")))
    )


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as a bag: CONTAINS, EXTENDS, CALLS and USES. The large facts are joined on keys before ids are spelled out."""
    cls, m = classes(spark, sf), methods(spark, sf)
    fields = table(spark, sf, "supplier").join(cls, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "class_id", F.concat(F.lit("field:"), "class_id", F.lit(":"), "s_name").alias("field_id"))
    edge = lambda df, s, t, kind: df.select(F.expr(s).alias("source_id"), F.expr(t).alias("target_id"), F.lit(kind).alias("rel_type"))
    after = cls.withColumn("next_id", F.lead("class_id").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).filter("next_id is not null")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    ids = m.select("c_custkey", F.col("id").alias("method_id"))
    count = table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n")).first()["n"]
    calls = orders.withColumn("callee", (F.col("o_orderkey") * 7) % F.lit(count))
    calls = calls.join(ids.select(F.col("c_custkey").alias("o_custkey"), F.col("method_id").alias("a")), "o_custkey").join(ids.select(F.col("c_custkey").alias("callee"), F.col("method_id").alias("b")), "callee")
    uses = orders.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey")), "o_orderkey")
    uses = uses.join(ids.select(F.col("c_custkey").alias("o_custkey"), "method_id"), "o_custkey").join(fields.select("s_suppkey", "field_id"), "s_suppkey")
    return (
        edge(cls, "concat('package:', package)", "class_id", "CONTAINS")
        .unionByName(edge(m, "class_id", "id", "CONTAINS"))
        .unionByName(edge(fields, "class_id", "field_id", "CONTAINS"))
        .unionByName(edge(after, "class_id", "next_id", "EXTENDS"))
        .unionByName(edge(calls, "a", "b", "CALLS"))
        .unionByName(edge(uses, "method_id", "field_id", "USES"))
        .withColumn("project_id", F.lit("default"))
    )


#: The same graph in SQL, as the beginning of every oracle over it.
GRAPH_SQL = """
classes AS (SELECT n_nationkey, n_regionkey, n_name AS class_name, r_name AS package, 'class:' || r_name || '.' || n_name AS class_id FROM nation JOIN region ON n_regionkey = r_regionkey),
methods AS (SELECT 'method:' || class_id || ':' || c_name AS id, c_name AS name, class_name, package, class_id, c_mktsegment AS project_id, c_mktsegment AS return_type,
  CAST(1 + c_custkey % 12 AS INTEGER) AS complexity, CAST(3 + c_custkey % 40 AS INTEGER) AS loc,
  CASE c_custkey % 3 WHEN 0 THEN ['String', 'java.util.List'] WHEN 1 THEN ['int'] ELSE CAST([] AS VARCHAR[]) END AS parameter_types,
  CASE c_custkey % 5 WHEN 0 THEN ['Override'] WHEN 1 THEN ['Test', 'Autowired'] ELSE CAST([] AS VARCHAR[]) END AS annotations,
  1000000 + c_custkey AS seq, c_custkey FROM customer JOIN classes ON c_nationkey = n_nationkey),
fields AS (SELECT s_suppkey, s_name, class_id, package, 'field:' || class_id || ':' || s_name AS field_id FROM supplier JOIN classes ON s_nationkey = n_nationkey),
entities AS (
  SELECT 'package:' || r_name AS id, 'Package' AS type, r_name AS name, r_name AS package, 'default' AS project_id, CAST(NULL AS VARCHAR) AS properties, CAST(r_regionkey AS BIGINT) AS seq FROM region
  UNION ALL SELECT class_id, 'Class', class_name, package, 'default', NULL, 1000 + n_nationkey FROM classes
  UNION ALL SELECT id, 'Method', name, package, project_id, '{"complexity":' || complexity || ',"loc":' || loc || ',"return_type":"' || return_type || '"}', seq FROM methods
  UNION ALL SELECT field_id, 'Field', s_name, package, 'default', NULL, 2000000000 + s_suppkey FROM fields),
relationships AS MATERIALIZED (
  SELECT 'package:' || package AS source_id, class_id AS target_id, 'CONTAINS' AS rel_type, 'default' AS project_id FROM classes
  UNION ALL SELECT class_id, id, 'CONTAINS', 'default' FROM methods
  UNION ALL SELECT class_id, field_id, 'CONTAINS', 'default' FROM fields
  UNION ALL SELECT class_id, next_id, 'EXTENDS', 'default' FROM (SELECT class_id, lead(class_id) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next_id FROM classes) WHERE next_id IS NOT NULL
  UNION ALL SELECT a.id, b.id, 'CALLS', 'default' FROM orders JOIN methods a ON a.c_custkey = o_custkey JOIN methods b ON b.c_custkey = (o_orderkey * 7) % (SELECT count(*) FROM customer)
  UNION ALL SELECT m.id, f.field_id, 'USES', 'default' FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN methods m ON m.c_custkey = o_custkey JOIN fields f ON f.s_suppkey = l_suppkey)
"""
