"""Relational store and search over entities and relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROPERTIES = "complexity int, loc int, return_type string"


def conjunction(**wanted) -> Column:
    """column == value for each value that isn't None; true without any."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items() if v is not None], F.lit(True))


def contains_like(column: str, pattern: str) -> Column:
    """Case-insensitive LIKE with % around; % and _ of the pattern stay wildcards, a backslash is an ordinary character."""
    return F.col(column).ilike("%" + pattern.replace("\\", "\\\\") + "%")


def by_id(entities: DataFrame, entity_id: str, project_id: str | None = None) -> DataFrame:
    return entities.filter(conjunction(id=entity_id, project_id=project_id))


def by_type(entities: DataFrame, type_: str, project_id: str | None = None, limit: int | None = None) -> DataFrame:
    out = entities.filter(conjunction(type=type_, project_id=project_id))
    return out if limit is None else out.orderBy("seq", "id").limit(limit)


def filter_relationships(rels: DataFrame, source_id=None, target_id=None, rel_type=None, project_id=None) -> DataFrame:
    return rels.filter(conjunction(source_id=source_id, target_id=target_id, rel_type=rel_type, project_id=project_id))


def incident(rels: DataFrame, node: str, direction: str = "both", rel_type: str | None = None, strict_precedence: bool = False) -> DataFrame:
    """Edges at a node. strict_precedence keeps the precedence of an unparenthesised OR/AND, by which outgoing edges escape the type filter."""
    out, into = F.col("source_id") == node, F.col("target_id") == node
    kind = F.lit(True) if rel_type is None else F.col("rel_type") == rel_type
    where = {"outgoing": out & kind, "incoming": into & kind, "both": (out | (into & kind)) if strict_precedence else ((out | into) & kind)}
    return rels.filter(where[direction])


def with_properties(entities: DataFrame) -> DataFrame:
    """JSON properties merged into the row; what can't be parsed stays text and gives nulls."""
    parsed = F.from_json("properties", PROPERTIES)
    return entities.withColumn("_p", parsed).select("*", "_p.*").drop("_p")


def search_methods(methods: DataFrame, name: str | None = None, class_name: str | None = None, package: str | None = None, project_id: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of methods by name, package and id, with the number of all matches and whether more follow. class_name filters the package."""
    where = conjunction(project_id=project_id, package=package)
    if name:
        where &= contains_like("name", name)
    if class_name:
        where &= contains_like("package", class_name)
    found = methods.filter(where)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy(F.col("name"), F.col("package").asc_nulls_first(), F.col("id")).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def find_by_signature(methods: DataFrame, wanted: DataFrame, exact: bool = True) -> DataFrame:
    """For each (query, method_name, class_name) the first method: exact class, then part of its package, then any; ties by name and id."""
    match = F.col("name") == F.col("method_name") if exact else F.expr("name ilike method_name")
    rank = F.when(F.col("m.class_name") == F.col("w.class_name"), 0).when(F.contains(F.lower("m.package"), F.lower("w.class_name")), 1).otherwise(2)
    met = wanted.alias("w").join(methods.alias("m"), match).select("query", "m.*", rank.alias("priority"))
    return first_of(met, ["query"], ["priority", "name", "id"])


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def top_of(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most n rows of each key; Spark limits each task's rows before they are shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def first_others(wanted: DataFrame, offered: DataFrame, n: int) -> DataFrame:
    """wanted(q, t, key) to at most n offered(id, name, key) of its key for each (q, t), q itself left out, by name and id.

    All that ask for a key find the same rows but themselves, so each key's first n + 1 ids are looked for once, and only those are joined. Rows without an id or a key are left out.
    """
    ids = offered.filter("id is not null").groupBy("key", "id").agg(F.collect_set(F.struct("name")).alias("names"))
    firsts = top_of(ids, ["key"], [F.array_min("names"), "id"], n + 1).select("key", "id", F.explode("names").alias("n")).select("key", "id", "n.name")
    met = wanted.distinct().join(firsts, "key").filter(F.col("id") != F.col("q"))
    return top_of(met.select("q", "t", "id", "name").distinct(), ["q", "t"], ["name", "id"], n)


def sql(spark, statement: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A statement with named parameters over tables, which stand in braces; values are never spelled into the text."""
    return spark.sql(statement, args=args or {}, **tables)


def stamped(points: DataFrame) -> DataFrame:
    """points with an id of their own and the time at which they came."""
    return points.withColumns({"point_id": F.uuid(), "indexed_at": F.current_timestamp()})


def upsert(table: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("id",), seq: str = "seq") -> DataFrame:
    """Last write wins by keys."""
    return first_of(table.unionByName(changes), list(keys), [F.col(seq).desc()])


def delete(table: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    out = table if ids is None else table.join(ids.select(key), key, "left_anti")
    return out if where is None else out.filter(~F.coalesce(where, F.lit(False)))


def clear_project(table: DataFrame, project_id: str) -> DataFrame:
    return table.filter(F.col("project_id") != project_id)


def dangling(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end is missing."""
    ids = entities.select("id")
    lost = rels.join(ids, rels["source_id"] == ids["id"], "left_anti").select("source_id", "target_id", "rel_type", F.lit("source").alias("missing"))
    return lost.unionByName(rels.join(ids, rels["target_id"] == ids["id"], "left_anti").select("source_id", "target_id", "rel_type", F.lit("target").alias("missing")))


def between_known(rels: DataFrame, entities: DataFrame) -> DataFrame:
    ids = entities.select("id")
    return rels.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def counts_with_total(df: DataFrame, column: str) -> DataFrame:
    return df.rollup(column).agg(F.count(F.lit(1)).alias("n")).select(F.coalesce(column, F.lit("total")).alias(column), "n")


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, name) to the first-inserted method of the name; unknown names are dropped. Both passes see the whole batch."""
    firsts = methods.groupBy("name").agg(F.min_by("id", "seq").alias("target_id"))
    return calls.join(firsts, "name").select(F.col("caller").alias("source_id"), "target_id")


def virtual_targets(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, name) to the first entity of the name, or a virtual node."""
    firsts = entities.groupBy("name").agg(F.min_by("id", "seq").alias("id"))
    return refs.join(firsts, "name", "left").select("source_id", "name", F.coalesce("id", F.concat(F.lit("virtual:"), "name")).alias("target_id"))


def dependencies(rels: DataFrame, entities: DataFrame, node: str) -> DataFrame:
    """The entities that a node points to, by type."""
    ends = rels.filter(F.col("source_id") == node).select(F.col("target_id").alias("id")).distinct()
    return entities.join(ends, "id").filter(F.col("type").isin("Method", "Class", "Field")).select("type", "id", "name")


def complexity_neighbours(methods: DataFrame) -> DataFrame:
    """(id, n): how many others of its class are in a method's complexity's range. Counted by class and complexity first, so that what is joined is a row for each value, not for each pair."""
    counts = methods.groupBy("class_id", F.col("complexity").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    values = counts.select("class_id", F.col("other").alias("complexity"))
    c = F.col("complexity")
    lo = F.when(c <= 2, 1).when(c <= 5, c - 1).otherwise(c - 2)
    hi = F.when(c <= 2, 3).when(c <= 5, c + 2).otherwise(c + 3)
    near = values.join(counts, "class_id").filter(F.col("other").between(lo, hi)).groupBy("class_id", "complexity").agg(F.sum("m").alias("m"))
    own = F.when(c.between(lo, hi), 1).otherwise(0)  # a method is no neighbour of itself
    return methods.select("id", "class_id", "complexity").join(near, ["class_id", "complexity"]).select("id", (F.col("m") - own).alias("n")).filter("n > 0")
