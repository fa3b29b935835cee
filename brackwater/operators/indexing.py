"""From parsed classes to entities and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def class_ids(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("class_id", F.concat(F.lit("class:"), "package", F.lit("."), "name"))


def _named(parsed: DataFrame) -> DataFrame:
    """What nodes and edges are made of, without source code, written once: files aren't parsed again for each kind of node or edge."""
    names = lambda k, *more: F.transform(k, lambda x: F.struct(x["name"].alias("name"), *[x[m].alias(m) for m in more])).alias(k)
    return saved(class_ids(parsed).select("class_id", "name", "package", "imports", "extends", "implements", names("fields"), names("methods", "calls")), "parsed")


def entities(parsed: DataFrame) -> DataFrame:
    """Package, class, method and field nodes; overloads share an id, and the last one counts once."""
    c = _named(parsed)
    row = lambda df, i, t, n: df.select(i.alias("id"), F.lit(t).alias("type"), n.alias("name"), "package")
    m, f = (c.select("class_id", "package", F.explode(k).alias("x")) for k in ("methods", "fields"))
    out = row(c, F.concat(F.lit("package:"), "package"), "Package", F.col("package")).unionByName(row(c, F.col("class_id"), "Class", F.col("name")))
    out = out.unionByName(row(m, F.concat(F.lit("method:"), "class_id", F.lit(":"), "x.name"), "Method", F.col("x.name"))).unionByName(row(f, F.concat(F.lit("field:"), "class_id", F.lit(":"), "x.name"), "Field", F.col("x.name")))
    return out.distinct()


def relationships(parsed: DataFrame) -> DataFrame:
    """CONTAINS from structure; EXTENDS, IMPLEMENTS, IMPORTS and CALLS resolved by name over the whole batch, classes that aren't known as virtual nodes."""
    c = _named(parsed)
    edge = lambda df, s, t, k: df.select(s.alias("source_id"), t.alias("target_id"), F.lit(k).alias("rel_type"))
    method = F.concat(F.lit("method:"), "class_id", F.lit(":"), "x.name")
    m, f = (c.select("class_id", F.explode(k).alias("x")) for k in ("methods", "fields"))
    known = c.groupBy("name").agg(F.min("class_id").alias("parent"))
    named_class = lambda df: df.join(known, "name", "left").select("class_id", F.coalesce("parent", F.concat(F.lit("virtual:"), "name")).alias("parent"))
    up = named_class(c.filter("extends is not null").select("class_id", F.col("extends").alias("name")))
    does = named_class(c.select("class_id", F.explode("implements").alias("name")))
    takes = named_class(c.select("class_id", F.explode(F.transform("imports", lambda x: F.element_at(F.split(x, r"\."), -1))).alias("name")))
    named = m.select(F.col("x.name").alias("callee"), method.alias("target_id")).groupBy("callee").agg(F.min("target_id").alias("target_id"))
    calls = m.select(method.alias("source_id"), F.explode("x.calls").alias("callee")).join(named, "callee")
    return (
        edge(c, F.concat(F.lit("package:"), "package"), F.col("class_id"), "CONTAINS")
        .unionByName(edge(m, F.col("class_id"), method, "CONTAINS"))
        .unionByName(edge(f, F.col("class_id"), F.concat(F.lit("field:"), "class_id", F.lit(":"), "x.name"), "CONTAINS"))
        .unionByName(edge(up, F.col("class_id"), F.col("parent"), "EXTENDS"))
        .unionByName(edge(does, F.col("class_id"), F.col("parent"), "IMPLEMENTS"))
        .unionByName(edge(takes, F.col("class_id"), F.col("parent"), "IMPORTS"))
        .unionByName(edge(calls, F.col("source_id"), F.col("target_id"), "CALLS"))
    )
