"""Small projections for display and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saved


def colour(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def tier(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def rendered_path(path: Column) -> Column:
    """A walk as text."""
    return F.concat(F.lit("walk: "), F.concat_ws(" -> ", path), F.lit(" ("), (F.size(path) - 1).cast("string"), F.lit(" steps)"))


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by order, as a top-k of each task and then of all."""
    return df.orderBy(F.col(order).desc()).limit(n)


def zipped(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of two tables of equal length by position; their numbers must match."""
    one, two = numbered(left, order), numbered(right, order)
    if one.count() != two.count():
        raise ValueError("tables differ in length")
    return one.join(two.drop(order), "_pos").drop("_pos")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with `_pos`, counted from 1 by order. Rows are dealt by range, numbered inside each, and shifted by the ranges before, so that no task sees them all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("_pos", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def feedback(issues: Column, suggestions: Column) -> Column:
    """The first five issues and three suggestions as text."""
    return F.concat(F.lit("Issues: "), F.array_join(F.slice(issues, 1, 5), "; "), F.lit(". Suggestions: "), F.array_join(F.slice(suggestions, 1, 3), "; "))


def code_block(text: Column) -> Column:
    """The first fenced block of Java, or the text itself."""
    found = F.regexp_extract(text, r"(?s)```java\s*(.*?)\s*```", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def parameter_types(signature: Column) -> Column:
    inside = F.regexp_extract(signature, r"\(([^)]*)\)", 1)
    return F.filter(F.transform(F.split(inside, r"\s*,\s*"), lambda p: F.regexp_extract(F.trim(p), r"^(\S+)\s+\S+$", 1)), lambda t: t != "")


def merged(left: Column, right: Column) -> Column:
    """Two maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def signature(method: Column) -> Column:
    """A method's modifiers, type, name and parameters as text."""
    parameters = F.array_join(F.transform(method["parameters"], lambda p: F.concat(p["type"], F.lit(" "), p["name"])), ", ")
    return F.concat(F.array_join(method["modifiers"], " "), F.lit(" "), method["return_type"], F.lit(" "), method["name"], F.lit("("), parameters, F.lit(")"))


# What requests may ask for.
LIMITS = {"hours": (1, 168), "limit": (1, 100), "points": (10, 500)}
NAMES = {"agent": ("IndexerAgent", "ResearcherAgent", "GeneratorAgent", "CriticAgent"), "format": ("html", "png", "json")}


def valid(kind: Column, value: Column) -> Column:
    """Whether a request's value is one that its kind allows; kinds that aren't known allow none."""
    number, out = value.try_cast("int"), F.lit(False)
    for name, (least, most) in LIMITS.items():
        out = F.when(kind == name, F.coalesce(number.between(least, most), F.lit(False))).otherwise(out)
    for name, values in NAMES.items():
        out = F.when(kind == name, value.isin(*values)).otherwise(out)
    return out
