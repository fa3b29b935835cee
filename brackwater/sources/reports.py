"""Coverage reports and logs as tables, and a key-value cache with expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(reports: DataFrame, column: str = "xml") -> DataFrame:
    """Percent covered by counter type over each report (path, xml): the last counter of a type in document order counts; empty ones are skipped."""
    found = F.regexp_extract_all(column, F.lit(r"<counter\b[^>]*/?>"), F.lit(0))
    each = reports.select("path", F.posexplode(found).alias("pos", "tag"))
    number = lambda name: F.coalesce(F.regexp_extract("tag", rf'\b{name}="(\d+)"', 1).try_cast("bigint"), F.lit(0))
    each = each.select("path", "pos", F.regexp_extract("tag", r'\btype="(\w+)"', 1).alias("type"), number("covered").alias("covered"), number("missed").alias("missed")).filter("covered + missed > 0")
    return each.groupBy("path", "type").agg(F.max_by(100 * F.col("covered") / (F.col("covered") + F.col("missed")), "pos").alias("percent"))


def sessions(lines: DataFrame) -> DataFrame:
    """Finished indexing runs in a log: how many, and their seconds, which end the line."""
    seconds = F.regexp_extract("value", r"Indexing completed.*?([0-9.]+)s?$", 1).try_cast("double")
    done = lines.select(seconds.alias("s")).filter("s is not null")
    return done.agg(F.count(F.lit(1)).alias("sessions"), F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most"))


def get(cache: DataFrame, keys: DataFrame, now) -> DataFrame:
    """keys(key) with value, null for misses and what has expired; expires_at null never does."""
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("key", "value")
    return keys.join(live, "key", "left")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries(key, value, expires_at), which replace what has their keys."""
    return cache.join(entries.select("key"), "key", "left_anti").unionByName(entries)


def keys_like(cache: DataFrame, glob: str) -> DataFrame:
    import re

    pattern = "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    return cache.filter(F.col("key").rlike("(?s)" + pattern)).select("key")


def read_through(cache: DataFrame, wanted: DataFrame, make, now, expires) -> tuple[DataFrame, DataFrame]:
    """wanted(key, text) answered from the cache or else by make(text), and the cache with what was made, which lasts until expires."""
    met = get(cache, wanted, now)
    made = met.filter("value is null").select("key", make(F.col("text")).alias("value"), F.lit(expires).cast(cache.schema["expires_at"].dataType).alias("expires_at"))
    found = met.select("key", F.coalesce("value", make(F.col("text"))).alias("value"), F.when(F.col("value").isNull(), "miss").otherwise("hit").alias("found"))
    return found, put(cache, made.dropDuplicates(["key"]))


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def json_lines(lines: DataFrame, fields: str) -> DataFrame:
    """Log lines in JSON to their fields; a line that isn't JSON has nulls."""
    return lines.select(F.from_json("value", fields).alias("x")).select("x.*")
