"""Metrics time series: summaries, shares, funnels and box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("latency"), 2).alias("avg_latency"))


def share(df: DataFrame, key: str, value: str) -> DataFrame:
    total = df.groupBy(key).agg(F.sum(value).alias(value))
    return total.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy()))  # a row for each key


def box(df: DataFrame, key: str, value: str) -> DataFrame:
    q = lambda p: F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(key).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def funnel(stages: DataFrame) -> DataFrame:
    """stages(ord, stage, n) with the percentage of the first stage; a row for each stage."""
    return stages.withColumn("percent", 100 * F.col("n") / F.first("n").over(Window.partitionBy().orderBy("ord")))


def hourly(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumn("hour", F.date_trunc("hour", ts))


def rate(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def elapsed(micros) -> tuple:
    """Microseconds as milliseconds and as seconds, to two places; halves go up."""
    to = lambda n: F.floor((micros + n // 2) / n).cast("long") / 100.0
    return to(10).alias("elapsed_ms"), to(10_000).alias("elapsed_s")
