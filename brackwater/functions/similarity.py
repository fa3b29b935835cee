"""Vector functions over arrays, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.try_divide(dot(a, b), n))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


#: Metric name to function and whether larger is closer.
METRICS = {"Cosine": (cosine, True), "Dot": (dot, True), "Euclid": (euclid, False), "Manhattan": (manhattan, False)}


def hash_embedding(text: Column, size: int) -> Column:
    """A deterministic stand-in for a model: numbers below 1 drawn from the text's MD5 with each place."""
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", text, i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.transform(F.sequence(F.lit(1), F.lit(size)), draw)
