"""Packing documents into batches: length buckets of least padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_broadcast, text_of, words

#: Rows that are numbered together, about.
CHUNK = 20_000


def word_count(text_column: str = "text") -> Column:
    """The default length: words and one end."""
    return (F.size(words(text_of(text_column))) + 1).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` ranges of ascending lengths for which the summed padding, each length up to its range's end, is least.

    best[j] is the least padding of the first j lengths with the ranges so far; each round allows one range more. The best cut never moves
    back as j grows, so a round halves the lengths again and again, all halves of a level at once: n log n steps a round.
    """
    if not lengths:
        return []
    x, c = [np.asarray(v, np.int64).astype(object if sum(counts) * lengths[-1] >= 2**61 else np.int64) for v in (lengths, counts)]
    n = len(x)
    rows, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = np.concatenate([[0], x * rows[1:] - mass[1:]])  # one range
    cut = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, back = best.copy(), np.zeros(n + 1, np.int64)
        step = 1 << n.bit_length()
        done = np.zeros(0, np.int64)
        while step:
            # The places of this level, between places that have been settled.
            j = np.arange(step, n + 1, 2 * step)
            if len(j):
                after = np.searchsorted(done, j)
                low = np.where(after > 0, back[done[after - 1]], 0) if len(done) else np.zeros(len(j), np.int64)
                high = np.where(after < len(done), np.minimum(back[done[np.minimum(after, len(done) - 1)]], j - 1), j - 1) if len(done) else j - 1
                size = high - low + 1
                first = np.cumsum(size) - size
                k = np.arange(size.sum()) - np.repeat(first - low, size)
                of = np.repeat(j, size)
                cost = best[k] + x[of - 1] * (rows[of] - rows[k]) - (mass[of] - mass[k])
                least = np.minimum.reduceat(cost, first)
                hit = np.flatnonzero(cost == np.repeat(least, size))
                back[j] = k[hit[np.searchsorted(hit, first)]]
                new[j] = least
                done = np.union1d(done, j)
            step //= 2
        best = new
        cut.append(back)
    ends, j = [], n
    for back in reversed(cut):
        if j:
            ends.append(int(x[j - 1]))
            j = int(back[j])
    return sorted(ends)


def histogram(lengths: DataFrame, bins: int | None = None) -> tuple[list[int], list[int]]:
    """Ascending distinct lengths with their counts over all rows, exact; with bins, at most so many, each the longest of its neighbours."""
    rows = sorted((r["n_tokens"], r["n"]) for r in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toLocalIterator())
    if bins and len(rows) > bins:
        bar = [k * bins // len(rows) for k in range(len(rows))]
        rows = [(max(x for x, _ in g), sum(n for _, n in g)) for g in ([r for r, b in zip(rows, bar) if b == k] for k in range(bins))]
    return [b for b, _ in rows], [n for _, n in rows]


def pack(docs: DataFrame, *, buckets: int = 16, token_budget: int = 32_768, bins: int | None = None, length: Column | None = None, id_column: str = "doc_id", seed: int = 11) -> DataFrame:
    """Each document's bucket, batch and padding.

    The lengths of all documents make one exact histogram, for which dynamic programming finds the upper ends of `buckets` ranges with the
    least padding. Only if `bins` is given and there are more distinct lengths, neighbours count as the longest of them. Inside a bucket the documents are numbered by a seeded hash, and each
    floor(token_budget / bucket_length) of them are a batch, at least one; only a bucket's last batch may be short. Texts are never cut.

    Null and empty texts are one token long, the end. Repeated rows are packed each for itself; their order is arbitrary but they are
    alike. Null ids are packed like others. Other columns are ignored. An empty table gives no rows.
    Returns doc_id, n_tokens, bucket (int), bucket_length, batch (string), place (int), padding (long).
    """
    scratch = Scratch(docs.sparkSession, "pack")
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), (word_count() if length is None else length).cast("long").alias("n_tokens"))
    slim = scratch.save(slim.withColumn("row", F.monotonically_increasing_id()), "lengths")
    ends = boundaries(*histogram(slim, bins), buckets)
    if not ends:
        return slim.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_length"), F.lit("").alias("batch"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("padding"))
    table = F.array(*[F.lit(e) for e in ends])
    bucket = F.size(F.filter(table, lambda e: e < F.col("n_tokens")))
    put = slim.withColumn("bucket", bucket).withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "n_tokens", F.lit(seed)))
    # Rows alike in id and length share their hash. Where they are many they are numbered behind the others, in parts dealt by their places in the table.
    alike = put.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("n"))
    many = scratch.save(alike.filter(F.col("n") > CHUNK).select(F.col("bucket").alias("hot_bucket"), F.col("h").alias("hot_h"), F.col("n").alias("hot_n")), "many")
    sizes = {r["bucket"]: r["n"] for r in alike.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    parts = F.array(*[F.lit(max(1, -(-sizes.get(k, 0) // CHUNK))) for k in range(len(ends))])
    put = put.join(bounded_broadcast(many, many.count()), (F.col("bucket") == F.col("hot_bucket")) & (F.col("h") == F.col("hot_h")), "left")
    own = F.struct(F.lit(0).alias("late"), F.lit(0).cast("long").alias("key"), F.pmod("h", F.get(parts, F.col("bucket"))).cast("long").alias("part"))
    late = F.struct(F.lit(1).alias("late"), F.col("h").alias("key"), F.pmod(F.xxhash64("row"), F.ceil(F.col("hot_n") / CHUNK)).cast("long").alias("part"))
    put = put.withColumn("part", F.when(F.col("hot_n").isNull(), own).otherwise(late)).withColumn("bucket_length", F.get(table, F.col("bucket")).cast("long"))
    counts = put.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("bucket").alias("b"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    before = bounded_broadcast(before, sum(-(-n // CHUNK) for n in sizes.values()))
    inside = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("h", "doc_id", "n_tokens", "row")) - 1
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_length")))
    out = put.withColumn("inside", inside).join(before, (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))).withColumn("at", F.col("before") + F.col("inside"))
    name = F.concat_ws("-", F.col("bucket").cast("string"), F.floor(F.col("at") / each).cast("string"))
    return out.select("doc_id", "n_tokens", "bucket", "bucket_length", name.alias("batch"), (F.col("at") % each).cast("int").alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
