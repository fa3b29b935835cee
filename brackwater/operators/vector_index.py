"""A vector index on disk: cells as partitions, residuals in product codes, exact scores for the best candidates."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from .store import top_of
from .vector import Collection, search_many

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries that are sent to all tasks at once.
BLOCK = 2_000


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _centres(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k means by Lloyd's rounds, begun at rows of x; a mean that nothing is near stays where it is."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    out = x[rng.choice(len(x), k, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = np.argmin((out**2).sum(1) - 2 * x @ out.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, and what searches need of it: the cells' centres, and for each part of a vector the code words of its residuals."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    count: int
    centres: np.ndarray
    words: np.ndarray

    def table(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"{self.key} {self.key_type}, {kind}, cell int").parquet(f"{self.path}/{name}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def build(points: DataFrame, path: str, *, cells: int = 64, parts: int = 16, words: int = 256, sample: int = 20_000, seed: int = 5, key: str = "vec_id", column: str = "embedding") -> VectorIndex:
    """Writes the index of all points: codes/cell=N with a byte for each part of a vector, vectors/cell=N, and meta.

    Centres and code words are fitted on the driver, on at most `sample` points, first by the hash of their keys; every point is put into its nearest cell, and its distance
    to the cell's centre into codes, in Arrow batches. Vectors count by their direction; rows without one are left out, null keys stay. A cell
    that holds a third of all points is written by several tasks and read by as many. parts must divide the vectors' length.
    """
    spark = points.sparkSession
    rows = points.select(F.col(key).alias(key), F.col(column).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    some = rows.orderBy(F.xxhash64(key), key).limit(sample).select("v").toArrow()
    x = _unit(_matrix(some.column("v").combine_chunks())) if some.num_rows else np.zeros((0, parts))
    centres = _centres(x, cells, 12, seed)
    left = x - centres[np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)] if len(x) else x
    width = centres.shape[1] // parts
    if width * parts != centres.shape[1]:
        raise ValueError(f"{parts} parts don't divide a vector of {centres.shape[1]} numbers")
    books = [_centres(left[:, j * width : (j + 1) * width], words, 8, seed + j) for j in range(parts)]
    most = max(len(b) for b in books)
    code_words = np.stack([np.concatenate([b, np.repeat(b[-1:], most - len(b), axis=0)]) for b in books])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1)))
            cell = np.argmin((centres**2).sum(1) - 2 * v @ centres.T, axis=1)
            rest = v - centres[cell]
            code = np.empty((len(v), parts), np.uint8)
            for j in range(parts):
                book = code_words[j]
                code[:, j] = np.argmin((book**2).sum(1) - 2 * rest[:, j * width : (j + 1) * width] @ book.T, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], [key, "v", "code", "cell"])

    kind = points.schema[key].dataType.simpleString()
    dealt = rows.mapInArrow(run, f"{key} {kind}, v array<double>, code binary, cell int")
    dealt.write.mode("overwrite").parquet(f"{path}/dealt")
    dealt = spark.read.schema(f"{key} {kind}, v array<double>, code binary, cell int").parquet(f"{path}/dealt")
    salt = F.pmod(F.xxhash64(key), F.lit(8))
    for name, payload in (("codes", "code"), ("vectors", "v")):
        dealt.select(key, payload, "cell").repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{name}")
    count = dealt.count()
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.hadoop.fs.Path(f"{path}/dealt")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    meta = spark.createDataFrame([(key, kind, count, centres.tolist(), code_words.tolist())], "key string, type string, count long, centres array<array<double>>, words array<array<array<double>>>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before."""
    m = spark.read.parquet(f"{path}/meta").first()
    return VectorIndex(spark, path, m["key"], m["type"], m["count"], np.array(m["centres"]), np.array(m["words"]))


def search(index: VectorIndex, queries: DataFrame, *, probes: int = 8, limit: int = 10, candidates: int = 100, threshold: float | None = None) -> DataFrame:
    """queries(query, vector) to their closest points by cosine but that of their own key: query, key, score, rank.

    A query looks at its `probes` nearest cells, by codes first: only folders of cells that some query looks at are read. Its best `candidates` by codes get
    their exact scores from the vectors' folders. Ties go to the smaller key. Queries without a vector find nothing.
    """
    spark, key = index.spark, index.key
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("v")).filter(F.size("v") > 0)
    kind = queries.schema["query"].dataType.simpleString()
    n = asked.count()
    blocks, found = max(1, -(-n // BLOCK)), None
    centres, words = index.centres, index.words
    for k in range(blocks):
        some = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)).toArrow()
        names = some.column("query").to_pylist()
        v = _unit(_matrix(some.column("v").combine_chunks())) if names else np.zeros((0, centres.shape[1]))
        near = np.argsort((centres**2).sum(1) - 2 * v @ centres.T, axis=1, kind="stable")[:, :probes]
        wanted = sorted(set(near.ravel().tolist()))
        given = spark.sparkContext.broadcast((names, v, near))

        def run(batches, given=given):
            names, v, near = given.value
            width = words.shape[2]
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                keys, cells = batch.column(0), batch.column(2).to_numpy()
                for cell in np.unique(cells):
                    here = np.flatnonzero(cells == cell)
                    who = np.flatnonzero((near == cell).any(axis=1))
                    for first in range(0, len(who), 256):
                        some = who[first : first + 256]
                        table = np.einsum("qjw,jcw->qjc", v[some].reshape(len(some), -1, width), words)
                        scores = np.repeat((v[some] @ centres[cell])[:, None], len(here), axis=1)
                        for j in range(codes.shape[1]):
                            scores += table[:, j, :][:, codes[here, j]]
                        top = np.argsort(-scores, axis=1, kind="stable")[:, : candidates + 1]
                        rows = np.repeat(np.arange(len(some)), top.shape[1])
                        at = here[top.ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array([names[some[r]] for r in rows]), keys.take(pa.array(at)), pa.array(np.full(len(at), cell), pa.int32()), pa.array(np.take_along_axis(scores, top, 1).ravel())], ["query", key, "cell", "about"])

        codes = index.table("codes", "code binary").filter(F.col("cell").isin(wanted))
        best = codes.mapInArrow(run, f"query {kind}, {key} {index.key_type}, cell int, about double").filter(~F.col(key).eqNullSafe(F.col("query")))
        best = top_of(best, ["query"], [F.col("about").desc(), key], candidates).drop("rank", "about")
        vectors = index.table("vectors", "v array<double>").filter(F.col("cell").isin(wanted)).select(F.col("cell").alias("c"), F.col(key).alias("k"), "v")
        met = best.join(vectors, (F.col("cell") == F.col("c")) & F.col(key).eqNullSafe(F.col("k"))).select("query", key, "v")
        met = met.join(asked.select(F.col("query").alias("q"), F.col("v").alias("w")), F.col("query") == F.col("q")).withColumn("score", similarity.cosine(F.col("v"), F.col("w")))
        out = met if threshold is None else met.filter(F.col("score") >= threshold)
        out = top_of(out.select("query", key, "score"), ["query"], [F.round("score", 9).desc(), key], limit)
        found = out if found is None else found.unionByName(out)
    return found


def search_as(index: VectorIndex, points: DataFrame, queries: DataFrame, collection: Collection, *, column: str = "embedding", **changes) -> DataFrame:
    """search as a collection says: by all vectors if it says exact or there are fewer points than its full_scan_threshold, otherwise by its probes."""
    c = collection.having(**changes)
    if c.exact or index.count < c.full_scan_threshold:
        out = search_many(points, queries, limit=c.limit, metric="Cosine", key=index.key, column=column)
        return out if c.threshold is None else out.filter(F.col("score") >= c.threshold)
    return search(index, queries, probes=c.probes, limit=c.limit, threshold=c.threshold)
