"""Pieces that the training-data operators share."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters; everything else is part of a word.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast by hint. Larger ones are left to a shuffled join.
BROADCAST_ROWS = 200_000


def shipped(module: str) -> None:
    """Send the module's functions to workers by value: executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Array of the text's words, in order."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it one that df doesn't have; Spark tells no case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise as it is, so that the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, one of our own, but only if driver and executors are one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "/tmp/checkpoints/brackwater"
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


class Scratch:
    """Tables that cut lineage: written as Parquet in the shared folder, so they outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one table, or all of them: at the end of the program, or once nothing reads it any more."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its owner clears the shared folder
            return


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 64 << 20) -> None:
    """Texts go to Python in batches of at most so many rows and bytes, or of one text that is longer. The session's settings are lowered, never raised, and stay so, as plans run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        now = int(now.lower().removesuffix("b")) if now.lower().removesuffix("b").lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
