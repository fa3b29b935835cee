"""Sessions and tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "brackwater", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; settings whose names hold dots go in by dict expansion."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Parquet filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset one of our own, if driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or "/tmp/checkpoints/brackwater").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table of its own in the shared folder, removed at the end of the program."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; its owner clears the shared folder
            return

    atexit.register(drop)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, cut from its lineage, and there for any executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 64 << 20) -> None:
    """Rows go to Python in batches of at most so many rows and bytes. The session's settings are lowered, never raised, and stay so, as plans run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().removesuffix("b")
        now = int(now) if now.lstrip("-").isdigit() else 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))
