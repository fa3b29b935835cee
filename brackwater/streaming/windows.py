"""Event-time windows and de-duplication over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream; its schema is read once."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def hourly_counts(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    rows = stream(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("agent"))
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "agent").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("hour"), "agent", "n")


def without_repeats(rows: DataFrame, keys: list[str], ts: str, within: str = "1 hour") -> DataFrame:
    """The first row of each key within the time that state is kept for."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def run_to_table(streaming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Everything that is there now, as a table in the shared folder. Rows are appended; with keys, which aggregations need, each batch writes the rows that changed, of which the last count."""
    spark = streaming.sparkSession
    path = new_folder(spark, "stream")
    write = streaming.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if not keys:
        write.outputMode("append").format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(streaming.schema).parquet(f"{path}/rows")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    write.outputMode("update").foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(streaming.schema.add("_batch", "long")).parquet(f"{path}/rows/batch=*")
    rest = [c for c in streaming.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("last")).select(*keys, "last.*")
