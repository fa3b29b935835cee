"""Pages of a large table by cursor: files of ascending keys, their bounds, and columns that are read only where asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PagedTable:
    """A table written in order of a key, with the least and the greatest key of each file. Rows without a key are left out."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def write(cls, rows: DataFrame, path: str, key: str, *, rows_per_file: int = 100_000) -> PagedTable:
        """Writes rows by ranges of the key; a range that is larger than a file becomes several, in order."""
        out = cls(rows.sparkSession, path, key)
        dealt = rows.filter(F.col(key).isNotNull()).repartitionByRange(key).sortWithinPartitions(key)
        dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{out.path}/rows")
        files = out.spark.read.parquet(f"{out.path}/rows").select(F.col(key).alias("k"), F.input_file_name().alias("file"))
        bounds = files.groupBy("file").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
        bounds.coalesce(1).sortWithinPartitions("low").write.mode("overwrite").parquet(f"{out.path}/bounds")
        return out

    def files(self, cursor, size: int) -> list[str]:
        """The files that can hold the next `size` rows behind a cursor: from the one where it stands, until those wholly behind it hold enough."""
        bounds = self.spark.read.parquet(f"{self.path}/bounds")
        ahead = bounds if cursor is None else bounds.filter(F.col("high") > F.lit(cursor))
        found, held, last = [], 0, None
        for r in ahead.orderBy("low", "high").toLocalIterator():
            if held >= size and r["low"] > last:
                break
            found.append(r["file"])
            if cursor is None or r["low"] > cursor:
                held += r["n"]
                last = r["high"] if last is None else max(last, r["high"])
        return found

    def page(self, cursor=None, size: int = 100, *, without: tuple[str, ...] = ()) -> tuple[DataFrame, object]:
        """The next rows behind the cursor, in order of the key, and the cursor behind them, None at the end.

        A page has `size` rows, and more only where rows share its last key, so no row is lost between two pages. Columns in `without`, as vectors that are
        not asked for, are not read, and neither are files that hold no row of the page.
        """
        files = self.files(cursor, size)
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not files:
            return self.spark.createDataFrame([], schema).drop(*without), None
        rows = self.spark.read.schema(schema).parquet(*files).drop(*without)
        rows = rows if cursor is None else rows.filter(F.col(self.key) > F.lit(cursor))
        last = rows.select(self.key).orderBy(self.key).limit(size).agg(F.max(self.key)).first()[0]
        if last is None:
            return rows.limit(0), None
        page = rows.filter(F.col(self.key) <= F.lit(last)).orderBy(self.key)
        more = self.spark.read.parquet(f"{self.path}/bounds").filter(F.col("high") > F.lit(last)).limit(1).count()
        return page, last if more else None

    def scroll(self, size: int = 100, **options):
        """All pages, one after the other."""
        cursor, more = None, True
        while more:
            page, cursor = self.page(cursor, size, **options)
            yield page
            more = cursor is not None
