"""A table on disk that takes upserts: batches land as files by key range, the last write wins on read, and compaction rewrites touched ranges only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .store import conjunction


class VersionedTable:
    """Rows of a schema by keys; of equal keys the row of the largest `seq` counts, of equal ones that of the last batch.

    Folders: changes/batch=N/part=P holds a batch, rows/version=V/part=P compacted ranges, state/version=V says which version holds each range and up to which
    batch it counts. The state is written last, so a reader sees one version or the next, and what was broken off is written again. Keys are dealt
    to ranges by their hash. Null keys are a key; repeated rows are one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, *, keys: tuple[str, ...] = ("id",), seq: str = "seq", ranges: int = 32):
        schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        self.spark, self.path, self.schema, self.keys, self.seq, self.ranges = spark, path.rstrip("/"), schema, keys, seq, ranges

    def _numbers(self, folder: str, name: str) -> list[int]:
        """Numbers of the whole folders name=N below a folder."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        whole = [p.getName() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in whole if n.startswith(f"{name}="))

    def _remove(self, *folders: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for f in folders:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _state(self) -> tuple[int, int, dict[int, int]]:
        """The version, the last batch that it holds, and the version of each range that has rows."""
        versions = self._numbers("state", "version")
        if not versions:
            return 0, -1, {}
        rows = self.spark.read.schema("part int, version long, upto long").parquet(f"{self.path}/state/version={versions[-1]}").collect()
        return versions[-1], rows[0]["upto"], {r["part"]: r["version"] for r in rows if r["part"] is not None}

    def _commit(self, version: int, upto: int, held: dict[int, int]) -> None:
        rows = [(p, v, upto) for p, v in sorted(held.items())] or [(None, None, upto)]
        self.spark.createDataFrame(rows, "part int, version long, upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/version={version}")

    def _last(self, rows: DataFrame) -> DataFrame:
        """The row that counts of each key: a maximum, found in part before rows are shuffled, so that a hot key is no task of its own."""
        rest = [c for c in self.schema.names if c not in self.keys]
        kept = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(self.seq, "_batch")).alias("_row"))
        return kept.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.ranges)).cast("int")

    def put(self, batch: DataFrame, number: int) -> None:
        """Takes in a batch under its number. The same number again replaces what it wrote; one that has been compacted gives nothing."""
        if number <= self._state()[1]:
            return
        rows = self._last(batch.select(*self.schema.names).withColumn("_batch", F.lit(number).cast("long"))).withColumn("part", self._part())
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/changes/batch={number}")

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField("part", IntegerType())])

    def _load(self, wanted: set[int] | None = None) -> DataFrame:
        """All rows with the range and the batch that they came from; of the wanted ranges only, by reading their folders only."""
        _, upto, held = self._state()
        kind = self._stored()
        empty = self.spark.createDataFrame([], kind).withColumn("_batch", F.lit(-1).cast("long"))
        parts = []
        for version in sorted(set(held.values())):
            own = [p for p, v in held.items() if v == version and (wanted is None or p in wanted)]
            if own:
                root = f"{self.path}/rows/version={version}"
                parts.append(self.spark.read.schema(kind).option("basePath", root).parquet(*[f"{root}/part={p}" for p in own]).withColumn("_batch", F.lit(-1).cast("long")))
        for number in self._numbers("changes", "batch"):
            if number > upto:
                rows = self.spark.read.schema(kind).parquet(f"{self.path}/changes/batch={number}")
                rows = rows if wanted is None else rows.filter(F.col("part").isin(sorted(wanted)))
                parts.append(rows.withColumn("_batch", F.lit(number).cast("long")))
        return reduce(DataFrame.unionByName, parts, empty)

    def read(self) -> DataFrame:
        return self._last(self._load())

    def _rewrite(self, touched: set[int], keep: Column | None = None) -> None:
        version, _, held = self._state()
        batches = self._numbers("changes", "batch")
        upto = max([*batches, self._state()[1]])
        rows = self._last(self._load(touched))
        rows = rows if keep is None else rows.filter(F.coalesce(keep, F.lit(True)))
        path = f"{self.path}/rows/version={version + 1}"
        rows.withColumn("part", self._part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        left = {r["part"] for r in self.spark.read.schema(self._stored()).parquet(path).select("part").distinct().collect()}
        self._commit(version + 1, upto, {p: v for p, v in held.items() if p not in touched} | dict.fromkeys(left, version + 1))
        # What no state names any more goes after the new one is there.
        self._remove(*[f"changes/batch={n}" for n in batches], *[f"rows/version={v}/part={p}" for p, v in held.items() if p in touched])

    def _changed(self) -> set[int]:
        """The ranges that batches have come for since the last compaction."""
        upto = self._state()[1]
        new = [n for n in self._numbers("changes", "batch") if n > upto]
        rows = [self.spark.read.parquet(f"{self.path}/changes/batch={n}").select("part") for n in new]
        return {r["part"] for r in reduce(DataFrame.unionByName, rows).distinct().collect()} if rows else set()

    def compact(self) -> list[int]:
        """Rewrites the ranges that batches have come for, and returns which; all others stay as they lie."""
        touched = self._changed()
        if touched:
            self._rewrite(touched)
        return sorted(touched)

    def delete(self, where: Column) -> None:
        """Removes rows; ranges without one are not rewritten, unless a batch has come for them."""
        gone = {r["part"] for r in self._last(self._load()).filter(F.coalesce(where, F.lit(False))).select(self._part().alias("part")).distinct().collect()}
        if gone:
            self._rewrite(gone | self._changed(), ~F.coalesce(where, F.lit(False)))

    def clear(self, **wanted) -> dict[str, int]:
        """Removes all rows, or those of a project or type: how many there were and how many are left, both counted on disk."""
        before = self.read().count()
        if wanted:
            self.delete(conjunction(**wanted))
        else:
            version, upto, held = self._state()
            batches = self._numbers("changes", "batch")
            self._commit(version + 1, max([*batches, upto]), {})
            self._remove(*[f"changes/batch={n}" for n in batches], *[f"rows/version={v}" for v in set(held.values())])
        left = self.read().count()
        return {"removed": before - left, "left": left}


def cleared(spark: SparkSession, stores: dict[str, VersionedTable], **wanted) -> DataFrame:
    """(store, status, removed, left): every store emptied, or of rows that are wanted; one that fails says so, and the others are emptied all the same."""
    rows = []
    for name, held in stores.items():
        try:
            found = held.clear(**wanted)
            rows.append((name, "success", found["removed"], found["left"]))
        except Exception as e:  # noqa: BLE001  whatever a store fails of is its status
            rows.append((name, f"failed: {type(e).__name__}", 0, None))
    return spark.createDataFrame(rows, "store string, status string, removed long, left long")
