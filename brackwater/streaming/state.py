"""Streams that remember a state for each key, and sinks that go on where they stopped."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, as state with timers needs; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def continued(streaming: DataFrame, folder: str, *, keys: list[str] | None = None, put=None) -> DataFrame | None:
    """Takes in what has come since the last call with this folder, and returns all rows put out so far.

    The folder holds the stream's checkpoint: rows that were taken in before, by this program or one that was stopped, are not taken in again. Rows are
    appended; with keys, which aggregations need, each batch writes the rows that changed, of which the last count. With put(rows, number of the batch) each
    batch goes there instead; a batch that was broken off comes again under its number.
    """
    spark = streaming.sparkSession
    write = streaming.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)

    def changed(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with keyed_state(spark):
        if put is not None:
            write.outputMode("update" if keys else "append").foreachBatch(put).start().awaitTermination()
            return None
        if keys is None:
            write.outputMode("append").format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
            return spark.read.schema(streaming.schema).parquet(f"{folder}/rows")
        write.outputMode("update").foreachBatch(changed).start().awaitTermination()
    rows = spark.read.schema(streaming.schema.add("_batch", "long")).parquet(f"{folder}/rows/batch=*")
    rest = [c for c in streaming.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("last")).select(*keys, "last.*")


def incoming(spark: SparkSession, folder: str, schema, form: str = "parquet") -> DataFrame:
    """The files that come into a folder, as a stream."""
    return spark.readStream.schema(schema).format(form).load(folder)


#: Parts that keys are dealt to by hash: a call of Python and a state for each part instead of each key.
PARTS = 2048


def _micros(times: pd.Series) -> list[int]:
    return times.to_numpy("datetime64[us]").astype("int64").tolist()


class FileChanges(StatefulProcessor):
    """For the paths of a part, the hash of the last scan that saw each. A scan moves the watermark, which tells paths that it did not see from the others."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "path array<string>, hash array<string>, seen array<long>")

    def _known(self) -> dict[str, tuple]:
        if not self.last.exists():
            return {}
        paths, hashes, seen = self.last.get()
        return dict(zip(paths, zip(hashes, seen)))

    def _keep(self, known: dict[str, tuple]) -> None:
        if known:
            self.last.update((list(known), [h for h, _ in known.values()], [s for _, s in known.values()]))
        else:
            self.last.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = self._known(), []
        timers = {s // 1000 + 1 for _, s in known.values()}
        found = sorted(((p, t, h) for part in rows for p, t, h in zip(part["path"].tolist(), _micros(part["scanned_at"]), part["hash"].tolist())), key=lambda x: (x[0], x[1], x[2] or ""))
        for path, seen, digest in found:
            before = known.get(path)
            if before is not None and seen <= before[1]:
                continue
            if before is None or before[0] != digest:
                out.append((path, "new" if before is None else "modified", seen))
            known[path] = (digest, seen)
        now = {s // 1000 + 1 for _, s in known.values()}
        for at in timers - now:
            self.handle.deleteTimer(at)
        for at in now - timers:
            self.handle.registerTimer(at)
        self._keep(known)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, over = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        gone = [(p, "deleted", s) for p, (_, s) in known.items() if s // 1000 < over]
        if gone:
            self._keep({p: x for p, x in known.items() if x[1] // 1000 >= over})
        yield _frame(gone)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"path": pd.Series([r[0] for r in rows], dtype=object), "change": pd.Series([r[1] for r in rows], dtype=object), "seen": pd.Series([r[2] for r in rows], dtype="int64")})


def file_changes(manifest: DataFrame) -> DataFrame:
    """A stream of scans, manifest(path, hash, scanned_at: one time for a scan), to (path, change, seen): new, modified, deleted, as batches come.

    Each path has the hash of the last scan that held it as state, wherever the path's rows are dealt; paths are dealt by hash to PARTS parts, whose states are read and written whole, as
    a scan holds most paths or else deletes them. A scan comes whole in one batch, later ones
    after it; a path that a later scan doesn't hold is deleted, which is known when that scan is over; `seen` is the time, in microseconds, of the
    scan that says so, or, of a deleted path, of the last that held it. Rows of a scan that has been taken in before give nothing, null paths neither; a null hash is a hash.
    """
    rows = manifest.filter("path is not null").select(F.pmod(F.xxhash64("path"), F.lit(PARTS)).alias("part"), "path", "hash", F.col("scanned_at").cast("timestamp").alias("scanned_at")).withWatermark("scanned_at", "0 seconds")
    return rows.groupBy("part").transformWithStateInPandas(FileChanges(), "path string, change string, seen long", "Append", "EventTime")


class TimedCache(StatefulProcessor):
    """For a key, when its value was stored. It counts until `live` microseconds later; then state goes, too."""

    def __init__(self, live: int):
        self.live = live

    def init(self, handle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at long")

    def _ends(self, at: int) -> int:
        return (at + self.live) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.stored.get()[0] if self.stored.exists() else None
        at, out = before, []
        for asked, number in sorted((int(t.value // 1000), int(n)) for part in rows for t, n in zip(part["ts"], part["number"])):
            hit = at is not None and at <= asked < at + self.live
            out.append((key[0], number, hit))
            if not hit and (at is None or asked > at):
                at = asked
        if at != before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(at))
            self.stored.update((at,))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stored.exists() and self._ends(self.stored.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.stored.clear()
        yield self._frame([])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([r[0] for r in rows], dtype=object), "number": pd.Series([r[1] for r in rows], dtype="int64"), "hit": pd.Series([r[2] for r in rows], dtype=bool)})


def timed_cache(lookups: DataFrame, *, seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """A stream of lookups(key, ts, number) to (key, number, hit): a lookup that finds nothing stores, and what is stored counts for so many seconds of event time.

    Lookups of a batch count in order of time, then number. One that comes `late` or less after a later one finds what is stored if that is not from after it, and
    stores nothing; later ones are left out. State goes when its time is over, so it holds the keys of the last seconds only. Null keys are a key; rows without a time are left out.
    """
    rows = lookups.filter("ts is not null and number is not null").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("number").cast("long").alias("number"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(TimedCache(seconds * 1_000_000), "key string, number long, hit boolean", "Append", "EventTime")


def rolling(rows: DataFrame, measures: list[Column], *, keys: tuple[str, ...] = (), ts: str = "ts", length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Summaries of the last `length` at every `slide`: window_end, keys, measures. Rows that come up to `late` after later ones still count, and change what was put out; others don't."""
    own = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = own.groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(*measures)
    return out.select(F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def counters(rows: DataFrame, measures: list[Column], keys: tuple[str, ...]) -> DataFrame:
    """Counts and sums of everything so far; each batch puts out the keys that it changed."""
    return rows.groupBy(*keys).agg(*measures)


def sessions(lines: DataFrame, pattern: str, *, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """A stream of log lines to sessions(who, start, end, lines): runs of one writer's lines with less than `gap` between them, each put out once, when no line can come that would make it longer.

    The pattern's first group is the time, the second who wrote; other lines are left out. A session is put together over as many batches as it lasts.
    """
    part = lambda k: F.regexp_extract("value", pattern, k)
    own = lines.filter(F.col("value").rlike(pattern)).select(part(1).try_cast("timestamp").alias("ts"), part(2).alias("who")).filter("ts is not null").withWatermark("ts", late)
    out = own.groupBy(F.session_window("ts", gap).alias("w"), "who").agg(F.max("ts").alias("end"), F.count(F.lit(1)).alias("lines"))
    return out.select("who", F.col("w.start").alias("start"), "end", "lines")
