"""Queries over streams with state, tables that take upserts, stores that are emptied, and trees compared from the top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.versioned import VersionedTable, cleared
from ..schema import ENTITY
from ..session import new_folder, table
from ..sources import files
from ..streaming import state
from .graph_model import GRAPH_SQL, entities, relationships
from .registry import ORACLES, query

G = f"WITH {GRAPH_SQL} "


def in_turn(batches: list[DataFrame], streamed, folder: str, form: str = "parquet", **options) -> DataFrame | None:
    """The batches come into a folder one after the other; after each, `streamed` of that folder's stream goes on where it stopped."""
    out = None
    for batch in batches:
        (batch.write.mode("append").text if form == "text" else batch.write.mode("append").parquet)(f"{folder}/in")
        out = state.continued(streamed(state.incoming(batch.sparkSession, f"{folder}/in", batch.schema, form)), f"{folder}/out", **options)
    return out


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _halves(rows: DataFrame, at: str = "2024-01-16") -> list[DataFrame]:
    early = F.col("ts") < F.lit(at).cast("timestamp")
    return [rows.filter(early), rows.filter(~early)]


SCANS = "old AS (SELECT source || '/f' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT source || '/f' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 5)"


@query(f"WITH {SCANS} SELECT path, 'new' AS change, 1 AS scan FROM old UNION ALL SELECT coalesce(o.path, n.path), CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END, 2 FROM old o FULL JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash")
def streamed_changes(spark, sf):
    """Two scans of all documents as files, an hour apart; what each batch of the stream finds."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/f"), F.col("doc_id").cast("string")).alias("path"), "text")
    at = lambda hour: F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp").alias("scanned_at")
    old = d.filter("doc_id % 10 <> 3").select("path", F.sha2("text", 256).alias("hash"), at(1))
    new = d.filter("doc_id % 10 <> 5").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"), at(2))
    out = in_turn([old, new], state.file_changes, new_folder(spark, "scans"))
    first = F.unix_micros(F.lit("2024-01-01 01:00:00").cast("timestamp"))
    return out.select("path", "change", F.when((F.col("seen") == first) & (F.col("change") == "new"), 1).otherwise(2).alias("scan"))


@query(
    """WITH RECURSIVE stored AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
UNION ALL SELECT s.user_id, min(e.ts) FROM stored s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.ts + INTERVAL 1 HOUR GROUP BY s.user_id, s.ts)
SELECT user_id, lookups, lookups - misses AS hits FROM (SELECT user_id, count(*) AS lookups FROM events GROUP BY 1) JOIN (SELECT user_id, count(*) AS misses FROM stored GROUP BY 1) USING (user_id)"""
)
def timed_cache(spark, sf):
    """Each event looks up its user's entry, which lasts 3,600 seconds after a miss stored it."""
    rows = _events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("number"))
    out = in_turn(_halves(rows), state.timed_cache, new_folder(spark, "cache"))
    return out.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("lookups"), F.count(F.when(F.col("hit"), 1)).alias("hits"))


@query("SELECT window_end, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, unnest(range(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 25 HOUR, INTERVAL 1 HOUR)) AS window_end FROM events) GROUP BY 1")
def streamed_last_24_hours(spark, sf):
    summary = lambda rows: state.rolling(rows, [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")])
    out = in_turn(_halves(_events(spark, sf).select("ts", "value")), summary, new_folder(spark, "rolling"), keys=["window_end"])
    return out.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", F.round("mean", 6).alias("mean"))


@query("SELECT event_type AS store, count(*) AS ops, count(*) FILTER (WHERE user_id % 3 <> 0) AS hits, round(sum(value), 4) AS ms FROM events GROUP BY 1")
def streamed_counters(spark, sf):
    rows = _events(spark, sf).select("ts", F.col("event_type").alias("store"), "user_id", "value")
    measures = [F.count(F.lit(1)).alias("ops"), F.count(F.when(F.col("user_id") % 3 != 0, 1)).alias("hits"), F.sum("value").alias("ms")]
    out = in_turn(_halves(rows), lambda r: state.counters(r, measures, ("store",)), new_folder(spark, "counters"), keys=["store"])
    return out.select("store", "ops", "hits", F.round("ms", 4).alias("ms"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS who, min(ts) AS began, max(ts) AS ended, count(*) AS lines FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events)"""
)
def followed_sessions(spark, sf):
    """A log of all events, followed while it is written; sessions that are over."""
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("user_id").cast("string"), "event_type")
    logs = [half.select(line.alias("value")) for half in _halves(_events(spark, sf))]
    out = in_turn(logs, lambda r: state.sessions(r, r"^(\S+) (\d+) \w+$"), new_folder(spark, "log"), form="text")
    return out.select("who", F.col("start").cast("timestamp_ntz").alias("began"), F.col("end").cast("timestamp_ntz").alias("ended"), "lines")


def streamed_upserts(spark, sf):
    """Entities, changes of theirs and new ones as a stream into a table on disk, which is compacted between."""
    e = entities(spark, sf).select("id", "type", "name", "seq")
    changed = e.filter("seq % 7 = 0").select("id", "type", F.concat("name", F.lit("!")).alias("name"), (F.col("seq") + 5_000_000_000).alias("seq"))
    new = e.filter("type = 'Class'").withColumn("id", F.concat("id", F.lit("+")))
    folder = new_folder(spark, "upserts")
    held = VersionedTable(spark, f"{folder}/table", e.schema)
    in_turn([e, changed], lambda r: r, folder, put=held.put)
    held.compact()
    in_turn([new], lambda r: r, folder, put=held.put)
    return held.read()


query(ORACLES["entity_upsert_last_wins"])(streamed_upserts)


def _stored(spark, name: str, rows: DataFrame, keys: tuple[str, ...]) -> VersionedTable:
    held = VersionedTable(spark, new_folder(spark, name), rows.schema, keys=keys)
    held.put(rows, 0)
    return held


@query(G + "SELECT 'entities' AS store, 'success' AS status, (SELECT count(*) FROM entities) AS removed, CAST(0 AS BIGINT) AS left UNION ALL SELECT 'relationships', 'success', count(*), 0 FROM (SELECT DISTINCT source_id, target_id, rel_type FROM relationships) UNION ALL SELECT 'vectors', 'success', count(*), 0 FROM embeddings UNION ALL SELECT 'cache', 'success', count(DISTINCT user_id), 0 FROM events")
def stores_cleared(spark, sf):
    """The graph, the vectors and the cache written as tables and emptied; what is left is counted after."""
    one = F.lit(1).cast("long").alias("seq")
    stores = {
        "entities": _stored(spark, "entities", entities(spark, sf).select("id", "type", "name", "project_id", "seq"), ("id",)),
        "relationships": _stored(spark, "relationships", relationships(spark, sf).select("source_id", "target_id", "rel_type", one), ("source_id", "target_id", "rel_type")),
        "vectors": _stored(spark, "vectors", table(spark, sf, "embeddings").select("vec_id", "embedding", one), ("vec_id",)),
        "cache": _stored(spark, "cache", table(spark, sf, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("seq")), ("key",)),
    }
    return cleared(spark, stores)


@query(G + "SELECT 'entities' AS store, 'success' AS status, count(*) FILTER (WHERE project_id = 'BUILDING') AS removed, count(*) FILTER (WHERE project_id IS DISTINCT FROM 'BUILDING') AS left FROM entities")
def project_cleared(spark, sf):
    held = VersionedTable(spark, new_folder(spark, "entities"), ENTITY)
    held.put(entities(spark, sf), 0)
    return cleared(spark, {"entities": held}, project_id="BUILDING")


def _tree_path(k):
    return F.concat_ws("/", "source", F.concat(F.lit("d"), (F.floor(k / 100) % 50).cast("string")), F.concat(F.lit("p"), F.floor(k / 5000).cast("string")), F.concat(F.lit("f"), k.cast("string")))


@query(
    """WITH p AS (SELECT doc_id, text, source || '/d' || (doc_id // 100 % 50) || '/p' || (doc_id // 5000) || '/f' || doc_id AS path FROM documents),
old AS (SELECT path, sha256(text) AS hash FROM p WHERE doc_id % 211 <> 3), new AS (SELECT path, sha256(CASE WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END) AS hash FROM p WHERE doc_id % 211 <> 5)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash"""
)
def changed_below(spark, sf):
    """Two scans as trees of hashes, compared from the top: only directories whose hashes differ are opened."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(k, _tree_path(k).alias("path"), "text")
    old = d.filter("doc_id % 211 <> 3").select("path", F.sha2("text", 256).alias("hash"))
    new = d.filter("doc_id % 211 <> 5").select("path", F.sha2(F.when(k % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return files.changed_below(files.stored_tree(old), files.stored_tree(new))[0]
