"""Metrics queries over events and orders, change detection, and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..operators.store import top_of
from ..session import table
from .registry import query

E = "WITH e AS (SELECT event_id, ts, event_type AS agent, user_id, value AS latency, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, round(CAST(json_extract(props, '$.k') AS BIGINT) * 2e-6, 6) AS cost FROM events)"


def events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("agent"), "user_id", F.col("value").alias("latency"), k.alias("tokens"), F.round(k * F.lit(2e-6), 6).alias("cost"), F.lit(1).cast("bigint").alias("calls"))


@query(f"{E} SELECT agent, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, round(avg(latency), 2) AS avg_latency FROM e GROUP BY 1")
def agent_summary(spark, sf):
    return M.summary(events(spark, sf), "agent")


@query(f"{E} SELECT coalesce(agent, 'total') AS agent, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY ROLLUP (agent)")
def agent_summary_rollup(spark, sf):
    out = events(spark, sf).rollup("agent").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return out.withColumn("agent", F.coalesce("agent", F.lit("total")))


@query(f"{E} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, agent, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY 1, 2")
def hourly_series(spark, sf):
    return M.hourly(events(spark, sf)).groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "agent").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query(f"{E} SELECT agent, " + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM e GROUP BY 1")
def activity_heatmap_pivot(spark, sf):
    out = events(spark, sf).withColumn("h", F.hour("ts")).groupBy("agent").pivot("h", list(range(24))).agg(F.count(F.lit(1)))
    return out.select("agent", *[F.coalesce(F.col(str(h)), F.lit(0)).cast("bigint").alias(f"h{h}") for h in range(24)])


@query(f"{E} SELECT agent, round(quantile_cont(latency, 0.25), 4) AS q1, round(quantile_cont(latency, 0.5), 4) AS median, round(quantile_cont(latency, 0.75), 4) AS q3, round(avg(latency), 4) AS mean, round(stddev_pop(latency), 4) AS sd FROM e GROUP BY 1")
def latency_box_stats(spark, sf):
    return M.box(events(spark, sf), "agent", "latency").select("agent", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "mean", "sd")])


@query(f"{E} SELECT agent, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / sum(sum(tokens)) OVER (), 6) AS share FROM e GROUP BY 1")
def cost_share(spark, sf):
    return M.share(events(spark, sf), "agent", "tokens").withColumn("share", F.round("share", 6))


@query(f"{E} SELECT date_trunc('day', ts)::TIMESTAMP AS day, agent, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(sum(tokens)) OVER (PARTITION BY date_trunc('day', ts) ORDER BY agent) AS BIGINT) AS stack FROM e GROUP BY date_trunc('day', ts), agent")
def stacked_tokens(spark, sf):
    day = events(spark, sf).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "agent").agg(F.sum("tokens").alias("tokens"))
    return day.withColumn("stack", F.sum("tokens").over(Window.partitionBy("day").orderBy("agent")))


FUNNEL = "SELECT * FROM (VALUES (1, 'orders', (SELECT count(*) FROM orders)), (2, 'finished', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')), (3, 'large', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000))) AS t(ord, stage, n)"


@query(f"SELECT ord, stage, n, round(100.0 * n / first_value(n) OVER (ORDER BY ord), 4) AS percent FROM ({FUNNEL})")
def funnel(spark, sf):
    o = table(spark, sf, "orders")
    done = F.col("o_orderstatus") == "F"
    row = o.agg(F.count(F.lit(1)).alias("a"), F.count(F.when(done, 1)).alias("b"), F.count(F.when(done & (F.col("o_totalprice") > 100_000), 1)).alias("c"))
    stages = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("stage"), F.col(c).alias("n")) for k, s, c in ((1, "orders", "a"), (2, "finished", "b"), (3, "large", "c"))])).alias("x")).select("x.*")
    return M.funnel(stages).withColumn("percent", F.round("percent", 4))


@query(f"{E} SELECT hour(ts) BETWEEN 9 AND 17 AS peak, count(*) AS n, round(avg(latency), 4) AS latency FROM e GROUP BY 1")
def peak_hours(spark, sf):
    return events(spark, sf).groupBy(F.hour("ts").between(9, 17).alias("peak")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 4).alias("latency"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def last20_tail(spark, sf):
    return top_of(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_id", "user_id")


@query("SELECT o_orderpriority AS agent, count(*) AS executions, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes, round(coalesce(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 0), 6) AS success_rate FROM orders GROUP BY 1")
def success_rate(spark, sf):
    ok = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("agent")).agg(F.count(F.lit(1)).alias("executions"), ok.alias("successes"), F.round(M.rate(ok, F.count(F.lit(1))), 6).alias("success_rate"))


@query(f"{E} SELECT agent, count(*) FILTER (WHERE tokens % 3 <> 0) AS hits, count(*) FILTER (WHERE tokens % 3 = 0) AS misses, round(100.0 * count(*) FILTER (WHERE tokens % 3 <> 0) / count(*), 4) AS hit_rate FROM e GROUP BY 1")
def cache_hit_rate(spark, sf):
    hit = F.col("tokens") % 3 != 0
    return events(spark, sf).groupBy("agent").agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"), F.round(100 * F.avg(hit.cast("double")), 4).alias("hit_rate"))


@query("WITH c AS (SELECT p_brand AS type, p_partkey AS pos, p_size AS covered, p_partkey % 7 AS missed FROM part) SELECT type, round(max_by(100.0 * covered / (covered + missed), pos), 4) AS percent FROM c WHERE covered + missed > 0 GROUP BY 1")
def coverage_percent(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_brand").alias("type"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("covered"), (F.col("p_partkey") % 7).alias("missed")).filter("covered + missed > 0")
    return c.groupBy("type").agg(F.round(F.max_by(100 * F.col("covered") / (F.col("covered") + F.col("missed")), "pos"), 4).alias("percent"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS delta FROM orders")
def score_delta_lag(spark, sf):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - before, 4).alias("delta"))


@query("SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 10) GROUP BY 1")
def top10_avg(spark, sf):
    return top_of(table(spark, sf, "events"), ["user_id"], [F.col("value").desc(), "event_id"], 10).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query(f"{E} SELECT window_start, count(*) AS n, round(avg(latency), 4) AS latency FROM (SELECT *, unnest(range(date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS window_start FROM e) GROUP BY 1")
def rolling_two_days(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "2 days", "1 day")
    return events(spark, sf).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 4).alias("latency")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "latency")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def file_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


TREE_SQL = """WITH f AS (SELECT source || '/d' || (doc_id // 100 % 50) || '/p' || (doc_id // 5000) AS parent, 'f' || doc_id AS name, sha256(text) AS hash FROM documents),
a AS (SELECT regexp_replace(parent, '/[^/]*$', '') AS parent, regexp_extract(parent, '[^/]*$') AS name, parent AS path, h AS hash FROM (SELECT parent, sha256(array_to_string(list_transform(list_sort(list({'name': name, 'hash': hash})), lambda x: x.hash || x.name), '')) AS h FROM f GROUP BY 1)),
b AS (SELECT regexp_replace(parent, '/[^/]*$', '') AS parent, regexp_extract(parent, '[^/]*$') AS name, parent AS path, h AS hash FROM (SELECT parent, sha256(array_to_string(list_transform(list_sort(list({'name': name, 'hash': hash})), lambda x: x.hash || x.name), '')) AS h FROM a GROUP BY 1)),
c AS (SELECT parent AS path, parent AS name, sha256(array_to_string(list_transform(list_sort(list({'name': name, 'hash': hash})), lambda x: x.hash || x.name), '')) AS hash FROM b GROUP BY 1)
SELECT path, hash FROM a UNION ALL SELECT path, hash FROM b UNION ALL SELECT path, hash FROM c UNION ALL SELECT '' AS path, sha256(array_to_string(list_transform(list_sort(list({'name': name, 'hash': hash})), lambda x: x.hash || x.name), '')) AS hash FROM c"""


@query(TREE_SQL)
def dir_hash(spark, sf):
    from ..sources.files import tree_hashes

    k = F.col("doc_id")
    path = F.concat_ws("/", "source", F.concat(F.lit("d"), (F.floor(k / 100) % 50).cast("string")), F.concat(F.lit("p"), F.floor(k / 5000).cast("string")), F.concat(F.lit("f"), k.cast("string")))
    return tree_hashes(table(spark, sf, "documents").select(path.alias("path"), F.sha2("text", 256).alias("hash"))).filter("not is_file").select("path", "hash")


@query("""WITH old AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 5)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def changed_files(spark, sf):
    from ..sources.files import diff

    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    old = d.filter("path % 10 <> 3").select("path", F.sha2("text", 256).alias("hash"))
    new = d.filter("path % 10 <> 5").select("path", F.sha2(F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return diff(old, new)


@query(f"{E} SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, agent, count(*) AS n FROM e GROUP BY 1, 2")
def streaming_hourly(spark, sf):
    from ..streaming.windows import hourly_counts, run_to_table

    return run_to_table(hourly_counts(spark, f"{sf}/events.parquet"), ["hour", "agent"]).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "agent", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events) GROUP BY 1, 2")
def daily_users(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("day")).distinct()
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Card ' || substr(lpad(c_custkey::VARCHAR, 16, '4'), 1, 4) || '-XXXX-XXXX-' || substr(lpad(c_custkey::VARCHAR, 16, '4'), 13) AS masked, c_custkey FROM customer")
def masked_cards(spark, sf):
    card = F.lpad(F.col("c_custkey").cast("string"), 16, "4")
    return table(spark, sf, "customer").select(F.concat(F.lit("Card "), F.substring(card, 1, 4), F.lit("-XXXX-XXXX-"), F.substring(card, 13, 4)).alias("masked"), "c_custkey")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ledger_summary(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return rows.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
