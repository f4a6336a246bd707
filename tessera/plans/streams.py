"""Streaming queries over the event table, with batch SQL twins where state is not custom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.io import shared_folder, table
from tessera.plans.binding import LOG_SQL
from tessera.sources import topics
from tessera.streaming import jobs as J
from tessera.streaming import observed as O
from tessera.streaming import stateful as S

QUERIES, ORACLES = {}, {}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return J.stream_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("key"), "ts", (F.col("user_id") % 8).alias("capability"), (kind == "error").alias("failed"), kind.alias("kind"), "value")


QUERIES["stream_task_metrics"] = lambda spark, d: J.drain_update(J.task_metrics(log(spark, d)), ["start", "capability"])
ORACLES["stream_task_metrics"] = f"{LOG_SQL} SELECT time_bucket(INTERVAL 30 SECOND, ts) AS start, capability, count(*) AS runs, count(*) FILTER (failed) AS failures FROM log GROUP BY 1, 2"
QUERIES["stream_summary_30s"] = lambda spark, d: J.drain_complete(log(spark, d).agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures"), F.max("ts").alias("last_ts")))
ORACLES["stream_summary_30s"] = f"{LOG_SQL} SELECT count(*) AS runs, count(*) FILTER (failed) AS failures, max(ts) AS last_ts FROM log"
#: What the stream has reached at its end, and rows of the queue in windows of an hour that are closed then.
MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
QUERIES["stream_backlog_alert"] = lambda spark, d: J.drain(S.backlog_and_idle(log(S.with_rocksdb(spark), d), F.col("kind") == "view", 3600, 1, 3))
ORACLES["stream_backlog_alert"] = f"""{LOG_SQL}, w AS (
  SELECT date_trunc('hour', ts) AS start, capability, count(*) FILTER (model = 'view') AS queue FROM log GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {MARK}
), b AS (
  SELECT *, coalesce(max(CASE WHEN queue > 0 THEN start END) OVER (PARTITION BY capability ORDER BY start), min(start) OVER (PARTITION BY capability) - INTERVAL 1 HOUR) AS busy FROM w
), i AS (SELECT start, capability, queue, CAST(date_diff('hour', busy, start) AS BIGINT) AS idle FROM b)
SELECT *, queue > 1 AS alert, idle > 0 AND idle % 3 = 0 AS shrink FROM i"""


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each user and kind of event, for the 300 users heard of last."""
    return S.merge_stream(log(spark, sf_dir).select("key", "kind", "ts", "id", "value"), "key", "kind", ["ts", "id"]).snapshot()


QUERIES["stream_state_merge"] = merged
ORACLES["stream_state_merge"] = """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS kind, ts, event_id AS id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM s WHERE key IN (SELECT key FROM s GROUP BY key ORDER BY max((ts, id)) DESC LIMIT 300)"""


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = log(spark, sf_dir).where("kind = 'click'").select("id", "key", "ts")
    results = log(spark, sf_dir).where("kind = 'purchase'").select(F.col("id").alias("result_id"), "key", "ts")
    return J.drain(S.lost_and_found(starts, results, 24))


QUERIES["stream_latency"] = latency
ORACLES["stream_latency"] = """WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'purchase'), j AS (
  SELECT a.event_id AS id, a.ts, b.event_id AS result_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS latency FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOUR
) SELECT id, result_id, latency FROM j WHERE result_id IS NOT NULL OR ts + INTERVAL 24 HOUR < least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 10 MINUTE"""
#: Pairs only.
QUERIES["stream_latency_pairs"] = lambda spark, d: J.drain(J.interval_join(log(spark, d).where("kind = 'click'").select("id", "key", "ts"), log(spark, d).where("kind = 'purchase'").select(F.col("id").alias("result_id"), "key", "ts"), 24))
ORACLES["stream_latency_pairs"] = "SELECT a.event_id AS id, b.event_id AS result_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS latency FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
QUERIES["stream_rate_limit"] = lambda spark, d: J.drain(J.keyed(log(spark, d), J.rate_limit(3, 86_400), 86_400))
QUERIES["stream_circuit"] = lambda spark, d: J.drain(J.keyed(log(spark, d), J.circuit(2, 86_400), 604_800))
QUERIES["stream_dedupe"] = lambda spark, d: J.drain(J.keyed(log(spark, d).withColumn("key", F.concat_ws("/", "key", "kind")), J.dedupe(43_200), 43_200))
QUERIES["stream_ttl_cache"] = lambda spark, d: J.drain(J.keyed(log(spark, d).withColumn("key", F.concat_ws("/", "key", "kind")), J.ttl_cache(43_200), 43_200))
QUERIES["topic_source"] = lambda spark, d: J.drain(J.topic_source(log(spark, d), ["click", "signup"], "^err", "kind").select("id", "kind", "ts"))
ORACLES["topic_source"] = "SELECT event_id AS id, event_type AS kind, ts FROM events WHERE event_type IN ('click', 'signup') OR event_type LIKE 'err%'"


def topic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of three segments, of which some channels are read as a stream."""
    path, events = shared_folder(spark), table(spark, sf_dir, "events")
    for part in range(3):
        topics.append(events.where(F.col("event_id") % 3 == part).select(F.col("event_type").alias("channel"), "ts", F.col("event_id").cast("string").alias("payload")), path)
    spark.dataSource.register(topics.TopicLog)
    stream = spark.readStream.format("topic_log").option("path", path).option("channels", "click,signup").option("pattern", "err.*").load()
    return J.drain(stream.select(F.col("payload").cast("long").alias("id"), F.col("channel").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("ts")))


QUERIES["topic_log"] = topic_log
ORACLES["topic_log"] = ORACLES["topic_source"]


def trigger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, failures and late rows of every trigger of the windowed metrics."""
    base = shared_folder(spark)
    run = lambda seen: J.task_metrics(seen).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    return O.counted(log(spark, sf_dir), run, failures=F.count_if("failed"))[1].drop("query")


QUERIES["stream_trigger_counts"] = trigger_counts
ORACLES["stream_trigger_counts"] = "SELECT 0::BIGINT AS trigger, count(*) AS rows, count(*) FILTER (event_type = 'error') AS failures, 0::BIGINT AS late FROM events"
QUERIES["summary_json_sink"] = lambda spark, d: J.drain_complete(log(spark, d).groupBy("kind").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures")), "json")
ORACLES["summary_json_sink"] = "SELECT event_type AS kind, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1"
QUERIES["stream_heartbeat"] = lambda spark, d: J.drain(S.worker_health(log(S.with_rocksdb(spark), d), 7200, 39_600, 3, 100_000))
ORACLES["stream_heartbeat"] = """WITH b AS (
  SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS "at", lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) AS beat, min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS first FROM events
), m AS (SELECT epoch_ms(max(ts)) / 1e3 - 600 AS mark FROM events), g AS (
  SELECT key, beat, coalesce(beat, mark) AS until, "at" + 7200 AS due, greatest("at" + 7200, first + 100000) AS start FROM b, m WHERE "at" + 7200 < coalesce(beat, mark)
), a AS (
  SELECT key, k, due, start + (k - 1) * 7200 AS "at" FROM g, range(1, 5) r(k) WHERE start + (k - 1) * 7200 < until
), r AS (
  SELECT *, lag("at", 3) OVER (PARTITION BY key ORDER BY "at") AS third, count(*) OVER (PARTITION BY key ORDER BY "at" RANGE BETWEEN 39600 PRECEDING AND CURRENT ROW) AS near FROM a
), q AS (SELECT key, min("at") AS "at" FROM r WHERE "at" - third < 39600 GROUP BY key), t AS (
  SELECT r.key, r."at", r.k, r.near, r."at" = q."at" AS last FROM r LEFT JOIN q USING (key) WHERE q."at" IS NULL OR r."at" <= q."at"
), dead AS (
  SELECT key, due AS "at", 'dead' AS status FROM g UNION ALL SELECT key, "at", 'dead' FROM t WHERE k > 1 UNION ALL SELECT key, beat, 'back' FROM g WHERE beat <= start
), seen AS (SELECT d.* FROM dead d LEFT JOIN q USING (key) WHERE q."at" IS NULL OR d."at" <= q."at")
SELECT key, "at", status, coalesce((SELECT arg_max(t.near, t."at") FROM t WHERE t.key = seen.key AND t."at" < seen."at"), 0) AS restarts FROM seen
UNION ALL SELECT key, "at", CASE WHEN coalesce(last, false) THEN 'quarantined' ELSE 'restarted' END, CASE WHEN coalesce(last, false) THEN near - 1 ELSE near END FROM t"""
QUERIES["stream_stale_tasks"] = lambda spark, d: J.drain(S.stale_tasks(log(S.with_rocksdb(spark), d).select("id", "key", "ts", F.col("kind").alias("status")), "view", 7200))
ORACLES["stream_stale_tasks"] = """WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events
) SELECT key, epoch_us(ts) / 1e6 + 7200 AS "at", 'FAILED' AS status FROM e WHERE event_type = 'view' AND ts + INTERVAL 2 HOUR < coalesce(later, (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""
#: Long gaps and keys that have fallen silent, without restarts.
QUERIES["stream_heartbeat_gap"] = lambda spark, d: J.drain(J.keyed(log(spark, d), J.heartbeat(7200), 864_000, alarm=7200))
ORACLES["stream_heartbeat_gap"] = """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 7200000000, false) AS flag FROM events
UNION ALL SELECT NULL, CAST(user_id AS VARCHAR), true FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 2 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
QUERIES["metrics_csv_sink"] = lambda spark, d: J.drain(log(spark, d).select("id", "kind", "value", "failed"), "csv")
ORACLES["metrics_csv_sink"] = "SELECT event_id AS id, event_type AS kind, value, event_type = 'error' AS failed FROM events"


def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a cut field, appended as JSON lines in two writes and read back."""
    path, events = shared_folder(spark), table(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", F.substring("props", 1, 6).alias("note"))
    rows.where("user_id % 2 = 0").write.mode("append").json(path)
    rows.where("user_id % 2 <> 0").write.mode("append").json(path)
    return spark.read.schema(rows.schema).option("mode", "DROPMALFORMED").json(path)


QUERIES["jsonl_append"] = jsonl_append
ORACLES["jsonl_append"] = "SELECT event_id, user_id, substr(props, 1, 6) AS note FROM events"
