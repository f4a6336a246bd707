"""Metrics, history, health and access queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.operators import metrics as M
from tessera.plans.binding import LOG_SQL, Plans, task_log

P = Plans()
PCT = "coalesce(round(count(*) FILTER ({0}) * 100.0 / nullif(count(*), 0), {1}), 0.0)"

P.add("task_rates", lambda r: M.task_rates(task_log(r)), f"{LOG_SQL} SELECT count(*) AS total, count(*) FILTER (NOT failed) AS succeeded, {PCT.format('NOT failed', 1)} AS success_pct, {PCT.format('failed', 1)} AS failure_pct FROM log")
P.add("capability_rates", lambda r: M.capability_rates(task_log(r)), f"{LOG_SQL} SELECT capability, count(*) AS runs, {PCT.format('NOT failed', 1)} AS success_pct FROM log GROUP BY capability")
P.add("latency_stats", lambda r: M.latency_stats(task_log(r)), f"""{LOG_SQL}, s AS (SELECT capability, latency, row_number() OVER (PARTITION BY capability ORDER BY latency) AS rn, count(*) OVER (PARTITION BY capability) AS n FROM log WHERE latency IS NOT NULL)
SELECT capability, round(avg(latency), 4) AS mean_latency, max(latency) FILTER (rn = greatest(1, CAST(floor(95 * n / 100) AS BIGINT))) AS p95_latency FROM s GROUP BY capability""")
P.add("usage_totals", lambda r: M.usage_totals(task_log(r), F.col("tokens") % 5 == 0), f"{LOG_SQL} SELECT model, count(*) AS calls, count(*) FILTER (tokens % 5 = 0) AS cached_calls, CAST(coalesce(sum(tokens) FILTER (tokens % 5 <> 0), 0) AS BIGINT) AS tokens FROM log GROUP BY model")
PRICES = [("click", 0.3), ("view", 0.6), ("purchase", 1.2)]
P.add("cost_ledger", lambda r: M.cost_ledger(task_log(r), r("events").sparkSession.createDataFrame(PRICES, "name string, price double"), 2.0), f"""{LOG_SQL}, price(name, price) AS (VALUES ('click', 0.3), ('view', 0.6), ('purchase', 1.2))
SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, round(CAST(sum(tokens) AS DOUBLE) / 1e6 * CAST(coalesce(max(price.price), 2.0) AS DOUBLE), 6) AS cost FROM log LEFT JOIN price ON lower(model) = price.name GROUP BY model""")
P.add("backlog_by_capability", lambda r: M.backlog_by_capability(task_log(r), F.col("model") == "view", F.col("model") == "signup"), f"""{LOG_SQL}, b AS (SELECT capability, count(*) FILTER (model = 'view') AS queue, count(DISTINCT agent) AS instances, count(DISTINCT agent) FILTER (model = 'signup') AS idle FROM log GROUP BY capability)
SELECT *, CASE WHEN queue > 5 AND idle = 0 AND instances < 20 THEN 'scale_up' WHEN queue > 5 AND idle = 0 THEN 'blocked' ELSE 'hold' END AS decision FROM b""")


def rankings(r):
    """Every hour of the log is a game; its players are ranked by their best value."""
    best = task_log(r).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("game"), F.col("capability").alias("player")).agg(F.max("latency").alias("v"))
    order = Window.partitionBy("game")
    return best.withColumns({"position": F.row_number().over(order.orderBy(F.desc("v"), "player")), "size": F.count("*").over(order)})


GAMES = f"{LOG_SQL}, best AS (SELECT date_trunc('hour', ts) AS game, capability AS player, max(latency) AS v FROM log GROUP BY 1, 2), ranked AS (SELECT player, row_number() OVER (PARTITION BY game ORDER BY v DESC, player) AS position, count(*) OVER (PARTITION BY game) AS size FROM best)"
P.add("tournament_scores", lambda r: M.tournament_scores(rankings(r)), f"{GAMES} SELECT player, CAST(sum(size - position) AS BIGINT) AS points, count(*) FILTER (position = 1) AS wins FROM ranked GROUP BY player")
P.add("stability_flag", lambda r: M.stability_flag(rankings(r)), f"{GAMES} SELECT player, count(*) AS games, count(*) FILTER (position = 1) AS wins, count(*) FILTER (position = 1) * 2 >= count(*) AS stable FROM ranked GROUP BY player")

P.add("eval_gate", lambda r: M.eval_gate(r("labels").select(F.col("quality").alias("score")), 0.8), "SELECT round(avg(quality), 6) AS mean_score, avg(quality) >= 0.8 AS passed FROM labels")
P.add("fraction_true", lambda r: r("labels").groupBy((F.col("doc_id") % 10).alias("answer")).agg(F.round(F.avg("quality"), 6).alias("share"), F.count("*").alias("n")), "SELECT doc_id % 10 AS answer, round(avg(quality), 6) AS share, count(*) AS n FROM labels GROUP BY 1")
P.add("verified_chain_count", lambda r: M.verified_chain_count(r("events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("tie"), F.col("event_type").alias("step"))), """WITH s AS (SELECT user_id AS key, ts, event_id, event_type AS step, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS place FROM s WHERE before IS NULL OR before <> step),
c AS (SELECT key, string_agg(step, '>' ORDER BY place) AS chain FROM k WHERE place <= 5 GROUP BY key) SELECT chain, count(*) AS n, count(*) >= 3 AS verified FROM c GROUP BY chain""")
P.add("project_counts", lambda r: r("orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("tasks")), "SELECT o_custkey AS project, count(*) AS tasks FROM orders GROUP BY 1")

P.add("keep_last_n", lambda r: H.keep_last_n(r("events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 50), "SELECT * FROM (SELECT user_id, ts, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 50")
P.add("latest_state_per_key", lambda r: H.latest_state_per_key(r("events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]), "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
P.add("history_upsert", lambda r: H.latest_state_per_key(r("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]), "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
P.add("circuit_state", lambda r: H.failure_streak(task_log(r).select("id", "agent", "ts", "failed"), "agent", F.col("failed"), 2), f"""{LOG_SQL}, s AS (SELECT id, agent, ts, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY agent ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM log), t AS (SELECT id, agent, ts, failed, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY agent, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM s) SELECT *, streak >= 2 AS unhealthy FROM t""")
P.add("idle_streak", lambda r: H.failure_streak(task_log(r).select("id", "agent", "ts", (F.col("tokens") < 40).alias("empty")), "agent", F.col("empty"), 3).groupBy("agent").agg(F.max("streak").alias("longest"), F.count_if("unhealthy").alias("checks_over")), f"""{LOG_SQL}, s AS (SELECT id, agent, ts, tokens < 40 AS e, sum(CASE WHEN tokens < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY agent ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM log), t AS (SELECT agent, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY agent, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS streak FROM s) SELECT agent, CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (streak >= 3) AS checks_over FROM t GROUP BY agent""")
P.add("restart_quarantine", lambda r: H.restart_quarantine(r("events").where("event_type = 'signup'").select("event_id", "user_id", "ts"), "user_id", 86_400, 3), "SELECT event_id, user_id, ts, count(*) OVER w AS restarts, count(*) OVER w >= 3 AS quarantined FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)")
P.add("heartbeat_gap", lambda r: H.heartbeat_gap(r("events").select(F.col("event_id").alias("id"), "user_id", "ts"), "user_id", 7200), "SELECT id, user_id, ts, round(g / 1e6, 3) AS gap, coalesce(g / 1e6 > 7200, false) AS dead FROM (SELECT event_id AS id, user_id, ts, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS g FROM events)")


def as_of_query(r, ttl):
    e = r("events")
    asked = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("user_id").alias("k"), "ts")
    stored = e.where("event_type = 'purchase'").select(F.col("user_id").alias("k"), "ts", "value")
    return H.as_of(asked, stored.groupBy("k", "ts").agg(F.max("value").alias("value")), "k", "value", ttl)


AS_OF = "WITH stored AS (SELECT user_id AS k, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), asked AS (SELECT event_id AS id, user_id AS k, ts FROM events WHERE event_type = 'view') SELECT a.id, a.k, a.ts, CASE WHEN epoch_us(a.ts) - epoch_us(s.ts) <= {0} THEN s.value END AS value FROM asked a ASOF LEFT JOIN stored s ON a.k = s.k AND a.ts >= s.ts"
P.add("cached_result_asof", lambda r: as_of_query(r, 86_400), AS_OF.format(86_400_000_000))
P.add("conversation_list", lambda r: H.conversation_list(r("conversations")), "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_min(text, turn) AS first_text, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
P.add("conversation_context", lambda r: H.conversation_context(r("conversations").select("conv_id", "turn", "role", "text")), "SELECT conv_id, string_agg(role || ': ' || substr(text, 1, 60), chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id")
P.add("first_last_per_group", lambda r: r("conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by(F.char_length("text"), "turn").alias("last_chars")), "SELECT conv_id, arg_min(role, turn) AS first_role, CAST(arg_max(length(text), turn) AS INTEGER) AS last_chars FROM conversations GROUP BY conv_id")
P.add("context_precision", lambda r: H.context_precision(r("labels").withColumn("answer", F.col("doc_id") % 50), "answer", "doc_id", "quality"), "WITH p AS (SELECT doc_id % 50 AS answer, quality, sum(quality) OVER w / row_number() OVER w AS p FROM labels WINDOW w AS (PARTITION BY doc_id % 50 ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT answer, round(avg(p), 6) AS context_precision FROM p WHERE quality = 1 GROUP BY answer")
P.add("recent_tasks", lambda r: r("orders").select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50), "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
P.add("stream_stale_timeout", lambda r: r("orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")), "FAILED").otherwise(F.col("o_orderstatus")).alias("status")), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'FAILED' ELSE o_orderstatus END AS status FROM orders")
P.add("poison_except", lambda r: r("events").select("user_id", "event_type").distinct().join(r("events").where("event_type = 'error'").select("user_id").distinct(), "user_id", "left_anti"), "SELECT DISTINCT user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")


def acl_query(r):
    refs = r("nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("kb_id")).where("(n_nationkey + kb_id) % 3 = 0 and kb_id <> 4").select(F.col("n_nationkey").alias("position_id"), "kb_id")
    users = r("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("position_id"))
    positions = r("nation").select(F.col("n_nationkey").alias("position_id"))
    items = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("kb_id"))
    return H.acl_filter(items, H.acl_allowed(users, positions, refs), refs)


P.add("acl_join", acl_query, "WITH refs AS (SELECT n_nationkey AS position_id, r_regionkey AS kb_id FROM nation, region WHERE (n_nationkey + r_regionkey) % 3 = 0 AND r_regionkey <> 4), items AS (SELECT c_custkey AS user_id, c_nationkey AS position_id, r_regionkey AS kb_id FROM customer, region) SELECT user_id, CAST(kb_id AS INTEGER) AS kb_id FROM items i WHERE kb_id NOT IN (SELECT kb_id FROM refs) OR EXISTS (SELECT 1 FROM refs WHERE refs.position_id = i.position_id AND refs.kb_id = i.kb_id)")
P.add("result_cost_enrich", lambda r: r("orders").select("o_orderkey", "o_orderstatus").join(r("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("cost")), "o_orderkey", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0))), "SELECT o_orderkey, o_orderstatus, coalesce(cost, 0.0) AS cost FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")

QUERIES, ORACLES = P.queries, P.oracles
