"""Operational metrics over a task log: one pass of aggregation each, no task-by-task loops.

Task log columns: task_id, ts, agent, capability, failed, latency, tokens, model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(flag: Column, digits: int = 1) -> Column:
    """Share of true values in percent, 0 without rows."""
    return F.coalesce(F.round(F.count_if(flag) * 100.0 / F.nullif(F.count("*"), F.lit(0)), digits), F.lit(0.0))


def task_rates(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("succeeded"), percent(~F.col("failed")).alias("success_pct"), percent(F.col("failed")).alias("failure_pct"))


def capability_rates(log: DataFrame) -> DataFrame:
    return log.groupBy("capability").agg(F.count("*").alias("runs"), percent(~F.col("failed")).alias("success_pct"))


def latency_stats(log: DataFrame) -> DataFrame:
    """Mean and p95 by capability; p95 is the value of rank floor(0.95 n), at least 1.

    Equal values are counted before the window, so a group holds distinct values only.
    """
    counted = log.where("latency is not null").groupBy("capability", "latency").agg(F.count("*").alias("n"))
    group = Window.partitionBy("capability")
    ranked = counted.withColumns({"upto": F.sum("n").over(group.orderBy("latency").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    rank = F.greatest(F.lit(1), F.floor(F.col("total") * 95 / 100))
    mean = F.sum(F.col("latency") * F.col("n")) / F.sum("n")
    return ranked.groupBy("capability").agg(F.round(mean, 4).alias("mean_latency"), F.min(F.when(F.col("upto") >= rank, F.col("latency"))).alias("p95_latency"))


def usage_totals(log: DataFrame, cached: Column) -> DataFrame:
    """Calls and tokens by model; a cached call adds no tokens."""
    return log.groupBy("model").agg(F.count("*").alias("calls"), F.count_if(cached).alias("cached_calls"), F.coalesce(F.sum(F.when(~cached, F.col("tokens"))), F.lit(0)).alias("tokens"))


def cost_ledger(log: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    """Tokens priced per million by the model's own price, its family's, or the default."""
    used = log.groupBy("model").agg(F.sum("tokens").alias("tokens"))
    name = F.lower("model")
    known = used.join(F.broadcast(prices.select(F.col("name").alias("full"), F.col("price").alias("own"))), name == F.col("full"), "left")
    known = known.join(F.broadcast(prices.select(F.col("name").alias("tail"), F.col("price").alias("family"))), F.element_at(F.split(name, "/"), -1) == F.col("tail"), "left")
    price = F.coalesce("own", "family", F.lit(default))
    return known.select("model", "tokens", F.round(F.col("tokens") / 1e6 * price, 6).alias("cost"))


def backlog_by_capability(log: DataFrame, queued: Column, idle: Column, limit: int = 20, deep: int = 5) -> DataFrame:
    """Queue length, agents and idle agents by capability, and the scaling decision."""
    out = log.groupBy("capability").agg(F.count_if(queued).alias("queue"), F.count_distinct("agent").alias("instances"), F.count_distinct(F.when(idle, F.col("agent"))).alias("idle"))
    wanted = (F.col("queue") > deep) & (F.col("idle") == 0)
    return out.withColumn("decision", F.when(wanted & (F.col("instances") < limit), "scale_up").when(wanted, "blocked").otherwise("hold"))


def tournament_scores(rankings: DataFrame) -> DataFrame:
    """Points (size - position) and wins by player; rankings: (game, player, position from 1, size)."""
    return rankings.groupBy("player").agg(F.sum(F.col("size") - F.col("position")).alias("points"), F.count_if(F.col("position") == 1).alias("wins"))


def stability_flag(rankings: DataFrame) -> DataFrame:
    """Players that win at least half of their games."""
    return rankings.groupBy("player").agg(F.count("*").alias("games"), F.count_if(F.col("position") == 1).alias("wins")).withColumn("stable", F.col("wins") * 2 >= F.col("games"))


def eval_gate(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.agg(F.round(F.avg("score"), 6).alias("mean_score"), (F.avg("score") >= threshold).alias("passed"))


def verified_chain_count(steps: DataFrame, least: int = 3, longest: int = 5) -> DataFrame:
    """Chains of steps without immediate repeats (first ``longest``), counted over keys; steps: (key, ts, tie, step)."""
    order = Window.partitionBy("key").orderBy("ts", "tie")
    changed = steps.withColumn("before", F.lag("step").over(order)).where("before is null or before <> step")
    kept = changed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= longest)
    chains = kept.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda s: s["step"]), ">").alias("chain"))
    return chains.groupBy("chain").agg(F.count("*").alias("n")).withColumn("verified", F.col("n") >= least)
