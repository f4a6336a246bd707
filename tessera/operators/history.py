"""Windows over histories: latest states, streaks, health, as-of lookups, conversations.

Windows are partitioned by key; ties are broken by an id, so results do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key with their rank; the limit is applied before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def latest_state_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("s")).select(*keys, "s.*")


def failure_streak(df: DataFrame, key: str, failed: Column, limit: int) -> DataFrame:
    """Consecutive failures up to each row and whether the key is unhealthy; a success resets."""
    order = Window.partitionBy(key).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumns({"bad_": failed.cast("int"), "island_": F.sum((~failed).cast("int")).over(order)})
    streak = F.sum("bad_").over(Window.partitionBy(key, "island_").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", streak).withColumn("unhealthy", F.col("streak") >= limit).drop("bad_", "island_")


def restart_quarantine(df: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Restarts of the key in the time before each restart; quarantined from the limit on."""
    span = Window.partitionBy(key).orderBy("micros").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("restarts", F.count("*").over(span)).withColumn("quarantined", F.col("restarts") >= limit).drop("micros")


def heartbeat_gap(df: DataFrame, key: str, seconds: float) -> DataFrame:
    """Seconds to the next heartbeat of the key and whether the gap counts as dead."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (F.lead(micros).over(order) - micros) / 1e6
    return df.withColumn("gap", F.round(gap, 3)).withColumn("dead", F.coalesce(gap > seconds, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, key: str, value: str, ttl_seconds: float) -> DataFrame:
    """The latest right value at or before each left row of the key, null beyond the time to live.

    Union and one window instead of a range join: (id, key, ts) and (key, ts, value), one shuffle.
    """
    a = left.select("id", key, "ts", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    b = right.select(F.lit(None).cast("long").alias("id"), key, "ts", value, F.lit(0).alias("side"))
    order = Window.partitionBy(key).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("side") == 0, F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col(value).alias("v")))
    found = a.unionByName(b).withColumn("hit", F.last(hit, True).over(order)).where("side = 1")
    fresh = F.unix_micros(F.col("ts").cast("timestamp")) - F.col("hit.at") <= int(ttl_seconds * 1_000_000)
    return found.select("id", key, "ts", F.when(fresh, F.col("hit.v")).alias(value))


def conversation_list(messages: DataFrame) -> DataFrame:
    """By conversation: messages, last turn, first and last text."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.min_by("text", "turn").alias("first_text"), F.max_by("role", "turn").alias("last_role"))


def conversation_context(messages: DataFrame, limit: int = 4, chars: int = 60) -> DataFrame:
    """The last messages of each conversation in order, each cut, as one text."""
    newest = keep_last_n(messages, ["conv_id"], ["turn"], limit)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", F.substring("text", 1, chars)).alias("t"))))
    return newest.groupBy("conv_id").agg(parts.alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("context"))


def context_precision(verdicts: DataFrame, key: str, order: str, relevant: str) -> DataFrame:
    """Mean over the relevant places of precision at that place."""
    window = Window.partitionBy(key).orderBy(order)
    at = F.sum(F.col(relevant)).over(window.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(window)
    return verdicts.withColumn("p", at).where(F.col(relevant) == 1).groupBy(key).agg(F.round(F.avg("p"), 6).alias("context_precision"))


def acl_allowed(users: DataFrame, positions: DataFrame, refs: DataFrame) -> DataFrame:
    """(user_id, kb_id) pairs a user may see: user -> position -> controlled item."""
    return users.join(positions, "position_id").join(refs, "position_id").select("user_id", "kb_id").distinct()


def acl_filter(items: DataFrame, allowed: DataFrame, refs: DataFrame) -> DataFrame:
    """Items (user_id, kb_id) that are uncontrolled, or controlled and allowed."""
    free = items.join(refs.select("kb_id").distinct(), "kb_id", "left_anti")
    return free.select("user_id", "kb_id").unionByName(items.join(allowed, ["user_id", "kb_id"], "left_semi").select("user_id", "kb_id"))
