"""Registers a query with its SQL twin; a query is a function of a table reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.io import table

Reader = Callable[[str], DataFrame]


class Plans:
    """Queries and oracles of one area."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Reader], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: build(lambda t: table(spark, sf_dir, t))
        if sql is not None:
            self.oracles[name] = sql


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows of which each is much work, dealt over as many tasks as a shuffle has: a small file is one task otherwise, and AQE would join small parts again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def task_log(read: Reader) -> DataFrame:
    """events as a task log."""
    return read("events").select(
        F.col("event_id").alias("task_id"), F.col("event_id").alias("id"), "ts", F.col("user_id").alias("agent"), (F.col("user_id") % 8).alias("capability"),
        (F.col("event_type") == "error").alias("failed"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").try_cast("long").alias("tokens"), F.col("event_type").alias("model"),
    )


#: The same in SQL, to be put before a query.
LOG_SQL = "WITH log AS (SELECT event_id AS task_id, event_id AS id, ts, user_id AS agent, user_id % 8 AS capability, event_type = 'error' AS failed, value AS latency, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, event_type AS model FROM events)"
