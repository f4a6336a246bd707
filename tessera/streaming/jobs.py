"""Structured Streaming jobs over the event stream; each writes where Spark can read it back.

Event time is ``ts`` with a watermark of 10 minutes unless stated. The keyed jobs hold a short list of numbers for
each key: rows of a key that arrive in one trigger are handled in order of (ts, id); later triggers go on from there.
State of idle keys expires by event time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tessera.io import shared_folder

LATE = "10 minutes"
#: (state, seconds, failed) -> (next state, flag)
Step = Callable[[list[float], float, bool], tuple[list[float], bool]]


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder of them; new files are picked up as they arrive."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def drain(stream: DataFrame, form: str = "parquet") -> DataFrame:
    """Runs an append stream over all that is there and reads its output back."""
    spark, base = stream.sparkSession, shared_folder(stream.sparkSession)
    writer = stream.writeStream.format(form).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
    if form == "csv":
        writer = writer.option("header", "true")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("header", form == "csv").format(form).load(f"{base}/out")


def topic_source(stream: DataFrame, exact: list[str], pattern: str, channel: str = "channel") -> DataFrame:
    """Rows of the channels named or matched by the pattern; over Kafka the same is ``subscribe`` and ``subscribePattern``."""
    return stream.where(F.col(channel).isin(*exact) | F.col(channel).rlike(pattern))


def drain_complete(stream: DataFrame, form: str = "parquet") -> DataFrame:
    """Runs a stream of running totals; every trigger writes the whole result under its number, so a rerun overwrites itself."""
    spark, base, last = stream.sparkSession, shared_folder(stream.sparkSession), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(form).save(f"{base}/out/{number}")
        last[:] = [number]

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).format(form).load(f"{base}/out/{last[0]}")


def drain_update(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs a stream of running totals; every trigger writes only the rows that it changed, and the newest row of each key is read back.

    A trigger writes under its number, so a rerun overwrites itself; windows behind the watermark leave the state.
    """
    spark, base = stream.sparkSession, shared_folder(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    names = stream.columns
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    newest = F.max_by(F.struct(*[c for c in names if c not in keys]), "batch")
    return rows.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*").select(names)


def task_metrics(log: DataFrame, span: str = "30 seconds") -> DataFrame:
    """Runs and failures by window and capability."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", span).alias("w"), "capability").agg(F.count("*").alias("runs"), F.count_if("failed").alias("failures")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "capability", "runs", "failures")


def backlog_alert(log: DataFrame, waiting: Column, span: str, limit: int) -> DataFrame:
    """Rows that wait in each window and capability, and whether they pass the limit."""
    counts = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", span).alias("w"), "capability").agg(F.count_if(waiting).alias("queue"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "capability", "queue", (F.col("queue") > limit).alias("alert"))


def interval_join(starts: DataFrame, results: DataFrame, hours: int) -> DataFrame:
    """Starts (id, key, ts) and results (result_id, key, ts) of the same key within so many hours; state on both sides expires."""
    a = starts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).alias("a")
    b = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & F.col("b.ts").between(F.col("a.ts"), F.col("a.ts") + F.expr(f"interval {hours} hours")))
    return pairs.select("a.id", "b.result_id", F.round((F.unix_micros("b.ts") - F.unix_micros("a.ts")) / 1e6, 3).alias("latency"))


def state_merge(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key as a running state."""
    rest = [c for c in stream.columns if c not in keys and c not in order]
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("s")).select(*keys, "s.*")


def rate_limit(limit: int, seconds: float) -> Step:
    """Allowed while fewer than ``limit`` allowed hits fall in the time before."""

    def step(state: list[float], at: float, failed: bool) -> tuple[list[float], bool]:
        state = [t for t in state if at - t < seconds]
        return (state + [at], True) if len(state) < limit else (state, False)

    return step


def circuit(limit: int, cooldown: float) -> Step:
    """Open for the cooldown from ``limit`` failures in a row on; a success resets. State: failures, closed until."""

    def step(state: list[float], at: float, failed: bool) -> tuple[list[float], bool]:
        fails, until = state or [0.0, 0.0]
        usable = fails < limit or at >= until
        fails = fails + 1 if failed else 0.0
        return [fails, at + cooldown if fails >= limit else until], usable

    return step


def dedupe(seconds: float) -> Step:
    """Kept unless the last kept row of the key is at most so many seconds old."""
    return lambda state, at, failed: ([at], True) if not state or at - state[0] > seconds else (state, False)


def ttl_cache(seconds: float, least: float = 30) -> Step:
    """Whether the key's value is still valid; an expired or absent one is set anew for the time to live, ``least`` at minimum."""
    return lambda state, at, failed: (state, True) if state and at < state[0] else ([at + max(seconds, least)], False)


def heartbeat(seconds: float) -> Step:
    """Whether the gap since the last row of the key is longer than the limit."""
    return lambda state, at, failed: ([at], bool(state) and at - state[0] > seconds)


#: Groups that keys are dealt into by their hash; a running stream keeps its number.
BUCKETS = 1024


def keyed(stream: DataFrame, step: Step, keep: float, alarm: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(id, key, flag) of rows (id, key, ts, failed) by a step over the state of each key.

    A key that is idle for more than ``keep`` seconds is as new: its state is not used any more, and dropped once the watermark
    is past. With ``alarm`` a key that the watermark finds idle for so long gives one row without id, flagged, until it speaks
    again. Rows behind the watermark are dropped. Keys are dealt into ``buckets`` whose states are lists of theirs, as a call for every
    key costs far more than its rows; a trigger rewrites the buckets that it touches.
    """

    def run(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: rest for k, *rest in json.loads(state.get[0])} if state.exists else {}
        mark, spoke, out = state.getCurrentWatermarkMs(), set(), []
        due = lambda last, seconds: max(int((last + seconds) * 1000), mark) + 1
        frames = [] if state.hasTimedOut else [p for p in parts if len(p)]
        if frames:
            rows = pd.concat(frames).sort_values(["at", "id"])
            for key, number, at, failed in zip(rows["key"].tolist(), rows["id"].tolist(), rows["at"].tolist(), rows["failed"].tolist(), strict=True):
                key = key if isinstance(key, str) else None
                _, last, _, held = known.get(key, (0, None, False, []))
                if last is not None and at - last > keep:
                    held = []
                held, flag = step(held, at, bool(failed))
                known[key] = (due(at, alarm or keep), at, False, held)
                spoke.add(key)
                out.append((number, key, flag))
        for key in [k for k, rest in known.items() if rest[0] < mark and k not in spoke]:
            _, last, quiet, held = known.pop(key)
            if alarm is not None and not quiet:
                known[key] = (due(last, keep), last, True, held)
                out.append((None, key, True))
        if known:
            state.update((json.dumps([(k, *rest) for k, rest in known.items()]),))
            state.setTimeoutTimestamp(max(min(rest[0] for rest in known.values()), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            numbers, keys, flags = zip(*out, strict=True)
            yield pd.DataFrame({"id": pd.array(numbers, dtype="Int64"), "key": keys, "flag": flags})

    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    rows = timed.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "id", "key", "ts", (F.unix_micros("ts") / 1e6).alias("at"), "failed")
    return rows.groupBy("bucket").applyInPandasWithState(run, "id long, key string, flag boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout)
