"""Streams with state of their own: worker health with timers, idle streaks behind windowed counts, lost results, merged task state.

State lives in the RocksDB store, which ``with_rocksdb`` chooses. All decisions are taken in event time, so a rerun and a batch twin tell the
same: a deadline is acted upon when a later row of the key comes or the watermark has passed it, and is told with the deadline's own time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.io import shared_folder
from tessera.streaming.jobs import BUCKETS, LATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session, with the state store that custom state asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class WorkerHealth(StatefulProcessor):
    """Rows (key, at, status, restarts) of changes in a worker's health.

    Silent for longer than ``timeout`` seconds, a worker is dead. Outside its first ``grace`` seconds it is then restarted, which
    counts as a sign of life; ``most`` restarts within ``window`` seconds before another one put it into quarantine for good. A heartbeat brings a
    dead worker back. Workers come dealt into buckets: a bucket's state is the list of its workers, each with its first and last sign of life,
    status and times of restarts, and one timer stands at the first of their deadlines.
    """

    def __init__(self, timeout: float, window: float, most: int, grace: float):
        self.timeout, self.window, self.most, self.grace = timeout, window, most, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.workers = handle.getValueState("workers", "held string")

    def _advance(self, first: float, last: float, status: str, until: float, restarts: list[float], out: list[tuple]) -> tuple[float, str]:
        """Acts upon all deadlines before ``until``."""
        while status != "quarantined":
            due = last + self.timeout if status == "healthy" else max(last + self.timeout, first + self.grace)
            if due >= until:
                break
            if status == "healthy":
                status = "dead"
                out.append((due, status, len(restarts)))
                continue
            restarts[:] = [t for t in restarts if due - t < self.window]
            if len(restarts) >= self.most:
                status = "quarantined"
                out.append((due, status, len(restarts)))
            else:
                restarts.append(due)
                last, status = due, "healthy"
                out.append((due, "restarted", len(restarts)))
        return last, status

    def _due(self, first: float, last: float, status: str) -> float:
        return last + self.timeout if status == "healthy" else max(last + self.timeout, first + self.grace)

    def _known(self) -> dict:
        return {k: held for k, *held in json.loads(self.workers.get()[0])} if self.workers.exists() else {}

    def _save(self, known: dict, out: list) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.workers.update((json.dumps([(k, *held) for k, held in known.items()]),))
        dues = [self._due(first, last, status) for first, last, status, _ in known.values() if status != "quarantined"]
        if dues:
            self.handle.registerTimer(int(min(dues) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "status", "restarts"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = self._known(), []
        part = pd.concat(list(rows)).sort_values("at")
        for name, t in zip(part["key"].tolist(), part["at"].tolist(), strict=True):
            name, found = name if isinstance(name, str) else None, []
            first, last, status, restarts = known.get(name) or (t, t, "healthy", [])
            last, status = self._advance(first, last, status, t, restarts, found)
            if status == "dead":
                status = "healthy"
                found.append((t, "back", len(restarts)))
            if status != "quarantined":
                last = max(last, t)
            known[name] = [first, last, status, restarts]
            out += [(name, *change) for change in found]
        yield from self._save(known, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, out, mark = self._known(), [], timerValues.getCurrentWatermarkInMs() / 1000
        for name, (first, last, status, restarts) in known.items():
            found: list[tuple] = []
            last, status = self._advance(first, last, status, mark, restarts, found)
            known[name] = [first, last, status, restarts]
            out += [(name, *change) for change in found]
        yield from self._save(known, out)

    def close(self) -> None:
        pass


def worker_health(beats: DataFrame, timeout: float = 20, window: float = 300, most: int = 3, grace: float = 60, buckets: int = BUCKETS) -> DataFrame:
    """(key, at, status, restarts) of a stream of heartbeats (key, ts); ``at`` in seconds since 1970."""
    timed = beats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("bucket").transformWithStateInPandas(WorkerHealth(timeout, window, most, grace), "key string, at double, status string, restarts long", "Append", "EventTime")


class StaleTasks(StatefulProcessor):
    """Rows (key, at, status) of tasks that stayed in a status for longer than ``seconds``, told with the time at which they ran out.

    Keys come dealt into buckets: a bucket's state is the list of its waiting tasks, and one timer stands at the first of their deadlines.
    """

    def __init__(self, waiting: str, seconds: float):
        self.waiting, self.seconds = waiting, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getValueState("tasks", "held string")

    def _run_out(self, key: str | None, held: tuple, until: float) -> tuple[list, tuple]:
        at, status, told = held
        if status != self.waiting or told or at + self.seconds >= until:
            return [], held
        return [(key, at + self.seconds, "FAILED")], (at, status, True)

    def _known(self) -> dict:
        return {k: tuple(held) for k, *held in json.loads(self.tasks.get()[0])} if self.tasks.exists() else {}

    def _save(self, known: dict, out: list) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        rest = [(k, *held) for k, held in known.items() if held[1] == self.waiting]  # a task at rest needs no state
        if rest:
            self.tasks.update((json.dumps(rest),))
        else:
            self.tasks.clear()
        open_ = [at for _, at, _, told in rest if not told]
        if open_:
            self.handle.registerTimer(int((min(open_) + self.seconds) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = self._known(), []
        part = pd.concat(list(rows)).sort_values(["at", "id"])
        for name, at, status in zip(part["key"].tolist(), part["at"].tolist(), part["status"].tolist(), strict=True):
            name = name if isinstance(name, str) else None
            more, held = self._run_out(name, known.get(name, (0.0, "", False)), at)
            out += more
            known[name] = (at, status, False) if at >= held[0] else held
        yield from self._save(known, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, out, mark = self._known(), [], timerValues.getCurrentWatermarkInMs() / 1000
        for name, held in known.items():
            more, known[name] = self._run_out(name, held, mark)
            out += more
        yield from self._save(known, out)

    def close(self) -> None:
        pass


def stale_tasks(updates: DataFrame, waiting: str = "PENDING", seconds: float = 1800, buckets: int = BUCKETS) -> DataFrame:
    """(key, at, status) of a stream of updates (id, key, ts, status): FAILED at the time when a waiting task has had no update for so long."""
    timed = updates.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "id", "key", "ts", "status", (F.unix_micros("ts") / 1e6).alias("at"))
    return timed.groupBy("bucket").transformWithStateInPandas(StaleTasks(waiting, seconds), "key string, at double, status string", "Append", "EventTime")


class IdleStreak(StatefulProcessor):
    """Adds to each closed window of a key how many windows in a row, up to it, had an empty queue; windows without rows are empty."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("streak", "start double, idle long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("at")
        at, idle = self.state.get() if self.state.exists() else (None, 0)
        streaks = []
        for start, queue in zip(found["at"], found["queue"], strict=True):
            missing = 0 if at is None else round((start - at) / self.seconds) - 1
            idle = 0 if queue > 0 else idle + missing + 1
            at = start
            streaks.append(idle)
        self.state.update((float(at), int(idle)))
        yield pd.DataFrame({"capability": found["capability"], "at": found["at"], "queue": found["queue"], "idle": streaks})

    def close(self) -> None:
        pass


def backlog_and_idle(log: DataFrame, waiting: Column, seconds: int, limit: int, checks: int) -> DataFrame:
    """(start, capability, queue, idle, alert, shrink) of every closed window: the rows that wait, the streak of empty windows, whether the queue passes the limit, and whether the streak has just reached another ``checks`` windows."""
    counts = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "capability").agg(F.count_if(waiting).alias("queue"))
    rows = counts.select("capability", (F.unix_micros("w.start") / 1e6).alias("at"), "queue")
    told = rows.groupBy("capability").transformWithStateInPandas(IdleStreak(seconds), "capability long, at double, queue long, idle long", "Append", "None")
    return told.select(F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("start"), "capability", "queue", "idle", (F.col("queue") > limit).alias("alert"), ((F.col("idle") > 0) & (F.col("idle") % checks == 0)).alias("shrink"))


def lost_and_found(starts: DataFrame, results: DataFrame, hours: int) -> DataFrame:
    """(id, result_id, latency) of starts (id, key, ts) and the results (result_id, key, ts) of the same key within so many hours; a start without any is told, with nulls, once the watermark has passed its time."""
    a = starts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).alias("a")
    b = results.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & F.col("b.ts").between(F.col("a.ts"), F.col("a.ts") + F.expr(f"interval {hours} hours")), "left")
    return pairs.select("a.id", "b.result_id", F.round((F.unix_micros("b.ts") - F.unix_micros("a.ts")) / 1e6, 3).alias("latency"))


#: Buckets of a store, and tasks that it keeps.
BUCKETS, CAP = 64, 300


class MergedState:
    """The newest row of each (task, step), kept in buckets of tasks under a shared folder; only buckets that a trigger touches are written anew.

    A trigger writes its buckets and then a list of the valid version of every bucket, both under its own number, and starts from the list
    of the trigger before: a trigger that is run again after a failure overwrites itself, and readers never see half of one. A bucket keeps its ``cap`` newest
    tasks, so the store stays bounded and its ``cap`` newest tasks of all are exact.
    """

    def __init__(self, spark: SparkSession, schema: StructType, task: str, step: str, order: list[str], base: str | None = None, cap: int = CAP, buckets: int = BUCKETS):
        self.spark, self.schema, self.keys, self.order, self.cap, self.buckets = spark, schema, [task, step], order, cap, buckets
        self.base = base or shared_folder(spark)
        spark.createDataFrame([(-1, -1)], "bucket int, version long").write.mode("ignore").parquet(f"{self.base}/list/number=-1")

    def _versions(self, before: int | None = None) -> list[tuple[int, int]]:
        """(bucket, version) of the newest list, or of the newest one before a trigger; as many as there are buckets at most."""
        lists = self.spark.read.schema("bucket int, version long, number long").parquet(f"{self.base}/list")
        if before is not None:
            lists = lists.where(F.col("number") < before)
        newest = lists.agg(F.max("number")).first()[0]
        return [(r.bucket, r.version) for r in lists.where(F.col("number") == newest).collect() if r.bucket >= 0]

    def _read(self, versions: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.base}/rows/{version}/bucket={bucket}" for bucket, version in versions]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, batch: DataFrame, number: int) -> None:
        """Merges one trigger; a function for foreachBatch."""
        names, bucket = self.schema.names, F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")
        rest = [c for c in names if c not in self.keys]
        newest = lambda df: df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("s")).select(*self.keys, "s.*").select(names)
        spark = batch.sparkSession
        fresh = newest(batch.select(names)).persist()
        versions = dict(self._versions(before=number))
        touched = [r.bucket for r in fresh.select(bucket.alias("bucket")).distinct().collect()]
        if touched:
            held = self._read([(b, versions[b]) for b in touched if b in versions])
            merged = newest(held.unionByName(fresh)).withColumn("bucket", bucket)
            tasks = merged.groupBy("bucket", self.keys[0]).agg(F.max(F.struct(*self.order)).alias("last"))
            kept = tasks.groupBy("bucket").agg(F.slice(F.sort_array(F.collect_list(F.struct("last", self.keys[0])), False), 1, self.cap).alias("tasks")).select("bucket", F.explode(f"tasks.{self.keys[0]}").alias(self.keys[0]))
            merged.join(kept, ["bucket", self.keys[0]], "left_semi").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/rows/{number}")
        rows = [*(versions | dict.fromkeys(touched, number)).items(), (-1, -1)]
        spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/list/number={number}")
        fresh.unpersist()

    def held(self) -> DataFrame:
        """All rows of the store: ``cap`` tasks of each bucket at most."""
        return self._read(self._versions())

    def snapshot(self) -> DataFrame:
        """The rows of the ``cap`` newest tasks."""
        rows = self.held()
        tasks = rows.groupBy(self.keys[0]).agg(F.max(F.struct(*self.order)).alias("last")).orderBy(F.desc("last")).limit(self.cap)
        return rows.join(F.broadcast(tasks.select(self.keys[0])), self.keys[0], "left_semi").select(self.schema.names)


def merge_stream(stream: DataFrame, task: str, step: str, order: list[str], cap: int = CAP, base: str | None = None) -> MergedState:
    """Runs a stream over all that is there into a store; with the ``base`` of an earlier run it goes on from there."""
    store = MergedState(stream.sparkSession, stream.schema, task, step, order, base, cap)
    stream.writeStream.option("checkpointLocation", f"{store.base}/state").foreachBatch(store.put).trigger(availableNow=True).start().awaitTermination()
    return store
