"""Streams with state of their own over several triggers, restarts and failures."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.sources import topics
from tessera.streaming import jobs as J
from tessera.streaming import observed as O
from tessera.streaming import stateful as S

START = 1_700_000_000


def put(spark, path, rows, fields):
    """One more file of rows (..., seconds) whose last field becomes ts."""
    df = spark.createDataFrame(rows, f"{fields}, s double").withColumn("ts", F.timestamp_micros(((F.col("s") + START) * 1e6).cast("long"))).drop("s")
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(1.1)  # files are taken in order of their time
    return df.schema


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, base):
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out").collect()


def test_worker_health_over_restarts(spark, tmp_path):
    S.with_rocksdb(spark)
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    schema = put(spark, path, [("a", 0.0), ("b", 0.0), ("c", 0.0), ("a", 15.0), ("c", 30.0)], "key string")
    put(spark, path, [("a", 100.0), ("b", 70.0), ("z", 2000.0)], "key string")
    put(spark, path, [("z", 2001.0), ("z", 4000.0)], "key string")
    first = run(S.worker_health(source(spark, path, schema), 20, 300, 3, 60), base)
    put(spark, path, [("z", 4001.0)], "key string")
    got = run(S.worker_health(source(spark, path, schema), 20, 300, 3, 60), base)  # goes on from the checkpoint
    assert len(got) >= len(first)
    told = lambda k: sorted((round(r.at - START, 3), r.status, r.restarts) for r in got if r.key == k)
    # a: silent from 15 on, dead at 35, revived when the grace is over at 60 and again at 80, heard of at 100, then silent for good
    assert told("a") == [(35, "dead", 0), (60, "restarted", 1), (80, "dead", 1), (80, "restarted", 2), (120, "dead", 2), (120, "restarted", 3), (140, "dead", 3), (140, "quarantined", 3)]
    assert told("b")[:2] == [(20, "dead", 0), (60, "restarted", 1)] and told("b")[-1][1] == "quarantined"
    assert told("c")[:3] == [(20, "dead", 0), (30, "back", 0), (50, "dead", 0)]


def test_workers_of_a_bucket_keep_apart(spark, tmp_path):
    S.with_rocksdb(spark)
    path = str(tmp_path / "in")
    put(spark, path, [(f"w{i}", float(i)) for i in range(30)] + [(None, 3.0)], "key string")
    schema = put(spark, path, [(f"w{i}", 90.0 + i) for i in range(0, 30, 2)] + [("z", 3000.0)], "key string")
    one, many = (sorted(((r.key or "", r.at, r.status, r.restarts) for r in run(S.worker_health(source(spark, path, schema), 20, 300, 3, 60, buckets=n), str(tmp_path / f"job{n}")))) for n in (1, 7))
    assert one == many and {r[0] for r in one} == {"", *(f"w{i}" for i in range(30))}


def test_lost_results_are_told(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for starts, results in [([(1, "x", 0.0), (2, "x", 10.0), (3, "y", 20.0)], [(7, "x", 5.0)]), ([(4, "y", 9_000.0)], [(8, "y", 9_100.0)]), ([(5, "z", 20_000.0)], [(9, "q", 20_000.0)])]:
        left, right = put(spark, a, starts, "id long, key string"), put(spark, b, results, "result_id long, key string")
    got = sorted(((r.id, r.result_id, r.latency) for r in run(S.lost_and_found(source(spark, a, left), source(spark, b, right), 1), str(tmp_path / "job"))), key=repr)
    assert got == [(1, 7, 5.0), (2, None, None), (3, None, None), (4, 8, 100.0)]  # 5 may still get one


def test_idle_streaks_over_triggers(spark, tmp_path):
    S.with_rocksdb(spark)
    path = str(tmp_path / "in")
    rows = [[(1, True, 0.0), (1, False, 15.0), (2, False, 5.0)], [(1, False, 25.0), (1, True, 62.0), (2, False, 31.0)], [(1, False, 75.0), (2, False, 41.0), (9, False, 3000.0)], [(9, False, 9000.0)]]
    for part in rows:
        schema = put(spark, path, part, "capability long, waiting boolean")
    got = run(S.backlog_and_idle(source(spark, path, schema), F.col("waiting"), 10, 0, 2), str(tmp_path / "job"))
    at = lambda r: (r.start - datetime(1970, 1, 1)).total_seconds() - START
    told = {c: [(at(r), r.queue, r.idle, r.alert, r.shrink) for r in sorted(got, key=lambda r: r.start) if r.capability == c] for c in (1, 2)}
    assert told[1] == [(0, 1, 0, True, False), (10, 0, 1, False, False), (20, 0, 2, False, True), (60, 1, 0, True, False), (70, 0, 1, False, False)]
    assert told[2] == [(0, 0, 1, False, False), (30, 0, 4, False, True), (40, 0, 5, False, False)]


def test_merged_state_is_bounded_and_replay_safe(spark, tmp_path):
    schema = spark.createDataFrame([], "task string, step string, at long, value long").schema
    store = S.MergedState(spark, schema, "task", "step", ["at"], str(tmp_path), cap=5, buckets=3)
    batch = lambda n: spark.createDataFrame([(f"t{n * 7 + i}", s, n * 10 + i, n) for i in range(7) for s in ("a", "b")] + [("t0", "a", n * 10 + 9, 100 + n)], schema)
    sizes = []
    for n in range(10):
        store.put(batch(n), n)
        if n == 4:
            store.put(batch(4), 4)  # the trigger is run again
        sizes.append(store.held().count())
    assert max(sizes[3:]) <= 3 * 5 * 2 and len(store.held().columns) == 4
    got = sorted(map(tuple, store.snapshot().collect()))
    newest = {}
    for n in range(10):
        for r in batch(n).collect():
            newest[r.task, r.step] = max(newest.get((r.task, r.step), (0, 0)), (r.at, r.value))
    last = {}
    for (t, _), (at, _) in newest.items():
        last[t] = max(last.get(t, 0), at)
    keep = sorted(last, key=lambda t: -last[t])[:5]
    assert "t0" in keep and {g[0] for g in got} == set(keep)
    assert [g for g in got if g[0] == "t0" and g[1] == "a"] == [("t0", "a", 99, 109)]
    again = S.MergedState(spark, schema, "task", "step", ["at"], str(tmp_path), cap=5, buckets=3)
    assert sorted(map(tuple, again.snapshot().collect())) == got


def test_topic_log_resumes_after_a_failed_batch(spark, tmp_path):
    path, base = str(tmp_path / "log"), str(tmp_path / "job")
    messages = lambda low, high: spark.range(low, high).select(F.element_at(F.array(*map(F.lit, ("orders", "alerts", "results:1", "noise"))), (F.col("id") % 4 + 1).cast("int")).alias("channel"), F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(0)).alias("ts"), F.col("id").cast("string").alias("payload"))
    spark.dataSource.register(topics.TopicLog)
    stream = spark.readStream.format("topic_log").option("path", path).option("channels", "orders, alerts").option("pattern", "results:.*").load()
    seen, fail = {}, [False]

    def keep(batch, number):
        rows = [(r.position, r.payload) for r in batch.collect()]
        if fail[0]:
            raise RuntimeError("lost")
        seen.setdefault(number, []).append(rows)

    go = lambda: stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    assert topics.append(messages(0, 10), path) == 10
    go()
    topics.append(messages(10, 15), path)
    fail[0] = True
    with pytest.raises(Exception, match="lost"):
        go()
    topics.append(messages(15, 30), path)
    fail[0] = False
    go()
    go()
    got = [p for n in sorted(seen) for rows in seen[n] for p in rows]
    assert sorted(int(p) for _, p in got) == [i for i in range(30) if i % 4 != 3]
    assert len({at for at, _ in got}) == len(got) and all(len(v) == 1 for v in seen.values())
    late = spark.readStream.format("topic_log").option("path", path).option("from", "end").load()
    assert J.drain(late.select("payload")).count() == 0


def test_counts_of_triggers_and_late_rows(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    for rows in ([(1, 1, False, 5000.0)], [(2, 1, True, 9000.0), (3, 2, False, 9010.0)], [(4, 1, False, 10.0), (5, 2, True, 20.0), (6, 1, False, 9500.0)]):
        schema = put(spark, path, rows, "id long, capability long, failed boolean")
    go = lambda seen: J.task_metrics(seen).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    _, counts = O.counted(source(spark, path, schema), go, failures=F.count_if("failed"))
    rows = [tuple(r)[1:] for r in counts.collect() if r.rows]
    assert [r[1:] for r in rows] == [(1, 0, 0), (2, 1, 0), (3, 1, 2)]
    put(spark, path, [(7, 1, False, 30.0)], "id long, capability long, failed boolean")
    _, more = O.counted(source(spark, path, schema), go, failures=F.count_if("failed"))
    again = [tuple(r)[1:] for r in more.collect() if r.rows]
    assert [r[1:] for r in again] == [(1, 0, 1)] and again[0][0] > rows[-1][0]
