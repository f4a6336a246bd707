"""Keyed streaming jobs against a plain loop, and state over two triggers."""

import time
from datetime import datetime

from tessera.plans import streams
from tessera.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def loop(spark, step, key, keep):
    held, out, last = {}, {}, {}
    for e in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        at = (e.ts - datetime(1970, 1, 1)).total_seconds()
        if at - last.get(key(e), at) > keep:
            held.pop(key(e))
        last[key(e)] = at
        held[key(e)], out[e.event_id] = step(held.get(key(e), []), at, e.event_type == "error")
    return out


def test_keyed(spark):
    user, both = (lambda e: e.user_id), (lambda e: (e.user_id, e.event_type))
    for name, step, key, keep in [
        ("stream_rate_limit", J.rate_limit(3, 86_400), user, 86_400), ("stream_circuit", J.circuit(2, 86_400), user, 604_800),
        ("stream_dedupe", J.dedupe(43_200), both, 43_200), ("stream_ttl_cache", J.ttl_cache(43_200), both, 43_200),
    ]:
        got = {r.id: r.flag for r in streams.QUERIES[name](spark, SF).collect()}
        assert got == loop(spark, step, key, keep), name


def test_state_survives_triggers(spark, tmp_path):
    rows = spark.sql("select id, 'a' as key, timestamp_seconds(1700000000 + id) as ts, false as failed from range(4)")
    for part in (rows.where("id < 2"), rows.where("id >= 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {r.id: r.flag for r in J.drain(J.keyed(stream, J.rate_limit(3, 60), 60)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}


def test_state_expires_and_late_rows_go(spark, tmp_path):
    """a starts, b moves the watermark past a's hour of silence; a late row of a, once the watermark is in force, goes; then a speaks again."""
    for i, seconds in enumerate(([("a", 0), ("a", 10)], [("b", 10_000)], [("b", 10_050)], [("b", 10_060), ("a", 20)], [("a", 10_100)])):
        rows = spark.createDataFrame([(10 * i + j, k, t) for j, (k, t) in enumerate(seconds)], "id long, key string, s long").selectExpr("id", "key", "timestamp_seconds(1700000000 + s) as ts", "false as failed")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)  # files are taken in order of their time
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = J.drain(J.keyed(stream, J.heartbeat(3600), 864_000, alarm=3600)).collect()
    assert sorted((r.id is None, r.id or 0, r.key, r.flag) for r in got) == [(False, 0, "a", False), (False, 1, "a", False), (False, 10, "b", False), (False, 20, "b", False), (False, 30, "b", False), (False, 40, "a", True), (True, 0, "a", True)]


def test_keys_of_one_bucket_keep_apart(spark, tmp_path):
    """Two buckets for nine keys and a null one: states, expiry and alarms are those of keys by themselves."""
    for i, seconds in enumerate(([(k, 10 * k) for k in range(9)], [(k, 10_000 + k) for k in (1, 2)], [(1, 10_100)], [(2, 10_200)], [(0, 10_300), (3, 20_000)], [(1, 20_100)])):
        rows = [(100 * i + j, None if k == 8 else f"k{k}", t) for j, (k, t) in enumerate(seconds)]
        frame = spark.createDataFrame(rows, "id long, key string, s long").selectExpr("id", "key", "timestamp_seconds(1700000000 + s) as ts", "false as failed")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = {n: sorted((r.id or -1, r.key or "", r.flag) for r in J.drain(J.keyed(stream, J.heartbeat(3600), 9_000, 3600, buckets=n)).collect()) for n in (2, 4096)}
    assert found[2] == found[4096]
    assert sum(number < 0 for number, _, _ in found[2]) >= 9


def test_folders_of_files_as_streams(spark, tmp_path):
    for form in ("one", "many"):
        spark.range(7).repartition(2).write.parquet(f"{tmp_path}/{form}/events.parquet")
    assert {J.drain(J.stream_table(spark, f"{tmp_path}/{form}", "events")).count() for form in ("one", "many")} == {7}
    assert J.drain(J.stream_table(spark, SF, "events")).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_updates_over_triggers(spark, tmp_path):
    rows = spark.sql("select id, if(id % 2 = 0, 'a', 'b') as key, timestamp_seconds(1700000000 + id) as ts, id * 10 as value from range(6)")
    for i in (0, 2, 4):
        rows.where(f"id between {i} and {i + 1 - (i == 4)}").coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = J.drain_update(J.state_merge(stream, ["key"], ["ts", "id"]), ["key"]).collect()
    assert sorted((r.key, r.id, r.value) for r in got) == [("a", 4, 40), ("b", 3, 30)]
