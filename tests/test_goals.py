"""Routing of goals, charts on their topic, forms of numbers, and stale tasks."""

import time

from pyspark.sql import functions as F

from tessera.operators import goals as G
from tessera.streaming import stateful as S

START = 1_700_000_000


def test_routes(spark):
    want = {
        "今日A股成交量排行": ("ranking", "a", "volume", None, None), "美股股票排行，成交额与成交量": ("ranking", "us", "amount", None, None), "以太坊 BTC": ("crypto", None, None, "ethereum", None), "price of SOL coin": ("crypto", None, None, "of", None),
        "加密货币": ("crypto", None, None, "bitcoin", None), "美联储降息": ("macro", None, None, None, "DFF"), "失业率与GDP": ("macro", None, None, None, "UNRATE"), "宏观": ("macro", None, None, None, "GDP"), "Headline": ("news", None, None, None, None), "写诗": (None,) * 5, None: (None,) * 5,
    }
    df = spark.createDataFrame([(g,) for g in want], "goal string")
    got = {r.goal: (r.route, r.market, r.metric, r.coin, r.indicator) for r in df.select("goal", G.route_goal(F.col("goal")).alias("g")).select("goal", "g.*").collect()}
    assert got == want


def test_charts_on_topic(spark):
    rows = [(1, 0, "AI芯片份额", None, None, [("英伟达", "芯片", None), ("汽车芯片", None, None)]), (1, 1, "手机出货", None, None, [("x", None, None)]), (1, 2, "天气", "降雨", "芯片", [("雨", None, None)]), (1, 3, "芯片", None, None, [("机器人", None, None)]), (1, 4, "芯片", None, None, None), (2, 0, "anything", None, None, [("a", None, None)])]
    specs = spark.createDataFrame(rows, "k long, pos int, title string, question string, conclusion string, data array<struct<label:string,caliber:string,source:string>>")
    goals = spark.createDataFrame([(1, "分析全球芯片市场"), (2, None)], "k long, goal string")
    assert {(r.k, r.pos, len(r.data)) for r in G.filter_chart_specs(specs, goals, "k").collect()} == {(1, 0, 1), (2, 0, 1)}
    assert goals.select(G.goal_subjects(F.col("goal")).alias("s")).first().s == ["析全", "芯片", "片市"]  # pairs across words stay, they meet nothing


def test_forms_of_numbers(spark):
    row = spark.range(1).select(
        G.number_candidates(F.lit("1,152.0"), F.lit("亿美元")).alias("a"), G.number_candidates(F.lit("5"), F.lit("%")).alias("b"), G.number_candidates(F.lit("5"), F.lit("")).alias("c"),
        *[G.bare_match(F.lit("789"), F.lit(t)).alias(f"m{i}") for i, t in enumerate(("共 789 家", "4789", "789.5", "x789", "（789）", None))],
        *[G.units_equivalent(F.lit(a), F.lit(b)).alias(f"u{i}") for i, (a, b) in enumerate((("亿美元", "USD"), ("元", "人民币"), ("港元", "hkd"), ("%", "％"), ("", "x"), ("亿元", "元"), ("美元", "港元"), ("$", "usd"), (None, "a")))],
    ).first()
    assert row.a == ["1152亿美元", "1152亿"] and row.b == ["5%", "5％"] and row.c == []
    assert [row[f"m{i}"] for i in range(6)] == [True, False, False, False, True, False]
    # an amount in dollars and one in Hong Kong dollars both hold the sign for yuan, and so count as one, as the rule has it
    assert [row[f"u{i}"] for i in range(9)] == [True, True, True, True, True, True, False, True, True]


def test_stale_tasks_over_triggers(spark, tmp_path):
    S.with_rocksdb(spark)
    path, base = str(tmp_path / "in"), str(tmp_path / "job")
    for rows in ([(1, "a", "PENDING", 0.0), (2, "b", "PENDING", 0.0), (3, "c", "DONE", 0.0)], [(4, "b", "DONE", 50.0), (5, "z", "DONE", 5000.0)], [(6, "a", "PENDING", 6000.0), (7, "z", "DONE", 9000.0)], [(8, "a", "DONE", 9001.0)]):
        df = spark.createDataFrame(rows, "id long, key string, status string, s double").withColumn("ts", F.timestamp_micros(((F.col("s") + START) * 1e6).cast("long"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = S.stale_tasks(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), seconds=100)
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{base}/out").collect()
    assert sorted((r.key, r.at - START, r.status) for r in got) == [("a", 100, "FAILED"), ("a", 6100, "FAILED")]


def test_stale_tasks_of_one_bucket(spark, tmp_path):
    S.with_rocksdb(spark)
    rows = [(1, "a", "PENDING", 0.0), (2, "b", "PENDING", 30.0), (3, None, "PENDING", 60.0), (4, "b", "DONE", 140.0), (5, "b", "PENDING", 150.0), (6, "z", "DONE", 5000.0)]
    df = spark.createDataFrame(rows, "id long, key string, status string, s double").withColumn("ts", F.timestamp_micros(((F.col("s") + START) * 1e6).cast("long"))).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = S.stale_tasks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), seconds=100, buckets=1)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.key or "", r.at - START) for r in got) == [("", 160), ("a", 100), ("b", 130), ("b", 250)]
