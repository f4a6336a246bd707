"""Filtering and scoring of search results."""

from pyspark.sql import functions as F

from tessera.operators import search as S


def test_results_are_dropped_and_scored(spark):
    goals = [(1, "任务目标：2026年新能源汽车市场"), (2, "原始 x\n用户目标：angry-birds star game 2024\n【角色】分析师"), (3, "新能源汽车市场\n【角色】star"), (4, None)]
    rows = [
        (1, 1, "2026 新能源汽车 市场规模", "https://ev-report.org/a", "2026 新能源汽车 市场规模"), (1, 2, "无关内容", "https://weather-info.org/b", "天气"), (1, 3, "", "https://a.org", "新能源"), (1, 4, "新能源汽车", "ftp://a.org", ""),
        (1, 5, "新能源汽车", "https://28quan.com/x", ""), (1, 6, "新能源汽车", "https://a.org/login", ""), (1, 7, "新能源汽车 彩票", "https://a.org", None), (1, 8, " Google ", "https://a.org", "新能源"),
        (2, 9, "Stars of Angry-Birds", "https://g.com/blog", "a GAME"), (2, 10, "Star 2024", "https://www.youtube.com/w", None), (2, 11, "nothing", "https://pref.org", None), (2, 12, "star", "https://bad.org", None),
        (3, 13, "市场", "https://ev-report.org/c", "市场行情"), (3, 14, "star market", "https://a.org", ""), (4, 15, "x", "https://a.org", ""), (9, 16, "x", "https://a.org", ""), (None, 17, "x", "https://a.org", ""),
    ]
    results = spark.createDataFrame(rows, "k long, doc_id long, title string, url string, snippet string").withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame(goals, "k long, goal string")
    got = {r.doc_id: (r.k, r.score, r["rank"]) for r in S.filter_results(results, asked, "k", ("pref.",), ("bad.",)).collect()}
    # 2026 counts 1; of 新能源汽车市场 the title holds 新能源汽车 (4 pairs, 3 and 2 longer windows) and 市场 (1 pair)
    assert got == {1: (1, 1 + 4 + 6 + 4 + 1, 1), 9: (2, 2 + 2, 1), 10: (2, 2 + 1, 2), 11: (2, 3, 3)}
    weak = {r.doc_id: r.score for r in S.filter_results(results, asked, "k", least=1).collect() if r.k == 3}
    assert weak == {13: 1}
    assert S.filter_results(results.limit(0), asked, "k").count() == 0
