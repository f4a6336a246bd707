"""Report operators on odd texts: null, empty, two tables, equal ids."""

from pyspark.sql import functions as F

from tessera.operators import reports as S


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tables(spark):
    two = "|名称|数值|\n|-|-|\n|a|1,234.5亿元|\n|b|2|\nmid\n|指标|金额(万辆)|年份|\n|---|---|---|\n|c|7|约2023年|\n|d||2024|"
    got = S.md_table_rows(docs(spark, two, None, "", "|x|\n|y|\n|z|", "|数值|\n|no rule|\n|3%|")).orderBy("n").collect()
    assert [(r.doc_id, r.label, r.value, r.unit, r.year) for r in got] == [(0, "a", 1234.5, "亿元", None), (0, "c", 7.0, "万辆", 2023)]


def test_scrub(spark):
    texts = ["a\n[CHART_DATA] x\n[CHART_DATA] y\n\nb", "【历史教训】 no end", None, "", "|h|数值|\n|-|-|\n|r|–|\n|s|1|"]
    got = {r.doc_id: r.text for r in S.report_scrub(docs(spark, *texts)).collect()}
    assert got == {0: "a\nb", 1: "", 2: "", 3: "", 4: "|h|数值|\n|-|-|\n|s|1|"}
    twins = docs(spark, "p", "q").select(F.lit(1).alias("doc_id"), "text")
    assert sorted(r.text for r in S.report_scrub(twins).collect()) == ["p", "q"]
    assert docs(spark, "【角色】x\nkeep\n  [{\"a\":1}]\n- http://x.y\n- see http://x.y").select(S.scrub_fallback(F.col("text"))).first()[0] == "keep\n- see http://x.y"


def test_columns(spark):
    row = docs(spark, None).select(S.company(F.col("text")).alias("c"), S.years(F.col("text")).alias("y"), S.kb_id(F.col("text")).alias("k"), S.case_issues(F.col("text")).alias("i")).first()
    assert (row.c, row.y.first, row.k) == ("", None, None) and len(row.i) == 5
    row = docs(spark, "据新浪财经与财新网 www.sina.com.cn 的年报").select(S.media_suggestions(F.col("text"), ()).alias("m")).first()
    assert [(m.word, m.host) for m in row.m] == [("据新浪财经", "sina.com.cn"), ("与财新网", "sina.com.cn")]
    assert docs(spark, "1，234").select(S.scaled(F.col("text"), F.lit("千亿美元")).alias("s")).first().s == (1234e11, "usd")


def test_names_and_claims(spark):
    goals = ["请帮我分析华润集团与小米公司", "公司财报", "腾讯的历年年报", "总结某某北方重型机械公司", "关于乙公司", "no name", ""]
    assert [r.c for r in docs(spark, *goals).orderBy("doc_id").select(S.company(F.col("text")).alias("c")).collect()] == ["华润", "公司", "腾讯", "北方重型机械", "", "", ""]
    claims = ["来源：甲报告，根据 乙所。引自丙|x", "| 来源 | [站点](http://a.b) | http://c.d | x |\n|不计|", "来源：", "来自" + "长" * 100, "", None]
    got = [r.c for r in docs(spark, *claims).orderBy("doc_id").select(S.source_claims(F.col("text")).alias("c")).collect()]
    assert got == [["甲报告", "乙所"], ["来源", "站点"], [], ["长" * 60], [], None]
    texts = ["中国新闻网 HTTPS://WWW.A.example:80/x 与 b.com", "甲财报、周报和北京日报 b.co.uk/path", "网", "", None]
    got = [r.m for r in docs(spark, *texts).orderBy("doc_id").select(S.media_suggestions(F.col("text"), ()).alias("m")).collect()]
    assert [[tuple(m) for m in row or []] for row in got] == [[("中国新闻网", "a.example")], [("和北京日报", "b.co.uk")], [], [], []]
