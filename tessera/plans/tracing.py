"""Queries of the tracing rules over staged cases: every order takes one, and the twin states what must be said of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import checks as C
from tessera.operators import reports as S
from tessera.operators import tracing as T
from tessera.operators.texts import content_tokens
from tessera.plans.binding import Plans, Reader
from tessera.plans.checks import add_cases
from tessera.plans.sources import text
from tessera.sources import readers as R

P = Plans()


def traced(df: DataFrame) -> DataFrame:
    side = lambda value, unit: df.select("o_orderkey", F.col(value).alias("value"), F.col(unit).alias("unit")).where("value is not null")
    found = T.statement_trace(df.select("o_orderkey", F.col("report").alias("text")), side("fact", "fact_unit"), side("computed", "computed_unit"), df.select("o_orderkey", F.col("source").alias("text")), "o_orderkey")
    lists = found.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "status"))), lambda s: s["status"]).alias("statuses"))
    return df.join(lists, "o_orderkey", "left").select("o_orderkey", F.array_join(F.coalesce("statuses", F.array().cast("array<string>")), ",").alias("statuses"))


add_cases(
    "statement_trace_cases", "report string, fact string, fact_unit string, computed string, computed_unit string, source string", ["statuses"],
    [
        (("营收9{n}.5亿元", "9{n}.5", "亿元", None, None, None), ("structured",)),
        (("营收9{n}.5亿元", "9{n}.5", "亿美元", None, None, None), ("derived",)),
        (("占比9{n}.5%", "9{n}.5", "亿美元", None, None, None), ("untraceable",)),
        (("营收9{n}.5亿元，净利率7%", "9{n}5000", "万元", None, None, "净利率为 7 ％"), ("structured,text",)),
        (("第n{n}家增速8%（模型知识，未验证）", None, None, None, None, "其他"), ("disclosed",)),
        (("共9{n}000件", None, None, None, None, "共有 9{n}000 件"), ("text",)),
        (("同比13.9%，n{n}家占55.0%", None, None, "-13.86", "%", ""), ("derived,untraceable",)),
        (("规模1000亿元，后为1000亿元", "1004", "亿元", None, None, None), ("structured,structured",)),
        (("规模1000亿元", "1006", "亿元", None, None, None), ("derived",)),
        (("规模1000亿元", "1021", "亿元", None, None, None), ("untraceable",)),
        (("规模1000亿元，后为500万", None, None, "990", "亿元", None), ("derived,untraceable",)),
        ((None, "1", "亿元", None, None, None), ("",)),
    ],
    traced, P,
)


def order_reports(r: Reader) -> DataFrame:
    """A report for each order that tells its lines; facts are some prices, in full or rounded to ten thousands; taxes are the computed growth rates; the total and the second price are in the source."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lines = r("lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("n"), price.alias("price"), (F.col("l_discount") * 100).cast("int").alias("off"), (F.col("l_tax") * 100).cast("int").alias("tax"))
    said = F.concat(F.lit("项"), "n", F.lit("金额"), "price", F.lit("元，同比"), "off", F.lit("%"), F.when(F.col("n") == 4, "（未验证）").otherwise(""), F.lit("。" + "略" * 60))
    told = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"]), "").alias("text"))
    third = F.col("n") % 3
    facts = lines.where("n % 3 < 2").select("l_orderkey", F.when(third == 0, F.col("price").cast("string")).otherwise((F.round(F.col("price").cast("double") / 10000, 2)).cast("decimal(18,2)").cast("string")).alias("value"), F.when(third == 0, "元").otherwise("万元").alias("unit"))
    computed = lines.select("l_orderkey", F.col("tax").cast("string").alias("value"), F.lit("%").alias("unit"))
    second = lines.where("n = 2").select("l_orderkey", F.concat(F.lit("另有"), "price", F.lit("元")).alias("text"))
    total = r("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("总额"), F.col("o_totalprice").cast("decimal(18,2)"), F.lit("元")).alias("text"))
    return T.statement_trace(told, facts, computed, total.unionAll(second), "l_orderkey")


P.add("statement_trace", order_reports, """WITH l AS (
  SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS n, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(trunc(l_discount * 100) AS INTEGER) AS off, CAST(trunc(l_tax * 100) AS INTEGER) AS tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) || '元，同比' || CAST(trunc(l_discount * 100) AS INTEGER) || '%') AS place FROM lineitem
), f AS (
  SELECT l_orderkey, CASE WHEN n % 3 = 0 THEN CAST(price AS DOUBLE) ELSE CAST(CAST(round(CAST(price AS DOUBLE) / 10000, 2) AS DECIMAL(18,2)) AS DOUBLE) * 10000 END AS amount FROM l WHERE n % 3 < 2
), s AS (
  SELECT o_orderkey AS l_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders UNION SELECT l_orderkey, price FROM l WHERE n = 2
), prices AS (
  SELECT l.l_orderkey, n, place, price, bool_or(abs(f.amount - CAST(price AS DOUBLE)) < greatest(0.5::DOUBLE, CAST(price AS DOUBLE) * 0.005::DOUBLE)) AS structured, bool_or(abs(f.amount - CAST(price AS DOUBLE)) <= 0.02::DOUBLE * f.amount) AS derived
  FROM l LEFT JOIN f USING (l_orderkey) GROUP BY ALL
), rates AS (
  SELECT l.l_orderkey, l.n, l.place, l.off, bool_or(l.off = o.tax) AS derived FROM l JOIN l o USING (l_orderkey) GROUP BY ALL
)
SELECT l_orderkey, CAST(place * 3 - 2 AS INTEGER) AS pos, CAST(price AS VARCHAR) AS value, '元' AS unit,
  CASE WHEN structured THEN 'structured' WHEN derived THEN 'derived' WHEN EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = p.l_orderkey AND s.amount = p.price) THEN 'text' WHEN n = 4 THEN 'disclosed' ELSE 'untraceable' END AS status FROM prices p
UNION ALL SELECT l_orderkey, CAST(place * 3 - 1 AS INTEGER), CAST(off AS VARCHAR), '%', CASE WHEN derived THEN 'derived' WHEN n = 4 THEN 'disclosed' ELSE 'untraceable' END FROM rates""")


def honesty(df: DataFrame) -> DataFrame:
    known = T.known_sources(df.select("o_orderkey", F.col("source").alias("text")), "o_orderkey", {"caijing.example": "财经台"})
    found = T.source_honesty(df.select("o_orderkey", "claim"), known, "o_orderkey", [("甲通讯", "甲社")])
    return df.select("o_orderkey").join(found.select("o_orderkey", "status"), "o_orderkey", "left")


add_cases(
    "source_honesty", "claim string, source string", ["status"],
    [
        (("https://a.example/{n} 年报", "见 https://a.example/{n}"), ("known",)),
        (("a{n}.example 公告", "http://www.A{n}.example/x"), ("known",)),
        (("财经台年报", "https://m.caijing.example/{n}"), ("known",)),
        (("甲社 {n} 公告", "转自：甲通讯 {n}"), ("known",)),
        (("题为产业观察{n}的报表", "title: 产业观察{n}\nx"), ("known",)),
        (("第{n}号招股书", "https://a.example/{n}"), ("mislabeled",)),
        (("网友{n}", None), ("open",)),
        (("建议以年报{n}为准", ""), ("exempt",)),
        (("公告{n}（未验证）", "x"), ("exempt",)),
        ((None, "来源：x"), (None,)),
    ],
    honesty, P,
)
add_cases(
    "tagged_specs", "text string", ["specs"],
    [
        (('x [CHART_DATA] {"charts": [{"a": {n}}, 5, {"b": {"c": 1}}]} y }',), ('{"a":{n}}|{"b":{"c":1}}',)), (('[CHART_DATA]\n```json\n{"data": [{"v": {n}}]}\n```',), ('{"v":{n}}',)),
        (('{"charts": [{"a": {n}}]}',), ("",)), (('[CHART_DATA] {"charts": [{"a": {n}}',), ("",)), (("[CHART_DATA] none {n}",), ("",)), ((None,), ("",)),
    ],
    lambda df: df.select("o_orderkey", F.array_join(C.tagged_specs(F.col("text")), "|").alias("specs")), P,
)
add_cases(
    "rejected_sources", "text string", ["kept"],
    [
        (("正文{n}，已剔除 www.Bad.com 与 https://x.io/a{n}。\n# 参考文献\n- http://bad.com/1\n- https://x.io/a{n}\n- http://good.com\nbad.com 一句", ), ("正文{n}，已剔除 www.Bad.com 与 https://x.io/a{n}。\n# 参考文献\n- http://good.com\nbad.com 一句",)),
        (("排除 b{n}.cn；\n## 结论\n- b{n}.cn 留下\n## 数据来源\n| b{n}.cn | 1 |\n| c.cn | 2 |\n## 末\n- b{n}.cn",), ("排除 b{n}.cn；\n## 结论\n- b{n}.cn 留下\n## 数据来源\n| c.cn | 2 |\n## 末\n- b{n}.cn",)),
        (("# 来源附录\n- a.com {n}",), ("# 来源附录\n- a.com {n}",)), (("不采用传闻{n}\n# 参考文献\n- a.com",), ("不采用传闻{n}\n# 参考文献\n- a.com",)), ((None,), ("",)),
    ],
    lambda df: df.select("o_orderkey", S.strip_rejected(F.col("text")).alias("kept")), P,
)
add_cases(
    "content_tokens", "text string", ["tokens"],
    [
        (("存储芯片的GPU出货{n}台，AI与x 4.5%",), ("存储|芯片|出货|gpu|ai",)), (("The chip{n} of 市场一家",), ("一家|chip{n}",)), (("价格和销量",), ("价格",)), (("{n}",), ("",)), ((None,), ("",)),
    ],
    lambda df: df.select("o_orderkey", F.array_join(content_tokens(F.col("text"), ["the", "of", "市场"], "的和与"), "|").alias("tokens")), P,
)


def share(text_: str | None, capability: str | None) -> tuple[bool, str]:
    """Fails by an exception on texts without a number after the colon."""
    return int(text_.split(":")[1]) > 50, capability or ""


def registered(df: DataFrame) -> DataFrame:
    checks = [A.Check("long", F.char_length("text") > 3), A.Check("share", A.python_check(share, "text", "tag"), ("report", "chart")), A.Check("digits", F.col("text").rlike("[0-9]"), ("chart",))]
    found = A.registered_checks(df, "o_orderkey", F.array("tag", F.lit("any")), checks)
    told = F.concat("check", F.when(F.col("ok"), "+").otherwise("-"), F.coalesce(F.regexp_extract("detail", "^[^:]*", 0), F.lit("")))
    return found.groupBy("o_orderkey").agg(F.array_join(F.sort_array(F.collect_list(told)), ",").alias("found"))


add_cases(
    "registered_checks", "text string, tag string", ["found"],
    [
        (("part:9{n}", "report"), ("long+,share+report",)), (("part:9{n}", "chart"), ("digits+,long+,share+chart",)), (("part:x{n}", "report"), ("long+,share-ValueError",)),
        (("{n}abc", "chart"), ("digits+,long+,share-IndexError",)), (("abcd{n}", "other"), ("long+",)), ((None, "report"), ("long-,share-AttributeError",)),
    ],
    registered, P,
)


def frames(r: Reader) -> DataFrame:
    """Orders as envelopes of plain fields, as lists, and as files without rows."""
    row: Column = F.to_json(F.struct(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("q")))
    form = F.col("o_orderkey") % 5
    value = F.when(form == 0, text('{"data":', row, "}")).when(form == 1, text('{"data":{"rows":[', row, ',{"k":1}],"k":2}}')).when(form == 2, text("[", row, "]")).when(form == 3, '{"data":{"rows":[]}}').otherwise("no json")
    return R.read_structured_frame(r("orders").sparkSession, r("orders").select(F.col("o_orderkey").cast("string").alias("file"), value.alias("value")), "struct<k:bigint,q:double>", errors=True)


P.add("read_structured_errors", frames, """SELECT CAST(o_orderkey AS VARCHAR) AS file, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey END AS k, CASE WHEN o_orderkey % 5 < 3 THEN o_totalprice END AS q, CASE WHEN o_orderkey % 5 >= 3 THEN o_orderkey || ': no rows' END AS error FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, NULL, NULL FROM orders WHERE o_orderkey % 5 = 1""")

QUERIES, ORACLES = P.queries, P.oracles
