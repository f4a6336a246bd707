"""Report-text queries: every part, order or supplier is written out as a report, and the twin states from the table what must be found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import facts as X
from tessera.operators import reports as S
from tessera.operators.texts import sentences
from tessera.plans.binding import Plans, Reader, dealt
from tessera.plans.sources import text

P = Plans()


def part_reports(r: Reader) -> DataFrame:
    """Each part as a report with a chart block, a table with an empty row, and a feedback block."""
    body = text(
        "# ", F.col("p_name"), '\n[CHART_DATA] {"a": 1}\n\nBody ', F.col("p_brand"), "\n\n| 名称 | 规模（亿美元） | 年份 | 来源 |\n|---|---|---|---|\n| ", F.col("p_type"), " | ", F.col("p_size"), " | ", F.col("p_size") % 20 + 2000,
        " | [site](http://a.example) |\n| empty | — | 2023 | x |\n| open | - | 2023 | http://b.example |\n【历史教训】 1787150053\nmore\n## End\nlast 反思要求重做\ntail",
    )
    return r("part").select(F.col("p_partkey").alias("doc_id"), body.alias("text"))


P.add("md_table_rows", lambda r: S.md_table_rows(part_reports(r)).drop("n", "note"), """SELECT p_partkey AS doc_id, p_type AS label, CAST(p_size AS DOUBLE) AS value, '亿美元' AS unit, p_size % 20 + 2000 AS year, '[site](http://a.example)' AS source FROM part""")


def part_tables(r: Reader) -> DataFrame:
    """Two tables for each part: sizes with shares, years and addresses, and prices whose unit is in the header."""
    k, year = F.col("p_partkey"), F.col("p_size") % 20 + 2000
    first = text("| 指标 | 年份 | 数值 | 占比 | 口径 | 来源 |\n|---|---|---|---|---|---|\n| ", F.col("p_type"), " | ", year, " | ", F.col("p_size"), "亿美元 | ", k % 100, "% | ", F.col("p_brand"), " | 见 http://a.example/", k, " |\n| - | | ", F.col("p_size"), " | 5% | | |")
    second = text("| 品名 | 零售金额（万元） | 链接说明 |\n|:--|--:|:--|\n| ", F.col("p_name"), " | ", F.col("p_size"), ",000 | 2024 |\n| open | 数千 | |")
    return dealt(r("part"), "p_partkey").select(k.alias("doc_id"), text("# ", F.col("p_name"), "\n\n", first, "\n\nText | 5亿元 | more\n\n", second, "\n").alias("text"))


P.add("md_table_facts", lambda r: S.md_table_facts(part_tables(r)), """SELECT p_partkey AS doc_id, 0 AS block, 0 AS n, p_type AS metric, p_size % 20 + 2000 AS year, CAST(p_size AS DOUBLE) AS value, '亿美元' AS unit, p_brand AS caliber, 'http://a.example/' || p_partkey AS source FROM part
UNION ALL SELECT p_partkey, 0, 0, '市场份额', p_size % 20 + 2000, CAST(p_partkey % 100 AS DOUBLE), '%', p_type, 'http://a.example/' || p_partkey FROM part
UNION ALL SELECT p_partkey, 1, 0, '零售金额（万元）', 2024, p_size * 1000.0::DOUBLE, '万元', p_name, '' FROM part""")
P.add("report_scrub", lambda r: S.report_scrub(part_reports(r)), """SELECT p_partkey AS doc_id, '# ' || p_name || '
Body ' || p_brand || '

| 名称 | 规模（亿美元） | 年份 | 来源 |
|---|---|---|---|
| ' || p_type || ' | ' || p_size || ' | ' || (p_size % 20 + 2000) || ' | [site](http://a.example) |
| open | - | 2023 | http://b.example |

## End
tail' AS text FROM part""")
P.add("source_claims", lambda r: part_reports(r).select("doc_id", F.explode(S.source_claims(F.concat("text", F.lit("\n数据来源：彭博资讯，另据财新网报道"))))
      .alias("claim")), """SELECT p_partkey AS doc_id, unnest(['彭博资讯', '名称', '规模（亿美元）', '年份', '来源']) AS claim FROM part""")


def companies(r: Reader) -> DataFrame:
    year = F.col("o_custkey") % 30 + 2000
    form = F.col("o_orderkey") % 4
    goal = F.when(form == 0, text("分析华润集团", year, "年与2019年的财务")).when(form == 1, text("总结小米公司", year, "年业绩")).when(form == 2, text("腾讯年报", year)).otherwise("no year")
    return r("orders").select("o_orderkey", S.company(goal).alias("company"), S.years(goal).alias("y")).select("o_orderkey", "company", F.col("y.first").alias("first_year"), F.col("y.last").alias("last_year"))


P.add("company_years", companies, """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '华润' WHEN 1 THEN '小米' WHEN 2 THEN '腾讯' ELSE '' END AS company,
CASE o_orderkey % 4 WHEN 0 THEN CAST(least(2019, o_custkey % 30 + 2000) AS INTEGER) WHEN 3 THEN NULL ELSE o_custkey % 30 + 2000 END AS first_year, CASE o_orderkey % 4 WHEN 0 THEN CAST(greatest(2019, o_custkey % 30 + 2000) AS INTEGER) WHEN 3 THEN NULL ELSE o_custkey % 30 + 2000 END AS last_year FROM orders""")
P.add("kb_id_of", lambda r: r("supplier").select("s_suppkey", S.kb_id(F.when(F.col("s_suppkey") % 3 == 0, text("see [kb:base-", F.col("s_nationkey"), "] kb_id=no")).when(F.col("s_suppkey") % 3 == 1, text("kb_id=k_", F.col("s_suppkey"), ".")).otherwise(F.col("s_name"))).alias("kb_id")),
      "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'base-' || s_nationkey WHEN 1 THEN 'k_' || s_suppkey END AS kb_id FROM supplier")


def media(r: Reader) -> DataFrame:
    claim = text("来自 ", F.col("url"), " 的每日新网、财新网 与 公司年报")
    return r("pages").select("page_id", F.inline(S.media_suggestions(claim, ("财新网",))))


P.add("media_suggest", media, r"SELECT page_id, '的每日新网' AS word, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/]+)', 1)), '^www\.', '') AS host FROM pages")


def cases(r: Reader) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    row = F.struct(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("goal"), F.when(k % 2 == 0, "report").alias("expected_deliverable"), F.when(k % 3 == 0, F.array(F.col("role"))).otherwise(F.array().cast("array<string>")).alias("ground_truth_points"), F.when(k % 5 != 0, F.struct(F.lit(1).alias("w"))).alias("rubric"))
    return r("conversations").select("conv_id", "turn", F.array_join(S.case_issues(F.to_json(row)), ",").alias("issues"))


P.add("eval_case_check", cases, """SELECT conv_id, turn, concat_ws(',', CASE WHEN coalesce(text, '') IN ('', '[]', '{}') THEN 'goal' END, CASE WHEN (conv_id + turn) % 2 <> 0 THEN 'expected_deliverable' END,
CASE WHEN (conv_id + turn) % 3 <> 0 THEN 'ground_truth_points' END, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'rubric' END) AS issues FROM conversations""")


def rules(r: Reader) -> DataFrame:
    form = F.col("p_partkey") % 5
    rule = F.when(form == 0, text("exclude: ", F.upper("p_brand"))).when(form == 1, text("Prefer:", F.col("p_brand"))).when(form == 2, text("排除", F.col("p_type"))).when(form == 3, text("优先 ", F.col("p_type"))).otherwise(F.col("p_name"))
    return S.strategy_rules(r("part").select(F.col("p_partkey").alias("id"), rule.alias("rule")))


P.add("strategy_rules", rules, """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 IN (0, 2) THEN 'block' ELSE 'boost' END AS kind, lower(trim(CASE WHEN p_partkey % 5 < 2 THEN p_brand ELSE p_type END)) AS word FROM part WHERE p_partkey % 5 <> 4""")


def normalized(r: Reader) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("亿美元", "万亿元", "HK$", "万台", "%")]), F.col("p_partkey").cast("int") % 5 + 1)
    return r("part").select("p_partkey", S.scaled(F.format_number(F.col("p_size") * 1000, 0), unit).alias("s")).select("p_partkey", "s.*")


P.add("number_normalize", normalized, """SELECT p_partkey, p_size * 1000 * [1e8, 1e12, 1, 1e4, 1][p_partkey % 5 + 1]::DOUBLE AS amount, ['usd', 'cny', 'hkd', '万台', '%'][p_partkey % 5 + 1] AS unit_group FROM part""")
METRICS = {"market_size": "市场规模", "market_share": "市场份额"}


def plots(r: Reader) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "market_size").when(F.col("p_size") % 3 == 1, "market_share").otherwise("other")
    year, label = F.when(F.col("p_size") % 2 == 0, F.lit(2001)), text(F.col("p_name"), " 2024")
    facts = r("part").select(kind.alias("type"), label.alias("label"), F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("value"), F.col("p_brand").alias("unit"), year.alias("year"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("source"), F.when(F.col("p_size") > 40, "series").alias("series"))
    return S.plot_rows(facts, METRICS)


P.add("plot_rows", plots, """SELECT CASE WHEN p_size > 40 THEN 'series' WHEN p_size % 3 = 0 THEN '市场规模' WHEN p_size % 3 = 1 THEN '市场份额' ELSE p_name || ' 2024' END AS metric, p_retailprice AS value, p_brand AS unit,
CASE WHEN p_size % 2 = 0 THEN 2001 ELSE 2024 END AS year, p_name || ' 2024' AS note, CASE WHEN p_size > 10 THEN p_type ELSE '检索资料' END AS source FROM part WHERE p_size <> 7""")
#: The cache key is defined over the first 500 characters of the prompt.
P.add("cache_key", lambda r: r("conversations").select("conv_id", "turn", F.concat(F.lit("llm_cache:"), F.coalesce("role", F.lit("default")), F.lit(":"), F.sha2(F.substring(F.coalesce("text", F.lit("")), 1, 500), 256)).alias("cache_key")),
      "SELECT conv_id, turn, 'llm_cache:' || coalesce(role, 'default') || ':' || sha256(substr(coalesce(text, ''), 1, 500)) AS cache_key FROM conversations")


#: Sentences around a figure, {} in its place, and the facts that they state: (sentence, kind, label, sign, unit).
STATED = (
    ("显卡占有约{}%的市场份额", "share", "显卡", "", "%"),
    ("在日本存储市场甲厂的份额为{}%，乙厂落后", "share", "甲厂", "", "%"),
    ("边缘设备出货量仅占{}%", "share", "边缘设备出货量", "", "%"),
    ("丙厂拥有{}%的份额", "share", "丙厂", "", "%"),
    ("中国充电桩装机量已达{}万台", "macro", "充电桩装机量", "", "万台"),
    ("去年（2023年电动车销量为{}万）", "macro", "电动车销量", "", "万"),
    ("云服务调用量超过{}亿次", "macro", "云服务调用量", "", "亿次"),
    ("服务器营收同比增长{}%", "trend", "服务器营收", "", "%"),
    ("而2024年中国家电的销量同比下滑{}%", "trend", "家电销量", "-", "%"),
    ("存储芯片走势分化，出货量环比回落{}%", "trend", "存储芯片出货量", "-", "%"),
    ("面板成为焦点，增速为{}%", "trend", "面板增速", "", "%"),
    ("门票价格为{}元，折扣{}%", "none", "", "", ""),
)
#: (sentence, theme, sign, unit, year, region, kind)
SIZES = (
    ("2024年中国逻辑芯片市场规模将达到{}亿元", "逻辑芯片市场", "", "亿元", "2024", "'中国'", "chip"),
    ("其中家电销售额约{}万美元", "中家电", "", "万美元", "NULL", "NULL", "overall"),
    ("2022年，丁公司亏损{}亿元", "丁公司", "-", "亿元", "2022", "NULL", "overall"),
    ("供应紧张而据德勤预测2025年全球服务器销售规模约{}亿美元", "德勤服务器市场", "", "亿美元", "2025", "'全球'", "overall"),
    ("欧洲的市场规模约为{}万亿美元", "市场规模", "", "万亿美元", "NULL", "'欧洲'", "overall"),
)


def fact_texts(r: Reader, forms: tuple) -> DataFrame:
    """Each part as a text whose second sentence is one of the forms with the part's size as figure."""
    bodies = [F.replace(F.lit(f"前言。{form[0]}。"), F.lit("{}"), F.col("p_size").cast("string")) for form in forms]
    return r("part").select(F.col("p_partkey").alias("doc_id"), F.element_at(F.array(*bodies), (F.col("p_partkey") % len(forms) + 1).cast("int")).alias("text"))


LEXICON = X.Lexicon()


def sizes(r: Reader) -> DataFrame:
    found = X.extract_amounts(sentences(fact_texts(r, SIZES)), LEXICON)
    return found.select("doc_id", "theme", "value", "unit", "year", "region", X.theme_kind(F.col("theme")).alias("kind"))


P.add("size_theme", sizes, " UNION ALL ".join(
    f"SELECT p_partkey AS doc_id, '{theme}' AS theme, {sign}CAST(p_size AS DOUBLE) AS value, '{unit}' AS unit, CAST({year} AS INTEGER) AS year, {region} AS region, '{kind}' AS kind FROM part WHERE p_partkey % {len(SIZES)} = {i}"
    for i, (_, theme, sign, unit, year, region, kind) in enumerate(SIZES)
))
for kind_, found_ in (("share", X.extract_shares), ("macro", X.extract_indicators), ("trend", X.extract_trends)):
    P.add(f"extract_{kind_}", lambda r, found=found_: found(sentences(fact_texts(r, STATED)), LEXICON), " UNION ALL ".join(
        f"SELECT p_partkey AS doc_id, 1 AS pos, '{label}' AS label, {sign}CAST(p_size AS DOUBLE) AS value, '{unit}' AS unit FROM part WHERE p_partkey % {len(STATED)} = {i}"
        for i, (_, kind, label, sign, unit) in enumerate(STATED) if kind == kind_
    ))
P.add("norm_sentence", lambda r: r("part").select("p_partkey", X.norm_sentence(text("市 场 ", F.col("p_size"), " 亿 元, ok  两 空")).alias("sentence")), "SELECT p_partkey, '市场' || p_size || '亿元, ok  两空' AS sentence FROM part")
P.add("clean_label", lambda r: r("orders").select("o_orderkey", X.clean_label(text("其中预计", F.col("o_custkey") % 30 + 2000, "年全球", F.col("o_orderpriority")), LEXICON).alias("label")), "SELECT o_orderkey, o_orderpriority AS label FROM orders")

QUERIES, ORACLES = P.queries, P.oracles
