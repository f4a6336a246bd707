"""Queries of the checks: every order takes one of several cases, and the twin states what the rule must say of it.

``{n}`` in a text is the order's customer number, so texts differ by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.plans.binding import LOG_SQL, Plans, Reader, dealt, task_log

P = Plans()


def staged(r: Reader, given: str, rows: list[tuple]) -> DataFrame:
    """orders (o_orderkey, o_custkey) with the given columns of case o_orderkey % number of cases."""
    spark = r("orders").sparkSession
    cases = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"form int, {given}")
    filled = [F.replace(c, F.lit("{n}"), F.col("o_custkey").cast("string")).alias(c) if t == "string" else F.col(c) for c, t in cases.dtypes if c != "form"]
    orders = r("orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % len(rows)).cast("int").alias("form"))
    return dealt(orders, "o_orderkey").join(F.broadcast(cases), "form").select("o_orderkey", *filled)  # a few fixed rows


class Rule(str):
    """A wanted value in SQL over orders, where it depends on the digits of the customer number."""


def literal(value: object) -> str:
    if isinstance(value, Rule):
        return value
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]::VARCHAR[]"
    if not isinstance(value, str):
        return str(value)
    return " || o_custkey || ".join("'" + part.replace("'", "''") + "'" for part in value.split("{n}"))


def add_cases(name: str, given: str, wanted: list[str], cases: list[tuple[tuple, tuple]], check: Callable[[DataFrame], DataFrame], plans: Plans = P) -> None:
    """Registers a query over staged cases ((given values), (wanted values)) and its twin."""
    columns = []
    for i, column in enumerate(wanted):
        arms = " ".join(f"WHEN {k} THEN {literal(out[i])}" for k, (_, out) in enumerate(cases))
        columns.append(f"CASE o_orderkey % {len(cases)} {arms} END AS {column}")
    sql = f"SELECT o_orderkey, {', '.join(columns)} FROM orders"
    plans.add(name, lambda r: check(staged(r, given, [row for row, _ in cases])), sql)


#: A run of digits 20xx is a year wherever it stands, in a customer number too.
YEAR_2026 = "coalesce(list_max(list_transform(regexp_extract_all(CAST(o_custkey AS VARCHAR), '20[0-9]{2}'), lambda y: CAST(y AS INTEGER))) >= 2026, false)"

BODY = "全文第{n}段，本段说明市场概况与主要企业的经营情况，并列出数据来源与统计口径，供读者核对。报告共分三章，逐章说明。"
TABLE = "| 名称 | 数值 |\n|---|:-:|\n"
add_cases(
    "completeness_check", "report string, goal string", ["passed", "marks", "has_table", "all_marks", "list_wanted"],
    [
        ((BODY, "总结{n}"), (True, 0, False, False, False)),
        ((BODY, "列出前十企业"), (False, 0, False, False, True)),
        ((f"{BODY}\n{TABLE}| 甲{{n}} | 5 |\n| 乙 | 暂无 |", "排名"), (True, 1, True, False, True)),
        ((f"{BODY}\n{TABLE}| 暂缺 | 待补充 |", "TOP 10 of {n}"), (False, 2, True, True, True)),
        ((f"{TABLE}| 甲 | 暂无数据 |\n| 乙 | 未披露 |", "分析"), (False, 3, True, False, False)),
        ((f"  {TABLE}", "榜单"), (True, 0, True, False, True)),
        (("| 暂无 | 未获取 |", "明细"), (False, 2, True, True, True)),
        ((None, "清单"), (False, 0, False, False, True)),
        (("text | with one bar", None), (True, 0, False, False, False)),
    ],
    lambda df: df.select("o_orderkey", C.completeness(F.col("report"), F.col("goal")).alias("s")).select("o_orderkey", "s.*"),
)
add_cases(
    "report_gaps", "report string", ["gaps"],
    [(("价格待获取{n}",), (["待获取"],)), (("完整{n}",), ([],)), (("需重跑搜索：数据未获取",), (["数据未获取", "需重跑搜索"],)), ((None,), ([],))],
    lambda df: df.select("o_orderkey", C.gap_marks(F.col("report")).alias("gaps")),
)
add_cases(
    "too_short_report", "report string", ["short"],
    [
        ((BODY + "\n" + BODY,), (False,)), ((None,), (True,)), (("  \n\n short {n} \n",), (True,)),
        (('{"error": "the service said no, and said it at length: {n}"}',), (True,)), (('{"title": "a long enough object without such a field, number {n}"}',), (False,)),
        (("# heading one {n}\n## heading two that is long enough to pass fifty\nbody",), (True,)), (("# heading {n}\n" + "body text with words " * 4,), (False,)),
        (("# heading\n" * 40 + "x",), (False,)), (("  " + "x" * 49 + " \n",), (True,)), (("x" * 50,), (False,)),
    ],
    lambda df: df.select("o_orderkey", C.too_short(F.col("report")).alias("short")),
)
add_cases(
    "recency_check", "goal string, report string, results string, retrieved string, today string", ["passed", "reason"],
    [
        (("最新财报", "报告日期：2026-01-02 {n}", "2026", "2026-08-11", "2026-08-12"), (False, "stale_date")),
        (("最新财报", "数据截至 2026年8月5日 {n}", None, "2026-08-11", "2026-08-12"), (True, "recent")),
        (("当前价格", "更新时间: 2026/8/1", None, "2026-08-11", "2026-08-12"), (False, "stale_date")),
        (("当前价格", "历史 2020-01-01", None, "2026-08-11", "2026-08-12"), (True, "date_only")),
        (("latest report", "旧闻 2024", "2025 news {n}", "2026-08-11", "2026-03-01"), (Rule(YEAR_2026), Rule(f"CASE WHEN {YEAR_2026} THEN 'recent' ELSE 'stale_year' END"))),
        (("latest report", "旧闻 2024", "2025 news", "2026-08-11", "2026-02-28"), (True, "recent")),
        (("最近动态", "没有年份", None, None, "2026-08-12"), (False, "no_year")),
        (("历史回顾 {n}", "报告日期：2020-01-02", None, "2026-08-11", "2026-08-12"), (True, "not_asked")),
        (("最新", "截至2026年8月，{n}", None, "2026-08-09", "2026-08-12"), (False, "stale_date")),
        (("最新", "截至2026年13月 2026", None, "2026-08-09", "2026-08-12"), (True, "recent")),
    ],
    lambda df: df.select("o_orderkey", C.recency(F.col("goal"), F.col("report"), F.col("results"), F.col("retrieved").cast("date"), F.col("today").cast("date")).alias("s")).select("o_orderkey", "s.*"),
)
CONTRACTS = {
    "search": C.Contract(required=("title", "url")), "load": C.Contract(required=("rows", "columns"), failed=("error", "failed")), "write": C.Contract(least=20, contains="#"),
}
add_cases(
    "contract_check", "capability string, raw string", ["issues"],
    [
        (("search", '[{"title": "a{n}", "url": "u"}]'), ([],)), (("search", "[]"), (["empty list"],)),
        (("search", '[{"title": "a", "url": " "}, {"title": "b", "url": "u"}, {"url": null}]'), (["item lacks url", "item lacks title"],)),
        (("search", '[{"url": "u"}, "x", {"title": ""}]'), (["item lacks title", "item is no object"],)),
        (("load", '{"status": "Error", "error": "disk {n}", "rows": 3}'), (["failed: disk {n}", "lacks columns"],)),
        (("load", '{"status": "failed", "rows": 3, "columns": 2}'), (["failed: no detail"],)), (("load", '{"status": "ok", "rows": 0, "columns": 2}'), ([],)),
        (("write", "# a report that is long enough"), ([],)), (("write", "short {n}"), (["too short", "lacks #"],)),
        (("write", None), (["too short", "lacks #"],)), (("other", "anything"), ([],)),
        (("search", "[{}, {}, {}, {}, {}, {}, {}]"), (["item lacks title"] * 5,)),
    ],
    lambda df: df.select("o_orderkey", C.contract_issues(F.col("capability"), F.col("raw"), CONTRACTS).alias("issues")),
)
add_cases(
    "error_class", "capability string, text string, violated boolean", ["kind", "reason"],
    [
        (("search", "Read timeout after {n} s", False), ("TIMEOUT", "generic")), (("search", "http-404 for {n}", False), ("HTTP_404", "generic")),
        (("search", "HTTP 403 forbidden", False), ("HTTP_403", "HTTP_403")), (("search", "结果: 未找到 {n}", False), ("SEARCH_EMPTY", "generic")),
        (("code_execution", "Traceback (line {n})", False), ("CODE_RUNTIME_ERROR", "generic")), (("search", "Traceback (line {n})", False), ("GENERIC_FAILURE", "generic")),
        (("report_generator", "Output Too Short: {n}", False), ("OUTPUT_TOO_SHORT", "generic")), (("search", "fine", True), ("CONTRACT_VIOLATION", "generic")),
        (("search", None, None), ("GENERIC_FAILURE", "generic")), (("chat", "Empty content from model", False), ("GENERIC_FAILURE", "empty_content")),
        (("chat", "Network error: request timed out", False), ("GENERIC_FAILURE", "timeout")), (("chat", "network error {n}", False), ("GENERIC_FAILURE", "network_error")),
    ],
    lambda df: df.select("o_orderkey", C.error_class(F.col("capability"), F.col("text"), F.col("violated")).alias("kind"), C.endpoint_reason(F.col("text")).alias("reason")),
)
add_cases(
    "fix_suggestion", "kind string, capability string, other string, instruction string", ["suggestion"],
    [
        (("HTTP_500", "search", None, None), (C.SUGGESTIONS["HTTP"],)), (("TIMEOUT", "search", None, "x"), (C.SUGGESTIONS["TIMEOUT"],)),
        (("SEARCH_EMPTY", "search", "fetch", "读取{n}"), ("改用 fetch 替代 search",)), (("SEARCH_EMPTY", "search", "fetch{n}", "结构化数据"), ("改用 fetch{n} 替代 search（优先结构化数据源）",)),
        (("GENERIC_FAILURE", "search", None, None), (C.OTHER_SUGGESTION,)), (("CODE_RUNTIME_ERROR", "code", None, None), (C.SUGGESTIONS["CODE_RUNTIME_ERROR"],)),
    ],
    lambda df: df.select("o_orderkey", C.fix_suggestion(F.col("kind"), F.col("capability"), F.col("other"), F.col("instruction")).alias("suggestion")),
)
LONG = "version {n} " + "x" * 390
add_cases(
    "regression_guard", "old string, new string", ["worse"],
    [
        ((LONG, LONG), (False,)), ((LONG, "y" * 100), (True,)), ((LONG, "a Fallback text " + LONG), (True,)), (("fallback " + LONG, "fallback " + LONG), (False,)),
        (("short", "s"), (False,)), ((LONG, None), (True,)), ((None, LONG), (False,)), (("x" * 300, "y" * 120), (False,)), (("x" * 300, "y" * 119), (True,)),
    ],
    lambda df: df.select("o_orderkey", C.redo_worse(F.col("old"), F.col("new")).alias("worse")),
)
FIELDS = '"title": "t{n}", "unit": "u", "source": "s", "x_axis_title": "x", "y_axis_title": "y", "conclusion": "c"'
ROWS = '[{"label": "a", "value": 1}, {"label": "b", "value": 2}]'
add_cases(
    "chart_spec_check", "spec string", ["issues"],
    [
        ((f'{{"type": "bar", {FIELDS}, "data": {ROWS}}}',), ([],)), ((f'{{"type": "radar", {FIELDS}, "data": {ROWS}}}',), (["type"],)),
        ((f'{{"type": "pie", "title": " ", "data": {ROWS}}}',), (["title", "unit", "source", "x_axis_title", "y_axis_title", "conclusion"],)),
        ((f'{{"type": "line", {FIELDS}}}',), (["no data"],)), ((f'{{"type": "line", {FIELDS}, "data": [{{"label": "a", "value": 1}}]}}',), (["one data row"],)),
        ((f'{{"type": "line", {FIELDS}, "data": [{{"label": "a", "value": 1}}, {{"label": "b"}}]}}',), (["label or value"],)),
        (('["x"]',), (["no object"],)), (("not json {n}",), (["no object"],)),
    ],
    lambda df: df.select("o_orderkey", C.spec_issues(F.try_parse_json("spec")).alias("issues")),
)
add_cases(
    "short_label", "label string, caliber string, source string", ["short"],
    [
        (("机构{n}", None, None), ("机构{n}",)), (("这是一个长标签，后面还有更多的说明文字", None, None), ("这是一个长标签",)),
        (("这是一个没有标点而且很长很长的标签文字", "短口径", None), ("短口径",)), (("这是一个没有标点而且很长很长的标签文字", "口径甲（含税）说明很长很长", None), ("口径甲",)),
        (("这是一个没有标点而且很长很长的标签文字", None, "https://www.example.org/a{n}"), ("example.org",)), (("这是一个没有标点而且很长很长的标签文字", None, "press"), ("这是一个没有标点而且很长",)),
        ((" ", "x", None), ("?",)), ((None, None, None), ("?",)),
    ],
    lambda df: df.select("o_orderkey", C.short_label(F.col("label"), F.col("caliber"), F.col("source")).alias("short")),
)
add_cases(
    "noise_label_filter", "label string", ["noise"],
    [(("手机{n}",), (False,)), (("行业报告{n}",), (True,)), (("a - b",), (True,)), (("a-b",), (False,)), (("2020–2024",), (True,)), ((None,), (False,))],
    lambda df: df.select("o_orderkey", C.noise_label(F.col("label")).alias("noise")),
)
add_cases(
    "series_key", "metric string, caliber string, title string", ["series", "key"],
    [
        (("推理芯片市场规模", None, "全球 Chip 规模预测（2024年）{n}"), ("市场规模", "全球chip规模{n}")), (("全球芯片市场规模", None, "2024年规模"), ("全球芯片市场规模", "2024规模")),
        (("推理芯片市场规模", "全口径", "A·B（x)"), ("推理芯片市场规模", "ab")), (("利润{n}", None, "统计口径对比"), ("利润{n}", "")),
        (("汽车出货量", "其他", None), ("出货量", "")), (("出货量", "", " - "), ("出货量", "")),
    ],
    lambda df: df.select("o_orderkey", C.series_of(F.col("metric"), F.col("caliber")).alias("series"), C.title_key(F.col("title")).alias("key")),
)
add_cases(
    "ticker_code", "code string", ["full_code", "bare"],
    [
        (("600{n}",), ("sh600{n}", "600{n}")), ((" 000001 ",), ("sz000001", "000001")), (("300{n}",), ("sz300{n}", "300{n}")), (("830799",), ("bj830799", "830799")),
        (("sh600519",), ("sh600519", "600519")), (("SZ000001",), ("SZ000001", "000001")), (("usAAPL",), ("usAAPL", "AAPL")), (("510",), ("510", "510")), (("hk",), ("hk", "hk")),
    ],
    lambda df: df.select("o_orderkey", C.exchange_code(F.col("code")).alias("full_code"), C.bare_code(F.col("code")).alias("bare")),
)
add_cases(
    "unsafe_flag", "text string", ["found"],
    [(("教程{n}",), ([],)), (("如何制毒、抢银行 {n}",), (["抢银行", "制毒"],)), (("赌博网站赌博网站",), (["赌博网站"],)), ((None,), ([],))],
    lambda df: df.select("o_orderkey", C.unsafe_words(F.col("text")).alias("found")),
)
add_cases(
    "stated_numbers", "text string", ["figures"],
    [
        (("营收12.5亿元，增长 8%，共3家 c{n}",), (["12.5 亿元", "8 %"],)), (("规模1,383，2024年，代码00700与0700.HK",), (["1383 "],)),
        (("![图5000](a/6000.png) https://x.cn/7000 C:\\d\\8000 文9000",), (["9000 "],)), (("abc12345 和 99万 美元",), (["99 万美元"],)), ((None,), ([],)), (("1.5万亿 US$",), (["1.5 万亿US$"],)),
    ],
    lambda df: df.join(C.stated_numbers(df, "o_orderkey").groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(" ", "value", "unit").alias("f")))), lambda s: s["f"]).alias("figures")), "o_orderkey", "left").select("o_orderkey", F.coalesce("figures", F.array().cast("array<string>")).alias("figures")),
)
add_cases(
    "loose_json", "text string", ["found"],
    [
        (('say {"a": {"b": {n}}} and {"c": 1}',), ('{"a": {"b": {n}}}',)), (('```json\n{"a": {n}}\n``` {"z": 1}',), ('{"a": {n}}',)), (('{"a": 1',), (None,)),
        (("no object {n}",), (None,)), (("{not json} {}",), (None,)), ((None,), (None,)), (("x {} y",), ("{}",)),
    ],
    lambda df: df.select("o_orderkey", C.balanced_json(F.col("text")).alias("found")),
)


def artifacts(r: Reader) -> DataFrame:
    """Four files of every customer: one that failed before it passed, one that only failed, one that passed."""
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(ok).alias("passed")) for n, ok in (("out/index_1786354743.html", False), ("index_1786354799.html", True), ("chart_12.png", False), ("data.v2.csv", True))])
    return r("customer").select("c_custkey", F.inline(names))


P.add("supersede_failed", lambda r: C.prune_superseded(artifacts(r), ["c_custkey"]), """SELECT c_custkey, name, passed, artifact FROM customer,
(VALUES ('index_1786354799.html', true, 'index'), ('chart_12.png', false, 'chart_12'), ('data.v2.csv', true, 'data.v2')) f(name, passed, artifact)""")


def final_statuses(r: Reader) -> DataFrame:
    log = task_log(r)
    steps = log.select("agent", (F.col("failed") & (F.col("tokens") > 90)).alias("failed"), (F.col("tokens") == 7).alias("both_failed"))
    audits = log.where("model = 'purchase'").select("agent", F.struct("ts", "id").alias("at"), F.when(F.col("tokens") % 2 == 0, "pass").otherwise("fail").alias("overall"))
    return C.final_status(steps, audits, "agent")


P.add("final_status", final_statuses, f"""{LOG_SQL}, last AS (
  SELECT agent, arg_max(CASE WHEN tokens % 2 = 0 THEN 'pass' ELSE 'fail' END, (ts, id)) AS overall FROM log WHERE model = 'purchase' GROUP BY agent
), s AS (SELECT agent, bool_or(coalesce(failed AND tokens > 90, false)) AS f, bool_or(coalesce(tokens = 7, false)) AS b FROM log GROUP BY agent)
SELECT agent, CASE WHEN f THEN 'FAILED' WHEN b OR coalesce(overall <> 'pass', false) THEN 'SUCCESS_WITH_ISSUES' ELSE 'SUCCESS' END AS status FROM s LEFT JOIN last USING (agent)""")


def variants(r: Reader) -> DataFrame:
    return C.ab_report(task_log(r).select(F.when(F.col("agent") % 5 == 0, "candidate").otherwise("baseline").alias("variant"), (~F.col("failed")).alias("success"), "latency"))


AB_SIDE = """count(*) FILTER (variant = '{0}') AS {0}_runs, coalesce(round(avg(ok) FILTER (variant = '{0}'), 6), 0.0) AS {0}_rate, round(avg(latency) FILTER (variant = '{0}'), 4) AS {0}_latency,
CASE WHEN count(latency) FILTER (variant = '{0}') > 1 THEN round(stddev_samp(latency) FILTER (variant = '{0}'), 4) ELSE 0.0 END AS {0}_std"""
P.add("ab_compare", variants, f"""{LOG_SQL}, v AS (SELECT CASE WHEN agent % 5 = 0 THEN 'candidate' ELSE 'baseline' END AS variant, CASE WHEN failed THEN 0 ELSE 1 END AS ok, latency FROM log),
s AS (SELECT {AB_SIDE.format("baseline")}, {AB_SIDE.format("candidate")} FROM v), u AS (SELECT *, round(candidate_rate - baseline_rate, 6) AS uplift FROM s)
SELECT *, abs(uplift) > 0.05 AS significant, CASE WHEN uplift > 0.05 THEN 'switch' WHEN uplift > 0 THEN 'watch' ELSE 'roll_back' END AS decision FROM u""")


def idle(r: Reader) -> DataFrame:
    agents = task_log(r).groupBy("agent").agg(F.max("ts").alias("last_heartbeat")).select(
        "agent", "last_heartbeat", F.when(F.col("agent") % 3 == 0, "busy").when(F.col("agent") % 3 == 1, "idle-2").otherwise("active:7").alias("status"),
        F.concat(F.lit("search , cap"), F.col("agent") % 4, F.lit(", cap"), F.col("agent") % 4).alias("capabilities"),
    )
    return C.idle_agents(agents, r("nation").select(F.concat(F.lit("cap"), F.col("n_nationkey") % 6).alias("capability")))


P.add("oldest_idle_agent", idle, f"""{LOG_SQL}, a AS (SELECT agent, max(ts) AS seen FROM log GROUP BY agent),
f AS (SELECT 'cap' || (agent % 4) AS capability, agent FROM a WHERE agent % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY agent % 4 ORDER BY seen, agent) = 1)
SELECT capability, agent FROM (SELECT DISTINCT 'cap' || (n_nationkey % 6) AS capability FROM nation) LEFT JOIN f USING (capability)""")
P.add(
    "system_status",
    lambda r: C.system_status(r("orders").select(F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("OPEN").alias("status"), F.col("o_orderdate").alias("at")), r("supplier").select((F.col("s_acctbal") > 0).alias("online"))),
    """SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS success,
(SELECT count(*) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOUR) AS recent, (SELECT round(count(*) FILTER (s_acctbal > 0) * 100.0 / count(*), 1) FROM supplier) AS survival""",
)
P.add(
    "system_status_queues",
    lambda r: C.system_status(
        r("orders").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("OPEN").alias("status"), F.col("o_orderdate").alias("at")),
        r("nation").select(F.col("n_nationkey").alias("agent"), (F.col("n_regionkey") > 0).alias("online")), queued=r("customer").select(F.col("c_nationkey").alias("agent")),
    ).select("total", "success", "recent", "survival", F.to_json("queues").alias("queues"), F.array_join(F.col("newest").cast("array<string>"), ",").alias("newest")),
    """SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS success, (SELECT count(*) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOUR) AS recent,
(SELECT round(count(*) FILTER (n_regionkey > 0) * 100.0 / count(*), 1) FROM nation) AS survival, (SELECT '{' || string_agg('"' || n_nationkey || '":' || n, ',' ORDER BY n_nationkey) || '}' FROM (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)) AS queues,
(SELECT string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey DESC) FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5)) AS newest""",
)
P.add(
    "critic_stats",
    lambda r: C.critic_stats(task_log(r).select("agent", F.when(F.col("tokens") % 4 > 0, "PASS").when(F.col("tokens") % 8 == 0, "FAIL").alias("verdict"), F.when(F.col("tokens") % 5 > 0, F.create_map(F.lit("a"), F.col("latency"), F.lit("b"), F.col("tokens").cast("double"))).alias("scores")), "agent"),
    f"{LOG_SQL} SELECT agent, count(*) FILTER (coalesce(tokens % 4 > 0, false)) AS passed, count(*) FILTER (NOT coalesce(tokens % 4 > 0, false)) AS rejected, min(coalesce(CASE WHEN tokens % 5 > 0 THEN least(latency, CAST(tokens AS DOUBLE)) END, 10.0)) AS min_score FROM log GROUP BY agent",
)
P.add(
    "replan_counts",
    lambda r: C.replan_counts(task_log(r).select("capability", F.concat(F.when(F.col("model") == "click", "alt-").otherwise("step-"), F.col("id")).alias("step"), F.when(F.col("tokens") % 2 == 0, "SUCCESS").otherwise("FAILED").alias("task_status")), "capability"),
    f"{LOG_SQL} SELECT capability, count(*) FILTER (model = 'click') AS replans, count(*) FILTER (model = 'click' AND tokens % 2 = 0) AS credited FROM log GROUP BY capability",
)
P.add(
    "memory_chars",
    lambda r: C.memory_chars(r("conversations").select("conv_id", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("历史背景："), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit("。成功解决路径"))).otherwise(F.col("text")).alias("result")), "conv_id"),
    "SELECT conv_id, CAST(coalesce(sum(CASE turn % 3 WHEN 0 THEN length(text) + 5 WHEN 1 THEN length(text) + 7 END), 0) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
)


def ordered_parts(r: Reader) -> DataFrame:
    """The parts of a brand as chart rows; the labels of half the brands are years."""
    years = F.substring("p_brand", -1, 1).cast("int") % 2 == 0
    label = F.when(years, (F.col("p_size") + 1990).cast("string")).otherwise(F.col("p_name"))
    return C.chart_order(r("part").select("p_brand", F.col("p_partkey").alias("pos"), label.alias("label"), F.col("p_retailprice").alias("value")), "p_brand")


P.add("chart_order", ordered_parts, """WITH c AS (SELECT p_brand, p_partkey AS pos, CAST(right(p_brand, 1) AS INTEGER) % 2 = 0 AS years, p_size, p_name, p_retailprice AS value FROM part)
SELECT p_brand, pos, CASE WHEN years THEN CAST(p_size + 1990 AS VARCHAR) ELSE p_name END AS label, value,
  CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN years THEN NULL ELSE -value END NULLS LAST, pos) AS INTEGER) AS place FROM c""")


def calendar(r: Reader) -> DataFrame:
    jobs = r("orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("start"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 5 * 240).cast("int").alias("minutes"),
        F.when(F.col("o_orderkey") % 3 == 1, "9:30").when(F.col("o_orderkey") % 3 == 2, "00:00").alias("at"),
    ).withColumn("minutes", F.when(F.col("minutes") == 0, 600).otherwise(F.col("minutes")))
    due = C.due_times(jobs, F.col("start") + F.expr("interval 2 days"))
    return due.groupBy("job_id").agg(F.count("*").alias("runs"), F.min("due").cast("timestamp_ntz").alias("first_due"), F.max("due").cast("timestamp_ntz").alias("last_due"))


P.add("schedule_daily", calendar, """WITH j AS (SELECT o_orderkey AS job_id, CAST(o_orderdate AS TIMESTAMP) AS s, CASE WHEN o_custkey % 5 = 0 THEN 600 ELSE o_custkey % 5 * 240 END AS m, o_orderkey % 3 AS k FROM orders),
d AS (SELECT job_id, s, k, unnest(CASE k WHEN 0 THEN generate_series(s, s + INTERVAL 2 DAY, m * INTERVAL 1 MINUTE) WHEN 1 THEN generate_series(s + INTERVAL 570 MINUTE, s + INTERVAL 2 DAY, INTERVAL 1 DAY) ELSE generate_series(s, s + INTERVAL 2 DAY, INTERVAL 1 DAY) END) AS due FROM j)
SELECT job_id, count(*) AS runs, min(due) AS first_due, max(due) AS last_due FROM d WHERE due > s GROUP BY job_id""")

QUERIES, ORACLES = P.queries, P.oracles
