"""Checks of deliverables, steps and chart specifications, as column expressions and aggregations.

Every rule is a Spark expression over one row, or a partial aggregation by task; word lists are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import any_of, bind, occurrences, strip

# Fixed values of the report, goal and step formats.
PLACEHOLDERS = ["未披露", "未获取", "待补充", "数据缺失", "待获取", "暂缺", "暂无", "无数据"]
LIST_WORDS = ["列表", "前十", "排名", "排行", "明细", "清单", "top", "表格", "榜单"]
GAP_MARKS = ["待获取", "数据未获取", "缺失字段清单", "需重新定向搜索", "需重跑搜索"]
LATEST_WORDS = ["最新", "最近", "最新季度", "最新一期", "latest", "current"]
NOW_WORDS = ["最新", "最近", "最新季度", "最新一期", "current", "当前", "现在"]
DATE_LABELS = ["数据截至", "数据截止", "报告日期", "报告时间", "更新日期", "更新时间", "生成日期", "检索时间", "截至"]
EMPTY_SIGNS = ["No URL", "no url", "empty", "filtered", "无结果", "没有找到", "未找到", "No relevant", "not found"]
CODE_SIGNS = ["SyntaxError", "ModuleNotFoundError", "Traceback", "No module named", "Script exited with code", "No valid code", "HTML incomplete"]
CHART_TYPES = ["line", "bar", "horizontal_bar", "pie", "scatter"]
CHART_FIELDS = ["title", "unit", "source", "x_axis_title", "y_axis_title", "conclusion"]
NOISE_MARKS = ["·", "报告", "摘要", "分析", "统计及", " -", "—", "–"]
UNSAFE_WORDS = ["爆炸物", "制造炸弹", "抢银行", "制毒", "自杀方法", "色情", "赌博网站"]
MEMORY_MARKS = ["历史背景", "成功解决路径"]
TOTAL_WORDS = ["全口径", "合计", "总计", "总体", "总共", "全部", "整体"]
CORE_METRICS = ["市场规模", "市场销售额", "销售额", "份额", "占比", "营收", "出货量", "增速", "增长率"]
SEGMENT_WORDS = ["推理", "训练", "边缘", "数据中心", "云端", "端侧", "汽车", "消费", "工业", "医疗", "手机", "服务器", "存储", "通用", "专用", "中国", "美国", "欧洲", "日本", "车载", "云", "端"]
REGION_WORDS = ["全球", "中国", "美国", "欧洲", "日本", "其中", "AI", "芯片", "半导体"]
TITLE_STOP = ["预测", "预计", "测算", "展望", "统计", "口径", "对比"]
#: Error class: what to do about it.
SUGGESTIONS = {
    "HTTP": "检查 URL 可达性，换备用 URL/镜像源；金融数据优先改用结构化数据源（东方财富/SEC/巨潮）",
    "SEARCH_EMPTY": "更换查询词并增加限定（site: 官方域名、年份、具体指标词）；禁止原样重复上次查询",
    "CODE_RUNTIME_ERROR": "修复语法/依赖错误，简化实现，避免不可用的外部库",
    "OUTPUT_TOO_SHORT": "裁剪输入提示词后重试（保留摘要，去掉原文引用），max_tokens 不缩小",
    "CONTRACT_VIOLATION": "按输出契约格式重新生成结果",
    "TIMEOUT": "减少单步工作量或拆分步骤，避免超时",
}
OTHER_SUGGESTION = "按失败原因修正实现；若无法恢复，改用已有结构化数据源或模型知识（标注来源）"


# Reports


def table_cells(report: Column) -> Column:
    """The filled data cells of all table lines: no ruler line, and not the line before the first ruler."""
    ruler = lambda row: F.forall(row, lambda c: c.rlike("^[-:—]*$"))
    lines = F.filter(F.transform(F.split(F.coalesce(report, F.lit("")), r"\r?\n"), strip), lambda x: x.startswith("|") & (F.regexp_count(x, F.lit(r"\|")) >= 2))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), strip))
    marked = F.transform(rows, lambda row: F.struct(row.alias("row"), ruler(row).alias("ruler")))

    def data(found: Column) -> Column:
        first = F.array_position(F.transform(found, lambda x: x["ruler"]), F.lit(True))
        return bind(first, lambda at: F.filter(found, lambda x, i: ~x["ruler"] & ~((at > 1) & (i == at - 2))))

    return bind(marked, lambda found: F.filter(F.flatten(F.transform(data(found), lambda x: x["row"])), lambda c: c != ""))


def completeness(report: Column, goal: Column, marks: list[str] = PLACEHOLDERS, lists: list[str] = LIST_WORDS, most: int = 3) -> Column:
    """struct(passed, marks, has_table, all_marks, list_wanted): fails with ``most`` placeholder marks, or where a goal wants a list and no table has real cells."""
    count = reduce(lambda a, b: a + b, [occurrences(report, m) for m in marks])
    has_table = F.coalesce(report, F.lit("")).rlike(r"(?m)^[ \t]*\|.*\|")
    filled = bind(table_cells(report), lambda cells: (F.size(cells) > 0) & F.forall(cells, lambda c: any_of(c, marks)))
    found = F.struct(count.alias("marks"), has_table.alias("has_table"), filled.alias("all_marks"), any_of(F.lower(goal), lists).alias("list_wanted"))
    passed = lambda v: (v["marks"] < most) & ~(v["list_wanted"] & (~v["has_table"] | v["all_marks"]))
    return bind(found, lambda v: F.struct(passed(v).alias("passed"), v["marks"].alias("marks"), v["has_table"].alias("has_table"), v["all_marks"].alias("all_marks"), v["list_wanted"].alias("list_wanted")))


def gap_marks(report: Column, marks: list[str] = GAP_MARKS) -> Column:
    """The gap marks that a report holds, in their order."""
    return F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.coalesce(report, F.lit("")).contains(m))


def too_short(report: Column, least: int = 50, short: int = 300) -> Column:
    """Under ``least`` characters, an error as JSON, or headings with hardly a body."""
    text = strip(report)
    error = text.startswith("{") & F.lower(text).rlike('"(error|status|detail|message)"')
    body = strip(F.regexp_replace(text, r"(?m)^#.*$", ""))
    return (F.char_length(text) < least) | error | ((F.char_length(text) < short) & (F.char_length(body) < least))


def stated_date(report: Column, labels: list[str] = DATE_LABELS) -> Column:
    """The first date that follows a date label within 12 characters; a missing day is the first; null without one."""
    pattern = rf"(?:{'|'.join(labels)})[^0-9年/.\-]{{0,12}}?(20\d{{2}})\s*[年./\-]\s*(\d{{1,2}})\s*(?:月|[./\-])?\s*(\d{{1,2}})?"
    part = lambda i: F.regexp_extract(report, pattern, i)
    day = F.when(part(3) == "", "1").otherwise(part(3))
    return F.when(part(1) != "", F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))


def recency(goal: Column, report: Column, results: Column, retrieved: Column, today: Column, days: int = 7) -> Column:
    """struct(passed, reason): for goals that ask for what is new.

    A stated report date more than ``days`` before the data were retrieved fails (stale_date). A goal that asks for the
    latest needs a year in report or results (no_year), and one that is this year's, or last year's in January and
    February (stale_year). Other goals pass (not_asked).
    """
    latest, now = any_of(goal, LATEST_WORDS), any_of(goal, NOW_WORDS)
    late = F.coalesce(F.datediff(retrieved, stated_date(report)) > days, F.lit(False))
    years = F.regexp_extract_all(F.concat_ws(" ", report, results), F.lit(r"(20\d{2})"), F.lit(1))
    newest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    wanted = F.year(today) - F.when(F.month(today) < 3, 1).otherwise(0)
    reason = F.when(now & late, "stale_date").when(~latest, F.when(now, "date_only").otherwise("not_asked")).when(newest.isNull(), "no_year").when(newest < wanted, "stale_year").otherwise("recent")
    return F.struct(reason.isin("date_only", "not_asked", "recent").alias("passed"), reason.alias("reason"))


# Contracts of step outputs


@dataclass(frozen=True)
class Contract:
    """What the output of a capability must hold."""

    required: tuple[str, ...] = ()
    failed: tuple[str, ...] = ()
    least: int = 0
    contains: str = ""


def _blank(value: Column) -> Column:
    return strip(value) == ""


def contract_issues(capability: Column, raw: Column, contracts: dict[str, Contract], most: int = 5) -> Column:
    """The first issues of an output (array of strings, empty when fine); unknown capabilities have none.

    Output that parses as JSON is checked as a list (empty, elements of the first five that are no objects or lack a
    field) or as an object (failed status with its error, missing fields); other text by length and needed words. The rule is
    looked up by capability and the output parsed once.
    """
    words = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
    rule_of = lambda r: F.struct(words(r.required).alias("required"), words([x.lower() for x in r.failed]).alias("failed"), F.lit(r.least).alias("least"), F.lit(r.contains).alias("contains"))
    if not contracts:
        return F.array().cast("array<string>")
    rules = F.create_map(*[x for name, rule in contracts.items() for x in (F.lit(name), rule_of(rule))])
    issues = bind(F.struct(F.try_element_at(rules, capability).alias("rule"), F.try_parse_json(raw).alias("json"), raw.alias("raw")), lambda v: _issues(v["rule"], v["json"], v["raw"]))
    return F.when(F.try_element_at(rules, capability).isNull(), F.array().cast("array<string>")).otherwise(F.slice(issues, 1, most))


def _issues(rule: Column, json: Column, raw: Column) -> Column:
    get, none = F.try_variant_get, F.array().cast("array<string>")
    fields = lambda value: get(value, "$", "map<string,variant>")
    told = lambda held, name: get(F.try_element_at(held, name), "$", "string")
    lacking = lambda held: F.filter(rule["required"], lambda f: _blank(told(held, f)))

    def of_item(held: Column) -> Column:
        return F.when(held.isNull(), "item is no object").otherwise(bind(lacking(held), lambda names: F.when(F.size(names) > 0, F.concat(F.lit("item lacks "), F.get(names, 0)))))

    def of_list(items: Column) -> Column:
        found = F.transform(F.transform(F.slice(items, 1, 5), fields), of_item)
        known = lambda x: bind(F.array_position(x, F.lit("item is no object")), lambda stop: F.array_compact(F.when(stop > 0, F.slice(x, F.lit(1), F.greatest(stop.cast("int"), F.lit(0)))).otherwise(x)))
        return F.when(F.size(items) == 0, F.array(F.lit("empty list"))).otherwise(bind(found, known))  # nothing is said on elements behind one that is no object

    def of_object(held: Column) -> Column:
        error = F.substring(F.coalesce(*[F.nullif(told(held, F.lit(k)), F.lit("")) for k in ("error", "message", "detail")], F.lit("no detail")), 1, 200)
        failed = F.when(F.array_contains(rule["failed"], F.lower(strip(told(held, F.lit("status"))))), F.array(F.concat(F.lit("failed: "), error))).otherwise(none)
        return F.concat(failed, F.transform(lacking(held), lambda f: F.concat(F.lit("lacks "), f)))

    of_text = lambda text: F.array_compact(F.array(F.when(F.char_length(text) < rule["least"], "too short"), F.when(~text.contains(rule["contains"]), F.concat(F.lit("lacks "), rule["contains"]))))
    whole = F.struct(get(json, "$", "array<variant>").alias("items"), fields(json).alias("fields"), F.coalesce(get(json, "$", "string"), raw, F.lit("")).alias("text"))
    return bind(whole, lambda v: F.when(v["items"].isNotNull(), of_list(v["items"])).when(v["fields"].isNotNull(), of_object(v["fields"])).otherwise(of_text(v["text"])))


# Failed steps


def error_class(capability: Column, text: Column, violated: Column) -> Column:
    """The stable class of a failed step from its free text."""
    text = F.coalesce(text, F.lit(""))
    low, code = F.lower(text), F.regexp_extract(text, r"(?i)HTTP[ _-]?(\d{3})", 1)
    return (
        F.when(violated, "CONTRACT_VIOLATION")
        .when(any_of(low, ["timeout", "超时"]), "TIMEOUT")
        .when(code != "", F.concat(F.lit("HTTP_"), code))
        .when(any_of(text, EMPTY_SIGNS), "SEARCH_EMPTY")
        .when((capability == "code_execution") & any_of(text, CODE_SIGNS), "CODE_RUNTIME_ERROR")
        .when((capability == "report_generator") & low.contains("too short"), "OUTPUT_TOO_SHORT")
        .otherwise("GENERIC_FAILURE")
    )


def endpoint_reason(text: Column) -> Column:
    """Why a model call failed: empty content, a refused request, network trouble, or generic."""
    text = F.coalesce(text, F.lit(""))
    low, code = F.lower(text), F.regexp_extract(text, r"HTTP[ _-]?(\d{3})", 1)
    slow = any_of(low, ["timeout", "timed out"])
    return (
        F.when(any_of(text, ["Empty content", "Empty choices"]), "empty_content")
        .when(code.isin("401", "402", "403"), F.concat(F.lit("HTTP_"), code))
        .when(low.contains("network error"), F.when(slow, "timeout").otherwise("network_error"))
        .otherwise("generic")
    )


def fix_suggestion(kind: Column, capability: Column, other: Column, instruction: Column, table: dict[str, str] = SUGGESTIONS) -> Column:
    """What to try: another capability if there is one, else the suggestion of the error class."""
    hint = F.when(F.coalesce(instruction, F.lit("")).contains("结构化"), "（优先结构化数据源）").otherwise("")
    swap = F.concat(F.lit("改用 "), other, F.lit(" 替代 "), capability, hint)
    family = F.when(kind.startswith("HTTP_"), "HTTP").otherwise(kind)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(swap, F.element_at(known, family), F.lit(OTHER_SUGGESTION))


def final_status(steps: DataFrame, audits: DataFrame, key: str) -> DataFrame:
    """(key, status) from steps (key, failed, both_failed) and the last audit (key, at, overall).

    A failed step fails the task; an audit that did not pass, or a call that failed at both endpoints, leaves issues.
    """
    last = audits.groupBy(key).agg(F.max_by("overall", "at").alias("overall"))
    by = steps.groupBy(key).agg(F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed"), F.bool_or(F.coalesce("both_failed", F.lit(False))).alias("both"))
    issues = F.col("both") | F.coalesce(F.col("overall") != "pass", F.lit(False))
    return by.join(last, key, "left").select(key, F.when(F.col("failed"), "FAILED").when(issues, "SUCCESS_WITH_ISSUES").otherwise("SUCCESS").alias("status"))


def redo_worse(old: Column, new: Column, least: int = 300, share: float = 0.4) -> Column:
    """Whether a new version is clearly worse: a fallback where the old was none, or too small a part of its length."""
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    fallback = F.lower(new).contains("fallback") & ~F.lower(old).contains("fallback")
    return (F.char_length(old) >= least) & (fallback | (F.char_length(new) < share * F.char_length(old)))


def artifact_key(name: Column) -> Column:
    """File name without folder, extension and a time stamp at its end."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(stem, r"_[0-9]{9,11}$", "")


def prune_superseded(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files (keys, name, passed) without the failed ones that a passed file of the same key replaces."""
    files = files.withColumn("artifact", artifact_key(F.col("name")))
    passed = files.where("passed").select(*keys, "artifact").distinct().withColumn("again", F.lit(True))
    return files.join(passed, [*keys, "artifact"], "left").where(F.col("passed") | F.col("again").isNull()).drop("again")


def replan_counts(steps: DataFrame, key: str) -> DataFrame:
    """Steps with an alternative's id by capability, and those of tasks that succeeded; steps (key, step, task_status)."""
    again = F.col("step").contains("alt-")
    return steps.groupBy(key).agg(F.count_if(again).alias("replans"), F.count_if(again & (F.col("task_status") == "SUCCESS")).alias("credited"))


def memory_chars(steps: DataFrame, key: str, marks: list[str] = MEMORY_MARKS) -> DataFrame:
    """Characters of step results that hold a mark of remembered text."""
    return steps.groupBy(key).agg(F.coalesce(F.sum(F.when(any_of(F.col("result"), marks), F.char_length("result"))), F.lit(0)).cast("long").alias("chars"))


def critic_stats(reviews: DataFrame, key: str) -> DataFrame:
    """Reviews (key, verdict, scores map): passed, rejected, and the least of each review's scores (10 without any)."""
    least = F.coalesce(F.array_min(F.map_values("scores")), F.lit(10.0))
    return reviews.groupBy(key).agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count_if(~F.col("verdict").eqNullSafe("PASS")).alias("rejected"), F.min(least).alias("min_score"))


def ab_report(runs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row from runs (variant, success, latency): rates, latencies, uplift and the decision."""
    of = lambda v: F.col("variant") == v
    sides = []
    for v in ("baseline", "candidate"):
        sides += [
            F.count_if(of(v)).alias(f"{v}_runs"),
            F.coalesce(F.round(F.avg(F.when(of(v), F.col("success").cast("int"))), 6), F.lit(0.0)).alias(f"{v}_rate"),
            F.round(F.avg(F.when(of(v), F.col("latency"))), 4).alias(f"{v}_latency"),
            F.when(F.count_if(of(v) & F.col("latency").isNotNull()) > 1, F.round(F.stddev_samp(F.when(of(v), F.col("latency"))), 4)).otherwise(0.0).alias(f"{v}_std"),
        ]
    out = runs.agg(*sides).withColumn("uplift", F.round(F.col("candidate_rate") - F.col("baseline_rate"), 6))
    decision = F.when(F.col("uplift") > threshold, "switch").when(F.col("uplift") > 0, "watch").otherwise("roll_back")
    return out.withColumns({"significant": F.abs("uplift") > threshold, "decision": decision})


def idle_agents(agents: DataFrame, asked: DataFrame) -> DataFrame:
    """(capability, agent) for each capability asked: of the idle or active agents (agent, status, capabilities, last_heartbeat) that list it, the one heard of longest ago."""
    free = agents.where(F.col("status").startswith("idle") | F.col("status").startswith("active:"))
    able = free.select("agent", "last_heartbeat", F.explode(F.array_distinct(F.transform(F.split("capabilities", ","), strip))).alias("capability"))
    first = able.groupBy("capability").agg(F.min(F.struct("last_heartbeat", "agent"))["agent"].alias("agent"))
    return asked.select("capability").distinct().join(first, "capability", "left")


def system_status(tasks: DataFrame, agents: DataFrame, hours: int = 24, queued: DataFrame | None = None, recent: int = 5) -> DataFrame:
    """One row: all tasks (task, status, at), successes, tasks of the last hours before the newest, share of agents (agent, online) alive (100 without any), and, with the waiting rows (agent), the depth of each agent's queue and the ``recent`` newest tasks."""
    newest = tasks.agg(F.max("at").alias("newest"))
    counts = tasks.crossJoin(F.broadcast(newest)).agg(  # one row
        F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("success"), F.count_if(F.col("at") >= F.col("newest") - F.make_interval(hours=F.lit(hours))).alias("recent")
    )
    alive = agents.agg(F.when(F.count("*") > 0, F.round(F.count_if("online") * 100 / F.count("*"), 1)).otherwise(100.0).alias("survival"))
    out = counts.crossJoin(F.broadcast(alive))  # one row each
    if queued is None:
        return out
    depths = agents.select("agent").distinct().join(queued.groupBy("agent").agg(F.count("*").alias("n")), "agent", "left").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent", F.coalesce("n", F.lit(0)))))).alias("queues"))  # a map of all agents is the report
    last = tasks.orderBy(F.desc("at"), F.desc("task")).limit(recent).agg(F.reverse(F.sort_array(F.collect_list(F.struct("at", "task")))).alias("tasks")).select(F.col("tasks.task").alias("newest"))
    return out.crossJoin(F.broadcast(depths)).crossJoin(F.broadcast(last))  # one row each


# Charts and codes


def spec_issues(spec: Column, types: list[str] = CHART_TYPES, fields: list[str] = CHART_FIELDS) -> Column:
    """What is wrong with a chart specification given as a VARIANT: type, needed fields, two data rows with label and value."""
    get = lambda path, kind="string": F.try_variant_get(spec, path, kind)
    rows = F.coalesce(get("$.data", "array<variant>"), F.array().cast("array<variant>"))
    whole = F.forall(rows, lambda r: F.array_contains(F.map_keys(F.try_variant_get(r, "$", "map<string,variant>")), "label") & F.array_contains(F.map_keys(F.try_variant_get(r, "$", "map<string,variant>")), "value"))
    found = [
        F.when(~F.coalesce(get("$.type"), F.lit("")).isin(*types), "type"),
        *[F.when(_blank(get(f"$.{f}")), f) for f in fields],
        F.when(F.size(rows) == 0, "no data").when(F.size(rows) < 2, "one data row"),
        F.when(~F.coalesce(whole, F.lit(False)), "label or value"),
    ]
    no_object = get("$", "map<string,variant>").isNull()
    return F.when(no_object, F.array(F.lit("no object"))).otherwise(F.array_compact(F.array(*found)))


def chart_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, label, value) with their place: as given if all labels of the key are years or plain numbers, else by falling value."""
    natural = F.bool_and(F.trim("label").rlike(r"^([0-9]{4}|[0-9]+(\.[0-9]+)?)$")).over(Window.partitionBy(key))
    first = F.when(F.col("natural"), F.lit(None)).otherwise(-F.col("value"))
    return rows.withColumn("natural", F.coalesce(natural, F.lit(False))).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(first.asc_nulls_last(), "pos"))).drop("natural")


def short_label(label: Column, caliber: Column, source: Column, most: int = 12) -> Column:
    """At most so many characters: the label if it fits, else the first short piece of caliber or label, the host, or a cut."""
    label = strip(label)
    label = F.when(label == "", "?").otherwise(label)
    fits = lambda x: (x != "") & (F.char_length(x) <= most)
    tries = []
    for text in (strip(caliber), label):
        tries += [F.when(fits(head := strip(F.substring_index(text, mark, 1))), head) for mark in ("，", ",", "；", ";", "：", ":", "（", "(")]
    host = F.replace(F.regexp_extract(F.coalesce(source, F.lit("")), r"https?://([^/]+)", 1), F.lit("www."), F.lit(""))
    return F.when(F.char_length(label) <= most, label).otherwise(F.coalesce(*tries, F.when(host != "", F.substring(host, 1, most)), F.substring(label, 1, most)))


def noise_label(label: Column, marks: list[str] = NOISE_MARKS) -> Column:
    """Whether a label is a heading or a fragment rather than a category."""
    return any_of(label, marks)


def series_of(metric: Column, caliber: Column) -> Column:
    """The series of a metric: segments of a core metric fold into it, totals and plain metrics stay themselves."""
    core = F.coalesce(*[F.when(metric.contains(c), F.lit(c)) for c in CORE_METRICS])
    rest = F.regexp_replace(F.replace(metric, core, F.lit("")), f"^({'|'.join(REGION_WORDS)})+", "")
    folds = core.isNotNull() & (rest != "") & any_of(rest, SEGMENT_WORDS) & ~any_of(caliber, TOTAL_WORDS)
    return F.when(folds, core).otherwise(F.coalesce(metric, F.lit("")))


def title_key(title: Column) -> Column:
    """A chart title without brackets, forecast words, dates' marks and punctuation, in lower case."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), "[（(][^）)]*[）)]", "")
    plain = F.regexp_replace(plain, "|".join(TITLE_STOP), "")
    return F.lower(F.regexp_replace(plain, r"[年月日：:，,。．\-·\s]+", ""))


#: Exchange prefix by the leading digits of a bare code.
EXCHANGES = {"sh": "69", "sz": "023", "bj": "48"}
MARKETS = ["sh", "sz", "bj", "hk", "us"]


def exchange_code(code: Column) -> Column:
    """A code with its exchange prefix; codes that have one, or whose first digit names none, stay."""
    code = F.trim(code)
    out = code
    for prefix, digits in EXCHANGES.items():
        out = F.when(code.rlike(f"^[{digits}]"), F.concat(F.lit(prefix), code)).otherwise(out)
    return F.when(code.rlike(f"(?i)^({'|'.join(MARKETS)})[0-9]*$"), code).otherwise(out)


def bare_code(code: Column) -> Column:
    """A code without its market prefix."""
    return F.regexp_replace(F.trim(code), f"(?i)^({'|'.join(MARKETS)})(?=.)", "")


# Texts


def unsafe_words(text: Column, words: list[str] = UNSAFE_WORDS) -> Column:
    """The deny words that a text holds, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.coalesce(text, F.lit("")).contains(w))


def stated_numbers(texts: DataFrame, key: str, after: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns kept, pos, value, unit, after) of the figures that need a source: those with a unit, and plain ones of four digits or more.

    Images, local paths and addresses are masked first; years, codes with leading zeros or an exchange suffix, and
    digits inside words or longer numbers are no figures. ``after`` holds so many of the characters that follow.
    """
    text = masked = F.coalesce("text", F.lit(""))
    for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"[A-Za-z]:\\\S*", r"/tasks/\S+", r"https?://\S+"):
        masked = F.regexp_replace(masked, pattern, " ")
    texts = texts.select(key, *keep, F.when(text.rlike(r"!\[|:\\|/tasks/|https?://"), masked).otherwise(text).alias("masked"))
    unit = r"(?:万亿|千亿|百亿|亿|万)?\s*(?:美元|港元|元|人民币|USD|US\$|%|％)?"
    whole = rf"(?<![A-Za-z0-9.,])[0-9][0-9,]*(?:\.[0-9]+)?\s*{unit}(?:\.(?:HK|T|O|N|US|L|A|B|SS|SZ)\b)?"
    part = lambda group: F.regexp_extract_all("masked", F.lit(f"({whole})(?s)(?=(.{{0,{after}}}))"), F.lit(group))
    digits = r"^[0-9][0-9,]*(?:\.[0-9]+)?"

    def cell(c: Column, pos: Column) -> Column:
        unit = F.translate(F.substr(c["raw"], F.char_length(c["number"]) + 1), " \t\n\x0b\f\r", "")
        return F.struct(pos.alias("pos"), F.replace(c["number"], F.lit(","), F.lit("")).alias("value"), unit.alias("unit"), c["after"].alias("after"))

    def needs_source(c: Column) -> Column:
        plain = c["value"].rlike(r"^(0[0-9]{3,}|(19|20)[0-9]{2})$") | (F.char_length(F.replace(c["value"], F.lit("."), F.lit(""))) < 4)
        return ~F.startswith(c["unit"], F.lit(".")) & ~((c["unit"] == "") & plain)

    pairs = F.arrays_zip(part(1).alias("raw"), part(2).alias("after")) if after else F.transform(part(1), lambda r: F.struct(r.alias("raw"), F.lit("").alias("after")))
    numbered = F.transform(pairs, lambda c: F.struct(c["raw"].alias("raw"), c["after"].alias("after"), F.regexp_extract(c["raw"], digits, 0).alias("number")))
    found = F.filter(F.transform(numbered, cell), needs_source)
    return texts.select(key, *keep, F.inline(found))


def balanced_json(text: Column) -> Column:
    """The first balanced object of a text (in a fence if there is one), null when it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return _first_object(F.when(fenced != "", fenced).otherwise(text))


def tagged_specs(text: Column, tag: str = "[CHART_DATA]") -> Column:
    """The chart objects (JSON texts) of the first balanced object behind a tag: its charts, else its data rows; empty without a tag or when it does not parse."""
    found = _first_object(F.get(F.split(text, rf"\Q{tag}\E", 2), F.lit(1)))
    listed = F.from_json(found, "struct<charts:array<string>,data:array<string>>")
    return F.filter(F.coalesce(listed["charts"], listed["data"], F.array().cast("array<string>")), lambda spec: F.startswith(spec, F.lit("{")))


def _first_object(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?s)(\{.*)", 1)
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)([{}]|[^{}]+)"), F.lit(1))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.struct(
            F.when(acc["done"], acc["depth"]).otherwise(depth).alias("depth"), F.when(acc["done"], acc["n"]).otherwise(acc["n"] + 1).alias("n"), (acc["done"] | (depth == 0)).alias("done")
        )

    end = F.aggregate(pieces, zero, step)
    found = F.when(end["done"], F.array_join(F.slice(pieces, F.lit(1), F.greatest(end["n"], F.lit(1))), ""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def due_times(jobs: DataFrame, end: Column) -> DataFrame:
    """(job_id, due) of jobs (job_id, start, minutes, at) after the start up to the end: daily at HH:MM where ``at`` is one, else every ``minutes``."""
    hour, minute = F.regexp_extract("at", r"^(\d{1,2}):(\d{2})$", 1), F.regexp_extract("at", r"^(\d{1,2}):(\d{2})$", 2)
    daily = (hour != "") & (hour.try_cast("int") < 24) & (minute.try_cast("int") < 60)
    first = F.date_trunc("day", "start") + F.make_dt_interval(hours=hour.try_cast("int"), mins=minute.try_cast("int"))
    step = F.make_dt_interval(mins=F.greatest(F.lit(1), F.coalesce("minutes", F.lit(0))))
    days = F.sequence(first, F.greatest(end.cast("timestamp"), first), F.expr("interval 1 day"))
    ticks = F.sequence(F.col("start").cast("timestamp"), F.greatest(end.cast("timestamp"), F.col("start").cast("timestamp")), step)
    due = F.filter(F.when(F.coalesce(daily, F.lit(False)), days).otherwise(ticks), lambda t: (t > F.col("start")) & (t <= end))
    return jobs.select("job_id", F.explode(due).alias("due"))
