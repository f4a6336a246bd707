"""Routing of goals, anchors and names in texts, summaries of events, and panels by priority.

Name and word lists are parameters; texts are scanned in place and only what was found is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import any_of, bind, occurrences
from tessera.operators.texts import HAN, sentences

# Fixed values of the goal formats.
CRYPTO_WORDS = ["加密货币", "比特币", "以太坊", "币价", "虚拟货币", "数字货币", "btc", "eth", "bitcoin", "ethereum", "crypto", "coin"]
MACRO_WORDS = ["gdp", "cpi", "通胀", "通货膨胀", "失业率", "宏观", "宏观经济", "pmi", "消费者物价"]
NEWS_WORDS = ["最新新闻", "头条", "要闻", "今日新闻", "实时新闻", "新闻资讯", "news", "headline"]
FINANCE_WORDS = ["财报", "年报", "季报", "营收", "净利润", "净利", "利润", "负债", "财务", "市值", "股票", "股价", "港交所", "港股", "a股", "美股", "上市公司", "业绩", "毛利率", "现金流", "financial", "revenue", "earnings"]
DOMAINS = [("crypto", CRYPTO_WORDS), ("macro", MACRO_WORDS), ("news", NEWS_WORDS), ("financial", FINANCE_WORDS)]
CHART_WORDS = ["可视化", "图表", "趋势图", "柱状", "饼图", "折线", "调研", "plot", "chart", "graph", "财报", "营收", "净利润", "财务", "季报", "年报", "业绩", "市场规模", "市场份额", "占比", "销售", "销量", "出货", "渗透率", "增长率", "cagr", "预测", "规模", "币价", "比特币", "以太坊", "加密货币", "行情", "走势", "趋势", "宏观", "通胀", "利率", "涨跌幅", "市值", "份额", "竞争格局", "排名", "排行", "前十", "榜单", "成交量", "成交额", "涨停", "跌幅", "美联储", "cpi", "gdp"]
MARKET_WORDS = ["成交量排行", "成交额排行", "成交量前十", "成交额前十", "涨停", "跌幅榜", "a股今日", "今日a股", "前十股", "排名榜", "股票排行", "a股排行", "股票排名", "成交量榜", "成交额榜"]
RANK_WORDS, STOCK_WORDS = ["排行", "排名", "前十", "榜单"], ["a股", "股票", "沪深", "股市", "今日"]
#: Label and patterns of injected instructions, in order.
INJECTIONS = [
    ("忽略指令", "忽略(之前|以上|所有|系统)?(的)?(指令|提示|要求|规则)"),
    ("无视指令", "(无视|不要理会|忘记|遗忘)(之前|以上|系统)?(的)?(指令|提示|规则)"),
    ("角色扮演/系统提示泄露", "扮演|假装你是|冒充|system prompt"),
    ("SQL 注入", r"(?:UPDATE|DROP|DELETE|INSERT|ALTER)\s+[A-Za-z_]"),
    ("SQL 注入", r"(?:;\s*--|\bUNION\s+SELECT\b)"),
    ("命令注入", r"\$\s*\(|`[^`]{2,}`"),
    ("编码混淆", r"base64\s*[-_]\s*d|b64decode|fromCharCode"),
    ("命令注入", r"curl\s+\S+|wget\s+\S+|powershell\s+-"),
]
#: Lower-case words of which a text must hold one for a pattern to match; looked for first, as plain words cost far less than patterns.
INJECTION_HINTS = dict(zip([p for _, p in INJECTIONS], [
    ["忽略"], ["无视", "不要理会", "忘记", "遗忘"], ["扮演", "假装你是", "冒充", "system prompt"], ["update", "drop", "delete", "insert", "alter"], ["--", "union"], ["$", "`"],
    ["base64", "b64decode", "fromcharcode"], ["curl", "wget", "powershell"],
], strict=True))
#: Words of goals that name the kind of work, not its subject.
WORK_WORDS = ["分析", "生成", "报告", "可视化", "市场", "数据", "训练", "模型", "输出", "包括", "主要", "技术", "趋势", "一个"]
#: Subject words that stand for a whole field: (a goal word of the field, the anchors that it brings).
ANCHOR_PACKS = [
    (["财报", "财务", "营收", "利润", "负债", "年报", "季报", "业绩"], ["营收", "净利润", "负债", "总资产", "销售额", "利润", "亏损", "财报", "收入"]),
    (["芯片", "ai", "gpu", "算力", "半导体", "英伟达"], ["芯片", "ai", "gpu", "算力", "半导体", "nvidia", "英伟达"]),
]
DEFAULT_ANCHOR = "芯片"


def injection_label(text: Column, patterns: list[tuple[str, str]] = INJECTIONS, chars: int = 20_000) -> Column:
    """The label of the first pattern found in the first ``chars`` characters, which is the reach of the rule; null without one."""
    start = F.substring(F.coalesce(text, F.lit("")), 1, chars)
    hinted = lambda v, p: any_of(v["low"], INJECTION_HINTS[p]) if p in INJECTION_HINTS else F.lit(True)
    return bind(F.struct(start.alias("text"), F.lower(start).alias("low")), lambda v: F.coalesce(*[F.when(hinted(v, p) & v["text"].rlike(f"(?i){p}"), F.lit(label)) for label, p in patterns]))


def trace_domain(goal: Column, domains: list[tuple[str, list[str]]] = DOMAINS) -> Column:
    """The first domain one of whose words a goal holds, else research."""
    low = F.lower(goal)
    return F.coalesce(*[F.when(any_of(low, words), F.lit(name)) for name, words in domains], F.lit("research"))


def wants_chart(goal: Column, words: list[str] = CHART_WORDS) -> Column:
    return any_of(F.lower(goal), words)


def market_goal(goal: Column) -> Column:
    """Whether a goal asks for a ranking of the stock market of the day."""
    low = F.lower(goal)
    return any_of(low, MARKET_WORDS) | (any_of(low, RANK_WORDS) & any_of(low, STOCK_WORDS))


def goal_bigrams(goal: Column, longest: int) -> Column:
    """Pairs of characters inside runs of Han characters, long runs cut every ``longest`` characters."""
    runs = F.regexp_extract_all(F.coalesce(goal, F.lit("")), F.lit(f"([{HAN}]{{2,{longest}}})"), F.lit(1))
    pairs = F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))
    return F.array_distinct(F.flatten(pairs))


def goal_anchors(goal: Column, stop: list[str], packs: list[tuple[list[str], list[str]]] = ANCHOR_PACKS, default: str = DEFAULT_ANCHOR) -> Column:
    """What the documents of a goal must hold: its Han pairs outside the stop words, and the anchors of the fields that it names."""
    low = F.lower(F.trim(goal))
    none = F.array().cast("array<string>")
    own = F.array_except(goal_bigrams(low, 6), F.array(*[F.lit(w) for w in stop])) if stop else goal_bigrams(low, 6)
    extra = [F.when(any_of(low, asks), F.array(*[F.lit(w) for w in brings])).otherwise(none) for asks, brings in packs]
    found = F.array_sort(F.array_distinct(F.concat(own, *extra)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def holds_anchor(text: Column, anchors: Column) -> Column:
    """Whether a text holds an anchor: words of ASCII letters as whole words, others anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(low, "[^a-z0-9]+")
    return F.exists(anchors, lambda a: F.when(a.rlike("^[a-z]{2,}$"), F.array_contains(words, a)).otherwise(low.contains(a)))


def topic_gate(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence) of the sentences with an anchor, from documents (doc_id, text, anchors) with one."""
    held = docs.where(holds_anchor(F.col("text"), F.col("anchors")))
    parts = sentences(held.select("doc_id", "text")).join(held.select("doc_id", "anchors"), "doc_id")
    return parts.where(holds_anchor(F.col("sentence"), F.col("anchors"))).select("doc_id", "pos", "sentence")


def entity_mentions(docs: DataFrame, aliases: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """(key, name, mentions) of the names of aliases (alias, name) found in each text: aliases of ASCII letters as whole words in any case, others anywhere.

    Counted inside the row, so that only names found leave it; ``aliases`` is a parameter list.
    """
    text = F.coalesce("text", F.lit(""))
    plain = sorted({a.lower() for a, _ in aliases if re.fullmatch("[A-Za-z]{2,}", a)})
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.isin(*plain)) if plain else F.array().cast("array<string>")
    rows = docs.select(key, text.alias("text_"), words.alias("words_"))
    count = lambda a: F.size(F.filter("words_", lambda w: w == a.lower())) if a.lower() in plain else occurrences(F.col("text_"), a)
    cells = F.array(*[F.struct(F.lit(name).alias("name"), count(a).cast("long").alias("n")) for a, name in aliases])
    return rows.select(key, F.inline(F.filter(cells, lambda c: c["n"] > 0))).groupBy(key, "name").agg(F.sum("n").alias("mentions"))


def entity_frequency(docs: DataFrame, aliases: list[tuple[str, str]], top: int = 12, key: str = "doc_id") -> DataFrame:
    """The names mentioned most, with their documents."""
    found = entity_mentions(docs, aliases, key)
    return found.groupBy("name").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("docs")).orderBy(F.desc("mentions"), "name").limit(top)


#: Pairs of cases that are held beside each goal (a map is searched from its start); more are joined.
HELD_PAIRS = 256


def match_cases(goals: DataFrame, cases: DataFrame, stop: list[str] = WORK_WORDS, held: int = HELD_PAIRS, keep: bool = False) -> DataFrame:
    """(goal_id, case_id, score): the case that holds most of a goal's Han pairs (the first case on ties); goals (each of an id of its own) without a hit are left out, or have nulls if ``keep``.

    A pair is in a case exactly if it is one of the case's pairs. Up to ``held`` of these, which are counted first, are
    looked up inside the row of a goal, so that no goal is shuffled; more meet the goals by an equi-join.
    """
    pairs = F.array_except(goal_bigrams(F.col("goal"), 4), F.array(*[F.lit(w) for w in stop]))
    every = F.regexp_extract_all(F.lower("text"), F.lit(f"(?=([{HAN}]{{2}}))"), F.lit(1))
    known = cases.select("case_id", F.explode(F.array_distinct(every)).alias("pair"))
    if known.limit(held + 1).count() > held:
        scores = goals.select("goal_id", F.explode(pairs).alias("pair")).join(known, "pair").groupBy("goal_id", "case_id").agg(F.count("*").alias("score"))
        best = scores.groupBy("goal_id").agg(F.max(F.struct("score", (-F.col("case_id")).alias("first"))).alias("s"))
        found = goals.select("goal_id").join(best, "goal_id", "left") if keep else best
    else:
        lists = known.groupBy("pair").agg(F.collect_list("case_id").alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("pair", "ids"))).alias("known"))  # one row of at most ``held`` pairs
        hits = F.flatten(F.transform(F.filter("pairs", lambda p: F.map_contains_key("known", p)), lambda p: F.element_at("known", p)))
        rows = goals.select("goal_id", pairs.alias("pairs")).crossJoin(F.broadcast(lists)).select("goal_id", hits.alias("hits"))
        each = F.transform(F.array_distinct("hits"), lambda c: F.struct(F.size(F.filter("hits", lambda h: h == c)).cast("long").alias("score"), (-c).alias("first")))
        found = rows.select("goal_id", F.array_max(each).alias("s"))
        found = found if keep else found.where("s is not null")
    return found.select("goal_id", (-F.col("s.first")).alias("case_id"), "s.score")


def skill_scores(goal: Column, capability: Column, skills: dict[str, list[str]], boosts: dict[str, str]) -> Column:
    """Array of struct(score, skill), best first: keywords that a goal holds, and one for the capability's own skill."""
    cells = []
    for name, keywords in skills.items():
        mine = [c for c, s in boosts.items() if s == name]
        hits = [any_of(goal, [k]).cast("int") for k in keywords] + ([F.coalesce(capability.isin(*mine), F.lit(False)).cast("int")] if mine else [])
        cells.append(F.struct((-sum(hits, F.lit(0))).alias("score"), F.lit(name).alias("skill")))
    ranked = F.array_sort(F.filter(F.array(*cells), lambda c: c["score"] < 0))
    return F.transform(ranked, lambda c: F.struct((-c["score"]).alias("score"), c["skill"].alias("skill")))


def first_template(goal: Column, templates: list[tuple[str, list[list[str]]]]) -> Column:
    """The first template one of whose keyword groups a goal holds whole; null without one."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    group = lambda words: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    hits = [F.when(F.exists(F.array(*[group(g) for g in groups]), lambda x: x), F.lit(name)) for name, groups in templates]
    return F.coalesce(*hits)


# Events


def degradation(events: DataFrame, key: str, switch: str = "switch_to_backup", fallback: str = "inherited_unhealthy") -> DataFrame:
    """By key, from events (key, ts, id, reason, both_failed): switches, other reasons in the order first seen (the fallback where
    there is none), whether both endpoints failed, the last time, and how many of the newest events are kept (max of 10 and 3 * switches + 2)."""
    other = (F.col("reason") != switch) & (F.col("reason") != "")
    seen = events.where(other).groupBy(key, "reason").agg(F.min(F.struct("ts", "id")).alias("first"))
    order = seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "reason"))), lambda s: s["reason"]).alias("reasons"))  # distinct reasons only
    sums = events.groupBy(key).agg(
        F.count_if(F.col("reason") == switch).alias("switches"), F.bool_or(F.coalesce("both_failed", F.lit(False))).alias("both_failed"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )
    kept = F.least("n", F.greatest(F.lit(10), 3 * F.col("switches") + 2))
    return sums.join(order, key, "left").select(key, "switches", F.coalesce("reasons", F.array(F.lit(fallback))).alias("reasons"), "both_failed", "last_ts", kept.alias("kept_events"))


def repeat_suppress(df: DataFrame, key: str, reason: str, seconds: float) -> DataFrame:
    """Drops a row that equals the last kept row of its key within under so many seconds (ts, then id, is the order).

    The last kept row has the reason of the row before, so each run of equal reasons is settled by itself: its first row
    stays, then the next one far enough from the last that stayed. A run also ends at a pause of that length, since the
    row after it stays in any case; what is folded in one array is one burst.
    """
    order = Window.partitionBy(key).orderBy("ts", "id")
    marked = df.withColumn("us_", F.unix_micros(F.col("ts").cast("timestamp")))
    other = ~F.col(reason).eqNullSafe(F.lag(reason).over(order)) | (F.row_number().over(order) == 1)
    pause = F.col("us_") - F.lag("us_").over(order) >= int(seconds * 1e6)
    runs = marked.withColumn("new_", (other | F.coalesce(pause, F.lit(False))).cast("int")).withColumn("run_", F.sum("new_").over(order))
    rows = runs.groupBy(key, "run_").agg(F.array_sort(F.collect_list(F.struct("us_", "id"))).alias("r"))
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{df.schema['id'].dataType.simpleString()}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        far = acc["last"].isNull() | (x["us_"] - acc["last"] >= int(seconds * 1e6))
        return F.struct(F.when(far, x["us_"]).otherwise(acc["last"]).alias("last"), F.when(far, F.array_append(acc["kept"], x["id"])).otherwise(acc["kept"]).alias("kept"))

    kept = rows.select(F.explode(F.aggregate("r", zero, step)["kept"]).alias("id"))
    return df.join(kept, "id", "left_semi")


def valid_at(asked: DataFrame, sets: DataFrame, key: str, value: str) -> DataFrame:
    """asked (id, key, ts) with the value of the last set (key, ts, value, ttl) at or before it, null once that set has expired."""
    kind = sets.schema[value].dataType
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    a = asked.select("id", key, "ts", F.lit(None).cast(kind).alias(value), F.lit(None).cast("double").alias("ttl"), F.lit(1).alias("side"))
    b = sets.select(F.lit(None).cast(asked.schema["id"].dataType).alias("id"), key, "ts", value, F.col("ttl").cast("double"), F.lit(0).alias("side"))
    order = Window.partitionBy(key).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct((micros + F.col("ttl") * 1e6).alias("until"), F.col(value).alias("v"))), True).over(order)
    rows = a.unionByName(b).withColumn("last", last).where("side = 1")
    return rows.select("id", key, "ts", F.when(F.col("last.until") > micros, F.col("last.v")).alias(value))


def calibrate(rows: DataFrame, metrics: list[str], threshold: float = 0.7) -> DataFrame:
    """One row: mean over rows of the mean absolute error over the metrics (auto_<m>, human_<m>), and how often both sides pass or both fail."""
    part = lambda side: sum((F.coalesce(F.col(f"{side}_{m}"), F.lit(0.0)) for m in metrics), F.lit(0.0)) / len(metrics)
    error = sum((F.abs(F.coalesce(F.col(f"auto_{m}"), F.lit(0.0)) - F.coalesce(F.col(f"human_{m}"), F.lit(0.0))) for m in metrics), F.lit(0.0)) / len(metrics)
    agree = (part("auto") >= threshold) == (part("human") >= threshold)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.round(error, 3)), 3), F.lit(1.0)).alias("mae"), F.coalesce(F.round(F.avg(agree.cast("int")), 3), F.lit(0.0)).alias("agreement"))


def best_deliverable(results: DataFrame, key: str, pools: list[str], topic: list[str], least: int = 200) -> DataFrame:
    """The best finished text of each key from (key, pos, capability, status, text): by pool, on topic first, then marked-up texts, then the longest.

    Texts under ``least`` characters and JSON are left out; on topic counts inside a pool only where a text of the pool is.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = results.where((F.col("status") == "SUCCESS") & F.col("capability").isin(*pools)).withColumn("text", text)
    rows = rows.where((F.char_length("text") >= least) & ~F.col("text").rlike(r"^[{\[]"))
    pool = F.array_position(F.array(*[F.lit(p) for p in pools]), F.col("capability"))
    marked = F.substring("text", 1, 200).contains("#") | F.substring("text", 1, 500).contains("|") | F.col("text").contains("```")
    order = F.struct(-pool, any_of(F.lower("text"), topic).cast("int"), marked.cast("int"), F.char_length("text"), -F.col("pos"))
    return rows.groupBy(key).agg(F.max_by(F.struct("pos", "capability", "text"), order).alias("s")).select(key, "s.*")


# Panels


def priority_panel(facts: DataFrame, tags: dict[str, list[str]], unit: float, margin: tuple[str, str], most_years: int = 12) -> DataFrame:
    """(entity, year, metrics, margin) from facts (entity, tag, year, val).

    Each metric of an entity comes from the first of its tags that has a value in any year; years are those of any
    metric, the newest ``most_years`` of each entity. Amounts are divided by ``unit``.
    """
    names = F.create_map(*[x for m, names in tags.items() for i, t in enumerate(names) for x in (F.lit(t), F.struct(F.lit(m).alias("metric"), F.lit(i).alias("priority")))])
    rows = facts.where("val is not null").withColumn("t", F.element_at(names, F.col("tag"))).where("t is not null").select("entity", "year", "val", "t.*")
    first = rows.groupBy("entity", "metric").agg(F.min("priority").alias("priority"))
    wide = rows.join(first, ["entity", "metric", "priority"]).groupBy("entity", "year").pivot("metric", list(tags)).agg(F.first("val"))
    wide = wide.withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("year")))).where(F.col("place") <= most_years)
    part, whole = margin
    share = F.when(F.col(whole) != 0, F.round(F.col(part) / F.col(whole) * 100, 2))
    return wide.select("entity", "year", *[F.round(F.col(m) / unit, 2).alias(m) for m in tags], share.alias("margin"))


def histograms(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """(column, bin, n) of equal-width bins of each column; the greatest value falls in the last bin. Ranges are a joined row, not a job of their own."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*").where("x is not null")
    range_ = long.groupBy("column").agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / bins).alias("width"))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0).cast("int")
    return long.join(F.broadcast(range_), "column").groupBy("column", at.alias("bin")).agg(F.count("*").alias("n"))  # one row a column


def applicable_checks(tasks: DataFrame, checks: list[tuple[str, list[str]]], key: str) -> DataFrame:
    """(key, check) of the checks whose capabilities meet a task's (key, capabilities); a check without any applies to all."""
    cells = [F.struct(F.lit(name).alias("check"), (F.arrays_overlap(F.col("capabilities"), F.array(*[F.lit(c) for c in caps])) if caps else F.lit(True)).alias("on")) for name, caps in checks]
    return tasks.select(key, F.inline(F.array(*cells))).where("on").select(key, "check")
