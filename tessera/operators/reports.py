"""Report texts: table rows, scrubbing, source claims, companies and years, cases, rules and units.

All are column expressions; tables inside texts are found by exploding lines, so only the lines of one text meet.
Null texts count as empty unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import any_of, strip

CJK = r"[\x{4e00}-\x{9fff}]"
#: Fixed values of the report format: headers of each column, units in headers, marks of an empty value.
VALUE_HEADS = ("数值", "规模", "金额", "份额", "增速", "营收")
METRIC_HEADS, YEAR_HEADS = ("指标", "指标/年份", "指标名称"), ("年份", "时间", "年度")
SOURCE_HEADS, NOTE_HEADS = ("来源", "来源链接", "出处", "链接"), ("口径", "口径说明", "口径/年份", "统计口径", "口径范围", "备注")
UNITS = "亿美元|亿元|%|万辆|万台|美元"
EMPTY = ("", "—", "-", "―", "–")


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def cells(line: Column) -> Column:
    """Trimmed cells of a table line without its outer bars."""
    return F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))


def table_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, line, block, at, header): lines of every text; block and at number the tables and their lines, header is the first line's cells.

    Lines outside tables, and runs of bars without a rule as second line, have a null header.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n", "line"))
    bar = F.startswith(F.trim("line"), F.lit("|"))
    order = Window.partitionBy(id_col).orderBy("n")
    lines = lines.withColumns({"bar": bar, "block": F.sum(F.when(bar, 0).otherwise(1)).over(order)})
    inside = Window.partitionBy(id_col, "block", "bar").orderBy("n")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rule = F.nth_value("line", 2).over(whole).rlike(r"^\s*\|[\s:\-|]+\|\s*$")
    return lines.withColumns({"at": F.row_number().over(inside) - 1, "header": F.when(F.col("bar") & rule, cells(F.first("line").over(whole)))})


def _column(names: tuple[str, ...]) -> Column:
    """The cell under the first of the headers that is there, else null."""
    spots = [F.array_position("header", F.lit(n)) for n in names]
    place = F.coalesce(*[F.when(s > 0, s) for s in spots])
    return F.when(place.isNotNull(), F.get("cell", place.cast("int") - 1))


def _like(names: tuple[str, ...]) -> Column:
    """Position (from 0) of the header that equals one of the names, else of the first that contains one."""
    exact = F.coalesce(*[F.when(F.array_position("header", F.lit(n)) > 0, F.array_position("header", F.lit(n))) for n in names])
    loose = F.array_position(F.transform("header", lambda h: h.rlike("|".join(names))), F.lit(True))
    return F.coalesce(exact, F.when(loose > 0, loose)).cast("int") - 1


def md_table_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, label, value, unit, year, source, note) from tables with a value column; a value needs a unit, its own or its header's."""
    rows = table_lines(docs, id_col, text).where(F.col("header").isNotNull() & (F.col("at") >= 2) & ~F.col("line").contains("---"))
    rows = rows.withColumns({"cell": cells(F.col("line")), "spot": _like(VALUE_HEADS)}).where(F.col("spot").isNotNull())
    raw = F.regexp_replace(F.get("cell", F.col("spot")), "[,，]", "")
    number = F.regexp_extract(raw, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    own = F.regexp_extract(raw, rf"[0-9]+(?:\.[0-9]+)?\s*({UNITS}|(?:万亿|千亿|百亿|亿|万)(?:美元|元)?|)", 1)
    from_head = F.regexp_extract(F.get("header", F.col("spot")), "[（(]([^）)]*)[）)]", 1)
    head_unit = F.when(from_head.rlike("元|万亿|%|万辆|万台"), F.trim(from_head))
    label = F.coalesce(_none(_column(METRIC_HEADS)), F.get("cell", F.lit(0)))
    year = F.coalesce(_none(F.regexp_extract(F.coalesce(_column(YEAR_HEADS), F.lit("")), "(20[0-9]{2})", 1)), _none(F.regexp_extract("line", "(20[0-9]{2})", 1))).cast("int")
    found = rows.select(id_col, "n", label.alias("label"), number.alias("value"), F.coalesce(_none(own), head_unit).alias("unit"), year.alias("year"), _column(SOURCE_HEADS).alias("source"), _column(NOTE_HEADS).alias("note"))
    return found.where("value is not null and unit is not null")


#: Headers of chart tables by meaning, in order of preference, and words of units in a header.
FACT_HEADS = {
    "value": ("数值", "规模", "金额", "份额", "增速", "营收"), "metric": ("指标", "指标/年份", "指标名称"), "year": ("年份", "时间", "年度"), "source": ("来源", "来源链接", "出处", "链接"),
    "caliber": ("口径", "口径说明", "口径/年份", "统计口径", "口径范围", "备注"),
}
HEAD_UNITS = ("美元", "亿元", "万亿", "%", "万辆", "万台", "元", "欧元", "人民币")
#: Metrics named after the header of their values.
HEAD_METRICS = (("规模|市场", "市场规模"), ("份额|占比", "市场份额"), ("增速|增长|复合", "增速"))


def md_table_facts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block, n, metric, year, value, unit, caliber, source) of the lines of all tables with a column of values; a line with a column of shares gives a second row in percent.

    A table is a run of at least three lines in bars; its third line and those behind are data. A value needs a unit: its own, or the one in
    brackets in the header. The year may be anywhere in the line, the source is an address in its column or else in any cell, the
    caliber its column or else the first cell that says something new.
    """
    whole = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\|.+\|(?:\n\|.+\|)+)"), F.lit(1))
    bars = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), strip)
    tables = docs.select(id_col, F.posexplode(F.transform(whole, lambda t: F.split(t, "\n"))).alias("block", "lines")).where(F.size("lines") >= 3)
    tables = tables.select(id_col, "block", bars(F.get("lines", F.lit(0))).alias("head"), F.posexplode(F.slice("lines", F.lit(3), F.size("lines"))).alias("n", "line"))
    last = lambda name: F.when(F.array_contains("head", name), F.size("head") - F.array_position(F.reverse("head"), F.lit(name)))
    spot = lambda kind: F.coalesce(*[last(n) for n in FACT_HEADS[kind]]).cast("int")
    loose = F.array_position(F.transform("head", lambda h: h.rlike("|".join(FACT_HEADS["value"]))), F.lit(True))
    spots = F.struct(F.coalesce(spot("value"), F.when(loose > 0, loose - 1)).cast("int").alias("value"), *[spot(k).alias(k) for k in ("metric", "year", "source", "caliber")])
    rows = tables.where(~F.col("line").contains("---")).select(id_col, "block", "n", "head", bars(F.col("line")).alias("cells"), spots.alias("at")).where("at.value < size(cells)")
    cell = lambda kind: F.when(F.col(f"at.{kind}") < F.size("cells"), F.get("cells", F.col(f"at.{kind}")))
    share = F.array_position(F.transform("head", lambda h, i: (i != F.col("at.value")) & h.rlike("占比|份额")), F.lit(True)).cast("int") - 1
    joined, empty = F.array_join("cells", " "), F.lit("")
    number = r"([0-9]+(?:\.[0-9]+)?)\s*(万亿|千亿|百亿|亿|万)?\s*(亿美元|亿元|%|万辆|万台|美元)?"
    part = lambda i: F.regexp_extract(F.regexp_replace(cell("value"), "[,，]", ""), number, i)
    named = F.regexp_extract(F.get("head", F.col("at.value")), "[（(]([^）)]*)[）)]", 1)
    unit = F.coalesce(_none(F.when((part(2) != "") & (part(3) == "美元"), F.concat(part(2), part(3))).otherwise(part(3))), F.when(named.rlike("|".join(HEAD_UNITS)), strip(named)))
    url = r"(https?://[^\s)\]]+)"
    own = lambda c: F.coalesce(_none(F.regexp_extract(c, url, 1)), _none(F.substring(c, 1, 40)))
    source = F.coalesce(own(F.coalesce(cell("source"), empty)), _none(F.regexp_extract(joined, url, 1)), empty)
    by_head = F.get("head", F.col("at.value"))
    for pattern, name in reversed(HEAD_METRICS):
        by_head = F.when(F.get("head", F.col("at.value")).rlike(pattern), name).otherwise(by_head)
    metric = F.when(cell("metric").isNull(), by_head).when(cell("metric").isin("", "—", "-"), "指标").otherwise(F.substring(cell("metric"), 1, 30))
    found = rows.select(
        id_col, "block", "n", "head", "cells", metric.alias("metric"), part(1).try_cast("double").alias("value"), unit.alias("unit"), source.alias("source"), cell("value").alias("raw"), _none(F.coalesce(cell("caliber"), empty)).alias("said"),
        F.coalesce(_none(F.regexp_extract(F.coalesce(cell("year"), empty), "(20[0-9]{2})", 1)), _none(F.regexp_extract(joined, "(20[0-9]{2})", 1))).cast("int").alias("year"),
        F.regexp_extract(F.when((share >= 0) & (share < F.size("cells")), F.get("cells", share)), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias("share"),
    ).where("value is not null and unit is not null")
    plain = r"^[0-9.]+(万亿|千亿|百亿|亿|万)?(美元|元|%|辆|台)?$"
    new = lambda c: ~c.isin("", "—", "-") & (c != F.col("metric")) & (c != F.col("raw")) & ~c.rlike(plain) & ((F.col("source") == "") | (c != F.col("source")))
    caliber = F.coalesce(F.substring("said", 1, 30), F.substring(F.get(F.filter("cells", new), 0), 1, 30), F.lit("表格"))
    first = F.get("cells", F.lit(0))
    of_share = F.when((first != "") & ~F.array_contains("head", first), first).otherwise(F.coalesce(_none(F.substring("metric", 1, 20)), F.lit("占比")))
    one = lambda m, v, u, c: F.struct(m.alias("metric"), v.alias("value"), u.alias("unit"), c.alias("caliber"))
    both = F.array_compact(F.array(one(F.col("metric"), F.col("value"), F.col("unit"), caliber), F.when(F.col("share").isNotNull(), one(F.lit("市场份额"), F.col("share"), F.lit("%"), of_share))))
    return found.select(id_col, "block", "n", "year", "source", F.inline(both)).select(id_col, "block", "n", "metric", "year", "value", "unit", "caliber", "source")


def scrub_blocks(text: Column) -> Column:
    """Tagged chart data up to the next blank line (or the end) and feedback blocks up to the next heading are removed."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\[CHART_DATA\]")
    out = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(p.rlike(r"\n\s*\n"), F.regexp_replace(p, r"(?s)^.*?\n\s*\n", "")).otherwise("")), "")
    parts = F.split(out, "【反思要求重做】|【历史教训")
    out = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.regexp_extract(p, r"(?s)\n#{1,6} .*", 0))), "")
    return F.array_join(F.filter(F.split(out, "\n"), lambda line: ~line.contains("反思要求重做")), "\n")


#: How lines of prompts and working notes start.
INTERNAL = ("【角色】", "【受众】", "【输出要求】", "【质量标准】", "[指令]", "[数据来源]", "[上一步结果]", "ReAct 达到最大轮数", "用户目标：", "原始指令：", "任务目标：")


def scrub_fallback(text: Column, internal: tuple[str, ...] = INTERNAL) -> Column:
    """Drops lines that start like a prompt, lines of raw JSON, and list items that are only a link."""

    def kept(line: Column) -> Column:
        line = F.ltrim(line)
        raw = F.startswith(line, F.lit('{"')) | F.startswith(line, F.lit("[{"))
        link = F.startswith(line, F.lit("- ")) & F.trim(F.substr(line, F.lit(3))).rlike(r"^https?://\S+$")
        return ~(F.exists(F.array(*map(F.lit, internal)), lambda mark: F.startswith(line, mark)) | raw | link)

    return F.trim(F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), kept), "\n"))


def report_scrub(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): blocks scrubbed, then table rows without a value and without a link dropped. Rows with equal ids are told apart."""
    clean = docs.select(id_col, F.monotonically_increasing_id().alias("row_"), scrub_blocks(F.col(text)).alias("text_"))
    known = clean.select(F.struct("row_", id_col).alias("key_"), "text_")
    lines = table_lines(known, "key_", "text_").withColumns({"cell": cells(F.col("line")), "spot": _like((*VALUE_HEADS, "市值", "收入", "预测值"))})
    blank = F.col("header").isNotNull() & (F.col("at") >= 2) & F.get("cell", F.col("spot")).isin(*EMPTY) & ~F.exists("cell", lambda c: c.contains("http"))
    kept = lines.where(~F.coalesce(blank, F.lit(False)))
    whole = kept.groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    return whole.select(F.col(f"key_.{id_col}").alias(id_col), F.array_join("lines.line", "\n").alias("text"))


#: Words before a name that are no part of it, marks of a company from the surest on, and words between a name and a report.
ERRANDS = ("搜索", "总结", "分析", "调研", "梳理", "介绍", "了解", "盘点", "回顾", "关于", "针对", "研究", "预测")
MARKS = (("集团", "控股"), ("公司",), ("财报", "年报", "季报", "财务"))
PERIODS = ("历年年度", "历年", "年度", "最新", "的")


def company(text: Column, errands: tuple[str, ...] = ERRANDS, marks: tuple[tuple[str, ...], ...] = MARKS) -> Column:
    """The name of two to six characters before the first mark of the surest kind that has one; empty when there is none.

    A name starts behind the last errand word of its run of characters; of a longer run the last six count.
    """
    names = []
    for kind in marks:
        before = F.get(F.split(text, "|".join(kind), 2), F.lit(0))
        run = F.when(before != text, F.regexp_extract(before, f"({CJK}*)$", 1))
        name = F.element_at(F.split(F.regexp_replace(run, f"(?:{'|'.join(PERIODS)})+$", ""), "|".join(errands)), -1)
        names.append(F.when(F.char_length(name) >= 2, F.right(name, F.lit(6))))
    return F.coalesce(*names, F.lit(""))


def years(text: Column) -> Column:
    """struct(first, last) of the years named."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(20[0-9]{2})"), 1), lambda y: y.cast("int"))
    return F.struct(F.array_min(found).alias("first"), F.array_max(found).alias("last"))


def kb_id(text: Column) -> Column:
    """The id in ``[kb:id]``, else in ``kb_id=id``, else null."""
    return F.coalesce(_none(F.regexp_extract(text, r"\[kb:([A-Za-z0-9_\-]+)\]", 1)), _none(F.regexp_extract(text, r"kb_id=([A-Za-z0-9_\-]+)", 1)))


#: Words that announce a source, ends of the names of media, reports that are no media, and domains.
CUES = ("数据来源", "来源", "引自", "出自", "来自", "根据")
MEDIA = ("网", "新闻", "财经", "报")
NO_MEDIA = "年财月周公表道"
DOMAINS = ("com", "cn", "net", "org", "info", "io", "cc", "co.uk")


def after_cues(text: Column, cues: tuple[str, ...], stop: str, longest: int) -> Column:
    """What follows each cue, without colons and blanks, up to a stop mark and so many characters."""
    behind = F.slice(F.split(text, "|".join(sorted(cues, key=len, reverse=True))), 2, 1 << 30)
    return F.transform(behind, lambda c: F.trim(F.left(F.get(F.split(F.ltrim(c, F.lit("：: \t")), stop, 2), F.lit(0)), F.lit(longest))))


def source_claims(text: Column, cues: tuple[str, ...] = CUES, longest: int = 60) -> Column:
    """Distinct claims of sources: what follows a cue up to a mark or bar, then the cells of table lines that speak of a source; links count by their text."""
    said = after_cues(text, cues, "[。；\n，,|]", longest)
    sourced = F.filter(F.split(text, "\n"), lambda line: F.startswith(F.ltrim(line), F.lit("|")) & line.contains("来源"))
    named = F.transform(F.flatten(F.transform(sourced, cells)), lambda c: F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1"))
    return F.filter(F.array_distinct(F.concat(said, F.filter(named, lambda c: ~c.contains("http")))), lambda c: F.char_length(c) >= 2)


def hosts_in(text: Column, domains: tuple[str, ...] = DOMAINS) -> Column:
    """The hosts in a text, without www: those behind http(s), and bare ones of a known domain."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9.:/_-]+"), lambda w: w.rlike(r"^https?://.|^[^:/]*[a-z0-9]\.(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")(?:[:/]|$)"))
    return F.transform(words, lambda w: F.regexp_extract(w, r"^(?:https?://)?(?:www\.)?([^:/]*)", 1))


#: How a report declares a source as not used, and headings of its lists of sources.
REJECTS, APPENDIX = ("已剔除", "剔除", "排除", "不采用"), ("数据来源", "参考文献", "来源附录")


def strip_rejected(text: Column, rejects: tuple[str, ...] = REJECTS, appendix: tuple[str, ...] = APPENDIX) -> Column:
    """Drops the entries of source lists that hold a host or address which the report declares as rejected.

    A declaration reaches from its word to the end of the sentence or line; entries are list items, table rows and lines with an
    address in sections whose heading names a list of sources.
    """
    said = F.array_join(after_cues(text, rejects, r"[。；\n]", 1 << 20), " ")
    gone = F.filter(F.array_union(hosts_in(said), F.regexp_extract_all(said, F.lit(r"(https?://[^\s，；)\]\"']+)"), F.lit(1))), lambda name: name != "")

    def kept(line: Column) -> Column:
        low = F.lower(F.trim(line))
        entry = low.rlike(r"^[-*+|]") | (low.contains("http") & ~F.startswith(low, F.lit("#")))
        return ~(entry & F.exists(gone, lambda name: low.contains(F.lower(name))))

    def section(part: Column) -> Column:
        listed = F.get(F.split(part, "\n", 2), F.lit(0)).rlike(r"^#{1,6}\s.*(?:" + "|".join(appendix) + ")")
        return F.when(listed, F.array_join(F.filter(F.split(part, "\n"), kept), "\n")).otherwise(part)

    parts = F.split(F.coalesce(text, F.lit("")), r"(?m)(?=^#{1,6}\s)")
    whole = F.array_join(F.transform(parts, section), "")
    return F.when(F.size(gone) > 0, whole).otherwise(F.coalesce(text, F.lit("")))


def media_suggestions(claim: Column, known: tuple[str, ...], ends: tuple[str, ...] = MEDIA) -> Column:
    """array of struct(word, host): distinct unknown media words of a claim, with the first host named beside them.

    A run of characters is cut behind each end of a media name; a word is such an end with two to eight characters before it.
    """
    end = f"(?:{'|'.join(ends)})"
    pieces = F.split(F.regexp_replace(claim, f"({end}+)", "$1\n"), r"[^\x{4e00}-\x{9fff}]+")
    words = F.transform(pieces, lambda w: F.regexp_extract(w, f"({CJK}{{2,8}}{end})$", 1))
    other = F.filter(F.array_except(words, F.array(*map(F.lit, known)).cast("array<string>")), lambda w: (w != "") & ~w.rlike(f"[{NO_MEDIA}]报$"))
    return F.transform(other, lambda w: F.struct(w.alias("word"), _none(F.get(hosts_in(claim), F.lit(0))).alias("host")))


def case_issues(value: Column) -> Column:
    """Names of required fields of a case (JSON text) that are missing or of the wrong kind, in order; empty texts, lists and objects count as missing."""
    at = lambda name: F.coalesce(F.get_json_object(value, f"$.{name}"), F.lit(""))
    absent = lambda name: at(name).isin("", "[]", "{}")
    bad = [(n, absent(n)) for n in ("id", "goal", "expected_deliverable")] + [(n, absent(n) | ~F.startswith(at(n), F.lit(mark))) for n, mark in (("ground_truth_points", "["), ("rubric", "{"))]
    return F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in bad]))


def strategy_rules(rules: DataFrame) -> DataFrame:
    """(id, kind, word) of rules (id, rule): words to block and words to prefer; rules of neither kind are dropped."""
    low = F.lower("rule")
    kind = F.when(F.col("rule").contains("排除") | low.startswith("exclude"), "block").when(F.col("rule").contains("优先") | low.startswith("prefer"), "boost")
    word = F.when(F.col("rule").contains(":"), F.regexp_replace("rule", "(?s)^[^:]*:", "")).otherwise(F.regexp_replace("rule", "^(?:排除|优先)", ""))
    return rules.select("id", kind.alias("kind"), F.lower(F.trim(word)).alias("word")).where("kind is not null and word <> ''")


#: Magnitudes of units, and names of one currency.
SCALES = (("万亿", 1e12), ("千亿", 1e11), ("百亿", 1e10), ("亿", 1e8), ("万", 1e4))
CURRENCIES = (("hkd", ("hkd", "港元", "港币", "hk$")), ("usd", ("usd", "美元", "$")), ("cny", ("cny", "人民币", "元")))


def scaled(value: Column, unit: Column) -> Column:
    """struct(amount, unit_group): separators stripped, magnitude applied, currency names folded; the rest of the unit stays as it is."""
    number = F.translate(value, ",， \t\n\x0b\f\r", "").try_cast("double")
    factor, group, low = F.lit(1.0), F.lower(F.trim(unit)), F.lower(F.trim(unit))
    for name, size in reversed(SCALES):
        factor = F.when(unit.contains(name), size).otherwise(factor)
    for name, words in reversed(CURRENCIES):
        group = F.when(any_of(low, words), name).otherwise(group)
    return F.struct((number * factor).alias("amount"), group.alias("unit_group"))


def plot_rows(facts: DataFrame, names: dict[str, str], default_source: str = "检索资料") -> DataFrame:
    """(metric, value, unit, year, note, source) of facts (type, label, value, unit, year, source, series): the series names the metric, else the type does."""
    metric = F.coalesce(_none(F.col("series")), *[F.when(F.col("type") == k, v) for k, v in names.items()], F.col("label"))
    year = F.coalesce("year", _none(F.regexp_extract("label", "(20[0-9]{2})", 1)).cast("int"))
    return facts.where("value is not null").select(
        metric.alias("metric"), "value", F.coalesce("unit", F.lit("")).alias("unit"), year.alias("year"), F.coalesce("label", F.lit("?")).alias("note"), F.coalesce(_none(F.col("source")), F.lit(default_source)).alias("source")
    )
