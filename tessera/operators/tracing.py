"""Where the statements of a report come from: figures traced to facts and texts, claims of sources to known sources.

Reports and sources share a key (the task). Figures and claims meet their sources through equi-joins on the key and a
value, but for the names of sources, which are looked for inside the claims of the same key. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.io import cut_lineage
from tessera.operators.audit import LEAST, RELATIVE, nearest_sources, number_trace
from tessera.operators.checks import stated_numbers
from tessera.operators.reports import after_cues, scaled
from tessera.operators.texts import host_of

#: Notes that a figure or claim has no source, cells that are no claims, and documents that must be among the sources.
DISCLOSED = ("模型知识", "未验证", "未在本次检索")
NO_CLAIMS = ("建议以", "仅供参考", "说明", "清单", "名称", "序号", "无直接关联", "已剔除", "不适用", "待获取", "未获取", "暂缺", "未披露", "无此字段", "备注", "数据完整性")
AUTHORITIES = ("年报", "财报", "公告", "官网", "投资者关系", "招股书", "报表", "审计")


def _amounts(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows (value, unit) with the amount in single units and the group of the unit."""
    s = scaled(F.col("value").cast("string"), F.replace(F.coalesce("unit", F.lit("")), F.lit("％"), F.lit("%")))
    return rows.select(*keep, s["amount"].alias("amount"), s["unit_group"].alias("unit_group"))


#: Facts, computed values and numbers in texts of a key that are held beside each of its reports; a key with more is traced by windows over sorted amounts.
HELD = 256


def statement_trace(reports: DataFrame, facts: DataFrame, derived: DataFrame, sources: DataFrame, key: str, window: int = 60, held: int = HELD) -> DataFrame:
    """(key, pos, value, unit, status) of every figure of the reports (key, text) that needs a source.

    structured: a fact (key, value, unit) of the same group of units agrees within less than half a unit or half a percent; derived: a
    percentage is within 0.05 points of the size of a computed one (key, value, unit), another figure within 2 percent of a positive
    fact or computed value, whatever its currency; text: a source (key, text) states the same amount and group of units; disclosed: a
    note without source follows within the window; else untraceable.

    The facts, computed values and numbers of sources of a key are gathered into one row and held beside its reports, up to
    ``held`` of them; keys with more, which are counted first, meet theirs by windows and a join.
    """
    one = F.lit(1).alias("n")
    counted = facts.select(key, one).unionAll(derived.select(key, one)).unionAll(sources.select(key, F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9]+")).alias("n")))
    crowded = cut_lineage(counted.groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") > held).select(key))
    if crowded.isEmpty():
        return _trace_held(reports, facts, derived, sources, key, window)
    side = lambda rows, how: rows.join(crowded, key, how)
    many = _trace_sorted(*[side(rows, "left_semi") for rows in (reports, facts, derived, sources)], key, window)
    return many.unionByName(_trace_held(*[side(rows, "left_anti") for rows in (reports, facts, derived, sources)], key, window))


def _status(structured: Column, derived: Column, text: Column) -> Column:
    noted = F.col("after").rlike("|".join(DISCLOSED))
    return F.when(structured, "structured").when(derived, "derived").when(text, "text").when(noted, "disclosed").otherwise("untraceable").alias("status")


def _trace_held(reports: DataFrame, facts: DataFrame, derived: DataFrame, sources: DataFrame, key: str, window: int) -> DataFrame:
    side = lambda rows, kind: _amounts(rows, key).where("amount is not null").withColumn("kind", F.lit(kind))
    rows = side(facts, 0).unionAll(side(derived, 1)).unionAll(side(stated_numbers(sources.select(key, "text"), key), 2)).where(F.col(key).isNotNull())
    amount, percent = F.col("amount"), F.col("unit_group") == "%"
    of = lambda when, *fields: F.collect_list(F.when(when, F.struct(*fields) if len(fields) > 1 else fields[0]))
    gathered = rows.groupBy(key).agg(
        of(F.col("kind") == 0, amount, "unit_group").alias("known"), of((F.col("kind") == 1) & percent, F.abs(amount)).alias("rates"),
        of((F.col("kind") < 2) & ~percent & (amount > 0), amount).alias("sizes"), of(F.col("kind") == 2, amount, "unit_group").alias("stated"),
    )
    lists = ("known", "rates", "sizes", "stated")
    said = _amounts(stated_numbers(reports.select(key, "text").join(gathered, key, "left"), key, window, lists), key, *lists, "pos", "value", "unit", "after")
    gap = lambda v: F.abs(v - amount)
    same = lambda x: x["unit_group"] == F.col("unit_group")
    structured = F.exists("known", lambda x: same(x) & (gap(x["amount"]) < F.greatest(F.lit(LEAST), F.abs(amount) * RELATIVE)))
    near = F.when(percent, F.exists("rates", lambda v: gap(v) < 0.05)).otherwise(F.exists("sizes", lambda v: gap(v) <= 0.02 * v))
    return said.select(key, "pos", "value", "unit", _status(structured, near, F.exists("stated", lambda x: same(x) & (x["amount"] == amount))))


def _trace_sorted(reports: DataFrame, facts: DataFrame, derived: DataFrame, sources: DataFrame, key: str, window: int) -> DataFrame:
    said = _amounts(stated_numbers(reports.select(key, "text"), key, window), key, "pos", "value", "unit", "after").withColumnRenamed("amount", "figure")
    percent = F.col("unit_group") == "%"
    known, computed = _amounts(facts, key), _amounts(derived, key)
    exact = number_trace(said, known.withColumnRenamed("amount", "value"), [key, "unit_group"]).withColumnRenamed("traced", "structured").drop("nearest")
    loose = known.where(~percent).unionAll(computed).select(key, percent.alias("percent"), F.when(percent, F.abs("amount")).otherwise(F.col("amount")).alias("value"))
    near = nearest_sources(exact.withColumn("percent", percent), loose.where("percent or value > 0"), [key, "percent"])
    gap = lambda c: F.abs(F.col(c) - F.col("figure"))
    agrees = lambda c: F.coalesce(F.when(F.col("percent"), gap(c) < 0.05).otherwise(gap(c) <= 0.02 * F.col(c)), F.lit(False))
    stated = _amounts(stated_numbers(sources.select(key, "text"), key), key).distinct().select(key, "unit_group", F.col("amount").alias("figure"), F.lit(True).alias("text"))
    out = near.withColumn("derived", agrees("below") | agrees("above")).join(stated, [key, "unit_group", "figure"], "left")
    return out.select(key, "pos", "value", "unit", _status(F.col("structured"), F.col("derived"), F.col("text")))


def trace_verdict(traced: DataFrame, key: str, threshold: float, few: int = 0) -> DataFrame:
    """(key, figures, ratio, passed): the share of figures with a source; reports with fewer figures than ``few`` pass."""
    found = F.count_if(F.col("status").isin("structured", "derived", "text")) / F.count("*")
    return traced.groupBy(key).agg(F.count("*").alias("figures"), F.round(found, 6).alias("ratio")).withColumn("passed", (F.col("ratio") >= threshold) | (F.col("figures") < few))


def known_sources(sources: DataFrame, key: str, media: dict[str, str]) -> DataFrame:
    """Distinct (key, name) that a claim may name: addresses, hosts, media of the hosts (by a part of the host), titles and bylines of the sources (key, text)."""
    text = F.coalesce("text", F.lit(""))
    urls = F.regexp_extract_all(text, F.lit("(https?://[^\\s)\\]\"]+)"), F.lit(1))
    hosts = F.transform(urls, host_of)
    outlets = [F.when(F.array_join(hosts, " ").contains(part), F.lit(name)) for part, name in media.items()]
    titles = F.filter(after_cues(text, ("title", "标题"), "[\\n]", 60), lambda t: F.char_length(t) >= 4)
    bylines = F.transform(after_cues(text, ("来源", "转自", "转载自", "原文来自"), r"[^\x{4e00}-\x{9fff}A-Za-z0-9：: ]", 12), lambda b: F.regexp_extract(b, "^([^ ：:]{2,12})", 1))
    names = F.concat(urls, hosts, F.array_compact(F.array(*outlets).cast("array<string>")), titles, bylines)
    return sources.select(key, F.explode(names).alias("name")).where("name <> ''").distinct()


def source_honesty(claims: DataFrame, known: DataFrame, key: str, groups: list[tuple[str, ...]]) -> DataFrame:
    """(key, claim, status) of claims of sources.

    exempt: a status, an advice or a note without source; known: the claim holds a known name of its key, or a name of a
    group of aliases of which another is known; mislabeled: an authoritative document that is not known; open: the rest.
    """
    has = lambda words: F.col("claim").rlike("|".join(words))
    asked = claims.where("claim is not null").select(key, "claim").distinct()
    checked = asked.where(~has(NO_CLAIMS + DISCLOSED))
    aliases = [(name, other) for group in groups for name in group for other in group]
    more = F.inline(F.array(*[F.struct(F.lit(a).alias("is"), F.lit(b).alias("other")) for a, b in aliases])) if aliases else None
    names = known.select(key, "name")
    if more is not None:
        names = names.unionByName(names.select(key, "name", more).where("name = is").select(key, F.col("other").alias("name"))).distinct()
    hits = checked.join(names, key).where(F.col("claim").contains(F.col("name"))).select(key, "claim").distinct().withColumn("hit", F.lit(True))
    status: Column = F.when(has(NO_CLAIMS + DISCLOSED), "exempt").when(F.col("hit"), "known").when(has(AUTHORITIES), "mislabeled").otherwise("open")
    return asked.join(hits, [key, "claim"], "left").select(key, "claim", status.alias("status"))
