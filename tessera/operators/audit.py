"""Report audit: tracing figures to sources, attribution, conflicts, matching and rule checks.

Every check runs over all reports at once; a report never meets more than its own sources or its own bin.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.columns import bind
from tessera.io import cut_lineage
from tessera.operators.texts import ALNUM, HAN, letters, sentences

#: A figure and a source agree within half a unit or half a percent of the figure.
RELATIVE, LEAST = 0.005, 0.5


#: Sources of a key beyond which they are dealt into pages, the pages, and keys with pages that may be broadcast.
CROWD, PAGES, PAGED_KEYS = 200_000, 256, 10_000
#: Figures and sources that a task sorts, about.
SORTED = 1_000_000


def nearest_sources(figures: DataFrame, sources: DataFrame, keys: list[str], crowd: int = CROWD, each: int = SORTED) -> DataFrame:
    """Figures (keys, figure, any other columns) with the nearest sources (keys, value) of the same keys: ``below`` (not above the figure) and ``above`` (not below it).

    Figures and sources are sorted together, and two windows carry the last source upwards and downwards. Both are
    counted first (repeated ones too), and dealt over a task for each ``each`` of them if a shuffle has fewer tasks; where a key has more than ``crowd`` of them, its amounts are cut at their approximate quantiles, each page is a window
    of its own, and takes the nearest source of the pages beyond it where it has none. Null figures, sources and keys meet nothing.
    """
    known = sources.where("value is not null").select(*keys, F.col("value").cast("double").alias("at_")).na.drop(subset=keys)
    counted = sources.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    crowded = counted.where(F.col("n") > crowd).drop("n")
    many, held = counted.agg(F.count_if(F.col("n") > crowd), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = (held + figures.count()) // each + 1
    known = known.distinct() if many else known
    rest = [c for c in figures.columns if c not in keys]
    asked = figures.select(*keys, F.col("figure").cast("double").alias("at_"), F.lit(False).alias("held_"), F.struct(*rest).alias("row_"))
    rows = asked.unionByName(known.withColumn("held_", F.lit(True)), allowMissingColumns=True)
    place = keys
    if not many and parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(parts, *keys)
    if many:
        cuts = known.join(cut_lineage(crowded), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("at_", [i / PAGES for i in range(1, PAGES)], 10_000).alias("cuts_"))
        cuts = cut_lineage(cuts)
        cuts = F.broadcast(cuts) if many <= PAGED_KEYS else cuts
        place, page = [*keys, "page_"], F.coalesce(F.size(F.filter("cuts_", lambda c: c < F.col("at_"))), F.lit(0))
        rows = rows.join(cuts, keys, "left").withColumn("page_", F.when(F.col("cuts_").isNull(), -1).otherwise(page)).drop("cuts_").repartition(*place)
    source = F.when(F.col("held_"), F.col("at_"))
    over = lambda *order: Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("below", F.last(source, ignorenulls=True).over(over("at_", F.desc("held_"))))
    near = near.withColumn("above", F.last(source, ignorenulls=True).over(over(F.desc("at_"), F.desc("held_")))).where(~F.col("held_"))
    beyond = [F.lit(None).cast("double"), F.lit(None).cast("double")]
    if many:
        edges = known.join(cuts, keys).withColumn("page_", page).groupBy(*place).agg(F.max("at_").alias("high_"), F.min("at_").alias("low_"))
        every = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(PAGES - 1))).alias("page_")).join(edges, place, "left")
        past = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        under, above = (F.last(c, ignorenulls=True).over(past(order)).alias(n) for c, order, n in (("high_", F.asc("page_"), "under_"), ("low_", F.desc("page_"), "over_")))
        near, beyond = near.join(every.select(*place, under, above), place, "left"), [F.col("under_"), F.col("over_")]
    told = lambda name, b: F.when(F.col("at_").isNotNull(), F.coalesce(name, b)).alias(name)
    return near.select(*keys, "row_.*", told("below", beyond[0]), told("above", beyond[1]))


def number_trace(figures: DataFrame, sources: DataFrame, key: str | list[str], relative: float = RELATIVE, least: float = LEAST) -> DataFrame:
    """Figures (keys, figure, any other columns) with the nearest source (keys, value; the lesser one on ties) and ``traced``: nearer than ``least`` or the relative share of the figure."""
    near = nearest_sources(figures, sources, [key] if isinstance(key, str) else key)
    down, up = F.col("figure") - F.col("below"), F.col("above") - F.col("figure")
    nearest = F.when(F.col("above").isNull() | (down <= up), F.col("below")).otherwise(F.col("above"))
    near = near.withColumn("nearest", nearest).drop("below", "above")
    close = F.abs(F.col("nearest") - F.col("figure")) < F.greatest(F.lit(least), F.abs("figure") * relative)
    return near.withColumn("traced", F.coalesce(close, F.lit(False)))


def trace_status(traced: DataFrame, totals: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """structured when a source agrees, derived when the total (key, total) is within the share, else untraceable."""
    near = F.abs(F.col("total") - F.col("figure")) <= share * F.abs("figure")
    status = F.when(F.col("traced"), "structured").when(near, "derived").otherwise("untraceable")
    return traced.join(totals, key, "left").select(key, "figure_id", status.alias("status"))


def derived_growth(claims: DataFrame, growth: DataFrame, key: str, points: float = 0.05) -> DataFrame:
    """Claims (key, claim_id, percent) that equal the size of a yearly growth (key, growth_pct) within less than so many points."""
    asked = claims.select(key, F.col("claim_id").alias("figure_id"), F.abs("percent").alias("figure"))
    found = number_trace(asked, growth.select(key, F.abs("growth_pct").alias("value")), key, 0.0, points)
    return found.select(F.col("figure_id").alias("claim_id"), key, F.col("traced").alias("derived"))


def conflicting_figures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with two or more distinct values: the most frequent (least on ties) and how many others."""
    counted = rows.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    main = F.max_by("value", F.struct("n", -F.col("value"))).alias("main_value")
    return counted.groupBy(*keys).agg(main, (F.count("*") - 1).alias("others")).where("others > 0")


def names_in(text: Column, names: list[str]) -> Column:
    """Whether a text holds a name: names with Han characters anywhere, others between characters that are no letters of a word."""
    letter = rf"[\p{{L}}&&[^{HAN}]]"
    quoted = [(re.search(f"[{HAN}]", n), rf"\Q{n.lower()}\E") for n in names if n]
    plain = "|".join(q for han, q in quoted if not han)
    forms = [q for han, q in quoted if han] + ([f"(?<!{letter})(?:{plain})(?!{letter})"] if plain else [])
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(forms)) if forms else F.lit(False)


def entity_attribution(docs: DataFrame, target: list[str], other: list[str]) -> DataFrame:
    """(doc_id, number, near_target, near_other, flagged): flagged when a number only shares sentences with other names."""
    parts = sentences(docs)
    names = lambda words: names_in(F.col("sentence"), words)
    found = F.regexp_extract_all("sentence", F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    rows = parts.select("doc_id", names(target).alias("t"), names(other).alias("o"), F.explode(found).alias("number"))
    out = rows.groupBy("doc_id", "number").agg(F.bool_or("t").alias("near_target"), F.bool_or("o").alias("near_other"))
    return out.withColumn("flagged", F.col("near_other") & ~F.col("near_target"))


#: Verbs of a relation between companies, and words of figures of their own.
RELATION_VERBS = ["投资", "入股", "收购", "融资", "获得", "出资", "补贴", "捐赠", "认购"]
CORE_WORDS = ["营收", "收入", "净利润", "净利", "利润", "毛利率", "总资产", "总负债", "负债", "资产", "现金流", "销售额", "占比", "经营利润", "市值"]
#: Platforms whose names hold the name of a company.
COMPOUNDS = "百度百科|百度知道|百度贴吧|百度文库|谷歌学术|维基百科|微软百科|阿里云盘"


def _figures(texts: DataFrame, key: str, radius: int, **marks: Column) -> DataFrame:
    """(key, number, around, marks): every number with so many characters on both sides of it, and marks of its sentence (columns over ``sentence`` and ``prev``, the one before).

    A sentence is cut at its numbers once; a neighbourhood is put together from at most ``radius`` parts on each side.
    """
    safe = F.regexp_replace(F.coalesce("text", F.lit("")), r"([0-9]),(?=[0-9]{3})", "$1")
    parts = F.filter(F.split(safe, r"[。！？；;\n]+|\.(?![0-9])"), lambda s: F.trim(s) != "")
    rows = texts.select(key, parts.alias("parts")).where(F.size("parts") > 0)
    rows = rows.select(key, F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), F.slice("parts", 1, F.size("parts") - 1)).alias("prev"), F.col("parts").alias("sentence"))))
    rows = rows.toDF(key, "prev", "sentence").where(F.col("sentence").rlike("[0-9]"))
    number = r"(?<![0-9.])[0-9]+(?:\.[0-9]+)?"
    tokens = F.regexp_extract_all("sentence", F.lit(rf"(?s)({number}|[^0-9]+|[0-9])"), F.lit(1))

    def near(found: Column) -> Column:
        left = lambda i: F.array_join(F.slice(found, F.greatest(i + 1 - radius, F.lit(1)), F.least(i, F.lit(radius))), "")
        right = lambda i: F.array_join(F.slice(found, i + 2, F.lit(radius)), "")
        last = lambda text: F.when(F.char_length(text) > radius, F.substring(text, -radius, radius)).otherwise(text)
        one = lambda t, i: F.struct(t.alias("number"), F.concat(bind(left(i), last), t, F.substring(right(i), 1, radius)).alias("around"))
        starts = lambda t, i: t.rlike("^[0-9]") & ((i == 0) | ~F.get(found, i - 1).rlike("[0-9.]$"))
        return F.filter(F.transform(found, lambda t, i: F.when(starts(t, i), one(t, i))), lambda c: c.isNotNull())

    return rows.select(key, *[c.alias(n) for n, c in marks.items()], F.inline(bind(tokens, near)))


def attribution_evidence(reports: DataFrame, sources: DataFrame, key: str, target: list[str], other: list[str], verbs: list[str] = RELATION_VERBS, core: list[str] = CORE_WORDS, radius: int = 80) -> DataFrame:
    """(key, number, checked, contaminated, ambiguous) for every number of a report (key, text) that its sources (key, text) hold.

    Sentences with a relation verb are exempt. A number that the report gives to the target alone is contaminated when the
    sources show it only near other names: within the radius, or so near the end of the sentence before, in a sentence with
    a core word, and never with the target. A number in a sentence without names is ambiguous. Source evidence is gathered
    for each (key, number) before the join.
    """
    sentence = F.col("sentence")
    said = _figures(reports, key, radius, mine=names_in(sentence, target), theirs=names_in(_plain(sentence), other), exempt=names_in(sentence, verbs))
    claims = said.groupBy(key, "number").agg(
        F.count("*").alias("checked"), F.bool_or(F.expr("mine and not theirs and not exempt")).alias("claimed"), F.bool_or(F.expr("not mine and not theirs and not exempt")).alias("ambiguous")
    )
    held = _evidence(sources, key, target, other, core, radius)
    return claims.join(held, [key, "number"]).select(key, "number", "checked", F.expr("claimed and o and not t").alias("contaminated"), "ambiguous")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, COMPOUNDS, "")


def _evidence(sources: DataFrame, key: str, target: list[str], other: list[str], core: list[str], radius: int) -> DataFrame:
    """(key, number, t, o): whether a number stands with the target, and near others in a sentence with a core word, in any source."""
    prev, sentence = F.col("prev"), F.col("sentence")
    tail = F.when(F.char_length(prev) > radius, F.substring(prev, -radius, radius)).otherwise(prev)
    for_target = names_in(sentence, target) | (names_in(prev, target) & ~names_in(_plain(prev), other))
    held = _figures(sources, key, radius, t=for_target, tail=names_in(tail, other), core=names_in(sentence, core))
    o = (names_in(F.col("around"), other) | F.col("tail")) & F.col("core")
    return held.groupBy(key, "number").agg(F.bool_or("t").alias("t"), F.bool_or(o).alias("o"))


def fact_attribution(facts: DataFrame, sources: DataFrame, key: str, target: list[str], other: list[str], core: list[str] = CORE_WORDS, radius: int = 80) -> DataFrame:
    """Facts (key, label, value) with ``status``: target when the label names it; label when it names others; evidence when the sources (key, text) show the value only near others; else fine. A null label names nobody."""
    label = F.coalesce("label", F.lit(""))
    number = F.regexp_replace(F.regexp_replace(F.col("value").cast("string"), "[,，]", ""), r"\.0+$", "")
    held = _evidence(sources, key, target, other, core, radius)
    rows = facts.withColumn("number", number).join(held, [key, "number"], "left")
    status = F.when(names_in(label, target), "target").when(names_in(label, other), "label").when(F.expr("o and not t"), "evidence").otherwise("fine")
    return rows.withColumn("status", status).drop("number", "t", "o")


def source_labeling(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims (claim_id, source) marked by whether the source is a known one; copies of a source count once."""
    names = known.select("source").distinct().withColumn("known", F.lit(True))
    return claims.join(names, "source", "left").withColumn("labelled", F.coalesce("known", F.lit(False))).drop("known")


def collapse_facts(facts: DataFrame) -> DataFrame:
    """One row for each (type, value, unit, label, year): first known region and source, rows behind it."""
    known = [F.min(c).alias(c) for c in ("region", "source")]
    return facts.groupBy("type", "value", "unit", "label", "year").agg(*known, F.count("*").alias("copies"))


def tail_points(points: DataFrame, series: str, order: str, most: int = 240) -> DataFrame:
    """The newest ``most`` points of each series, with ``back``: 1 for the newest."""
    newest = Window.partitionBy(series).orderBy(F.desc(order))
    return points.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= most)


def token_counts(docs: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """(key, tokens, distinct_tokens): runs of at least so many letters in each text, and how many of them differ."""
    words = docs.select(key, F.filter(letters(F.col("text")), lambda w: F.char_length(w) >= least).alias("words"))
    return words.select(key, F.size("words").alias("tokens"), F.size(F.array_distinct("words")).alias("distinct_tokens"))


def merge_by_title(first: DataFrame, second: DataFrame, title: str) -> DataFrame:
    """All rows of the first table, and those of the second whose title the first does not have."""
    return first.unionByName(second.join(first.select(title).distinct(), title, "left_anti").select(first.columns))


def without_rejected(pages: DataFrame, host: str, rejected: Column) -> DataFrame:
    """Pages of hosts none of whose pages is rejected."""
    return pages.join(pages.where(rejected).select(host).distinct(), host, "left_anti")


def absorb_labels(facts: DataFrame) -> DataFrame:
    """Merges collapsed facts of equal (type, value, unit) where one label contains the other and the years are equal or one is unknown.

    A fact contains another by a longer label, or by an equal label and a known year. A fact that none contains is final;
    every other one goes to the final fact that contains it with the longest label (then the least label and year) and
    hands on what that one lacks: the least year, region and source handed on. A fact whose containers are all merged
    themselves stays (a 2024 fact in an unknown year's label that belongs to 2023). Facts with a null value or an empty
    or null label are not merged. Candidates meet on the first two characters of the shorter label, which every
    containing label holds somewhere.
    """
    keys = ["type", "value", "unit"]
    told = [*[F.col(k) for k in keys], F.col("label"), F.coalesce(F.col("year").cast("string"), F.lit("?"))]
    fact = F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit("second"), *told).alias("b"))  # 128 bits
    facts = facts.withColumn("fact_", fact)
    size = F.char_length("label")
    grams = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("label", i, F.lit(2)))
    singles = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("label", i, F.lit(1)))
    held = facts.where(size > 0).select(*keys, F.col("label").alias("label_"), F.col("year").alias("year_"), F.col("fact_").alias("in_"), F.explode(F.array_distinct(F.concat(grams, singles))).alias("gram"))
    mine = facts.where(size > 0).select(*keys, "label", "year", "region", "source", "fact_", F.substring("label", 1, 2).alias("gram"))
    longer = (F.char_length("label_") > size) & F.col("label_").contains(F.col("label")) & F.coalesce(F.col("year") == F.col("year_"), F.lit(True))
    dated = (F.col("label_") == F.col("label")) & F.col("year").isNull() & F.col("year_").isNotNull()
    pairs = mine.join(held, [*keys, "gram"]).where(longer | dated)
    inner = pairs.select("fact_").distinct()
    best = F.min_by(F.col("in_"), F.struct(-F.char_length("label_"), "label_", F.coalesce("year_", F.lit(0))))
    merged = pairs.join(inner.select(F.col("fact_").alias("in_")), "in_", "left_anti").groupBy("fact_").agg(best.alias("in_"))
    given = facts.join(merged, "fact_").groupBy(F.col("in_").alias("fact_")).agg(*[F.min(c).alias(f"{c}_") for c in ("year", "region", "source")], F.sum("copies").alias("copies_"))
    out = facts.join(merged.select("fact_"), "fact_", "left_anti").join(given, "fact_", "left")
    filled = [F.coalesce(c, f"{c}_").alias(c) for c in ("year", "region", "source")]
    return out.select(*keys, "label", *filled, (F.col("copies") + F.coalesce("copies_", F.lit(0))).alias("copies"))


def foreign_entity_filter(facts: DataFrame, target: str, others: list[str]) -> DataFrame:
    """Drops facts whose label or caliber (if they have that column) names another entity, and neither the target."""
    text = F.concat_ws(" ", "label", *[F.col(c) for c in ("caliber",) if c in facts.columns])
    return facts.where(~names_in(text, others) | text.contains(target))


def resolve_names(asked: DataFrame, known: DataFrame, top: int = 5) -> DataFrame:
    """The best ``top`` known names (code, name, market) for each asked (query): one contains the other, found by shared words.

    Score: market bonus 10 / 6 / 4, 2 for an exact match, 3 for a suffix match.
    """
    token = lambda df, text: df.withColumn("token", F.explode(F.array_distinct(letters(F.col(text)))))
    pairs = token(asked.select("query").distinct(), "query").join(token(known, "name"), "token").where(F.col("name").contains(F.col("query")) | F.col("query").contains(F.col("name")))
    bonus = F.when(F.col("market") == "STANDARD", 10).when(F.col("market") == "ECONOMY", 6).otherwise(4)
    score = bonus + F.when(F.col("name") == F.col("query"), 2).otherwise(0) + F.when(F.col("name").endswith(F.col("query")), 3).otherwise(0)
    scored = pairs.select("query", "code", "name", score.alias("score")).distinct()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "code")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Products that are not the share itself, and counters of a share other than the main one.
DERIVATIVE = "沽|购|权证|法兴|摩通|瑞银|麦格理|高盛|德银|花旗|汇丰|中银|大和|野村|法巴|渣打|ETF|收益|周收益|期权|溢价|杠杆|做多|做空|债券|优先"
VARIANT, SUFFIX = "-(?:T|W?R)$", "股份|控股|集团"


def resolve_parts(asked: DataFrame, known: DataFrame, bonus: dict[str, int], other: int = 0, top: int = 5) -> DataFrame:
    """The best ``top`` known names (code, name, market) for each asked (query): one contains the other anywhere.

    The first two characters of the shorter name occur in the longer one, so pairs meet on character bigrams (names of
    one character on that character) and contains is the exact filter. Derivatives are left out. Score: the bonus of the
    market, 3 for a company suffix, 2 for an exact match, -8 for a variant. Empty names and queries match nothing.
    """
    grams = lambda text: F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2)]))
    queries = asked.where(F.col("query") != "").select("query").distinct()
    names = known.where((F.col("name") != "") & ~F.col("name").rlike(DERIVATIVE)).select("code", "name", "market").distinct()
    name, query = F.col("name"), F.col("query")
    inside = queries.withColumn("gram", F.substring("query", 1, 2)).join(names.withColumn("gram", F.explode(grams(name))), "gram").where(name.contains(query))
    around = queries.withColumn("gram", F.explode(grams(query))).join(names.withColumn("gram", F.substring("name", 1, 2)), "gram").where(query.contains(name))
    pairs = inside.select("query", "code", "name", "market").unionAll(around.where(name != query).select("query", "code", "name", "market"))
    market = F.lit(other)
    for key, points in bonus.items():
        market = F.when(F.col("market") == key, points).otherwise(market)
    score = market + F.when(name.rlike(SUFFIX), 3).otherwise(0) + F.when(name == query, 2).otherwise(0) - F.when(name.rlike(VARIANT), 8).otherwise(0)
    scored = pairs.select("query", "code", "name", "market", score.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "code", "name", "market")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("market")


def best_url(pages: DataFrame, host: Column, good: str, official: str) -> DataFrame:
    """The best page of each host: pattern hits, then official, then position."""
    score = F.when(F.lower("url").rlike(good), 3).otherwise(0) + F.when(F.col("url").startswith("https"), 1).otherwise(0)
    rows = pages.select(host.alias("host"), "page_id", "url", score.alias("score"), F.lower("url").rlike(official).cast("int").alias("official"))
    order = F.struct("score", "official", -F.col("page_id"))
    return rows.groupBy("host").agg(F.max_by(F.struct("page_id", "url", "score"), order).alias("s")).select("host", "s.*")


#: Words of financial pages, and parts of addresses by the standing of their source.
FINANCE_WORDS = ("财报", "年报", "季报", "营收", "净利润", "业绩", "财务", "公告", "研报", "复盘", "深度", "投资者关系", "financial", "earnings", "annual", "revenue", "results", "quarterly", "investor")
OFFICIAL_HOSTS = ("ir.", "investor.", "hkex", "eastmoney", "10jqka", "cninfo", "sse.com.cn", "szse.cn")
GOOD_HOSTS = ("sina", "163.com", "21jingji", "yicai", "cls.cn", "finance", "stock", "xueqiu", "snowball", "pedaily")
JUNK_HOSTS = ("blog.csdn", "zhihu.com", "zhengxianling", "cp.baidu", "toutiao", "csdn", "alishui", "sgpjbg")


def pick_url(
    results: DataFrame, key: str, others: tuple[str, ...] = (), topics: tuple[str, ...] = FINANCE_WORDS, official: tuple[str, ...] = OFFICIAL_HOSTS, good: tuple[str, ...] = GOOD_HOSTS, junk: tuple[str, ...] = JUNK_HOSTS
) -> DataFrame:
    """(key, url, score) of the best result of each key, from results (key, pos, title, url, target): by score, then an official source, then position.

    A topic word counts 2 in the title, else 1 in the address; an official source 4, else a good one 2; each junk part takes 2 away.
    With a target: in the title 3, 2 more with a topic, 6 off if other names are there without one; else in the address 1, 1 more with a
    topic and no other name; else a title in Chinese loses 8 if it names others, 4 if not. Results that are no web address are left out.
    """
    title, url = F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))
    low = F.struct(F.lower(title).alias("title"), F.lower(url).alias("url"))
    rows = results.select(key, "pos", title.alias("title"), url.alias("url"), low.alias("low"), F.nullif("target", F.lit("")).alias("target")).where(F.startswith("url", F.lit("http")))
    total = lambda cases: reduce(lambda a, b: a + b, cases, F.lit(0))
    holds = lambda text, words: reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))
    is_official = holds(F.col("low.url"), official)
    words = total([F.when(F.col("low.title").contains(k), 2).when(F.col("low.url").contains(k), 1).otherwise(0) for k in topics])
    standing = F.when(is_official, 4).when(holds(F.col("low.url"), good), 2).otherwise(0) - total([F.when(F.col("low.url").contains(j), 2).otherwise(0) for j in junk])
    topic = holds(F.col("title"), topics)
    foreign = reduce(lambda a, b: a | b, [(F.col("target") != o) & F.col("title").contains(o) for o in others if o], F.lit(False))
    of_target = (
        F.when(F.col("target").isNull(), 0)
        .when(F.col("title").contains(F.col("target")), F.lit(3) + F.when(topic, 2).when(foreign, -6).otherwise(0))
        .when(F.col("url").contains(F.col("target")), F.lit(1) + F.when(topic & ~foreign, 1).otherwise(0))
        .when(F.col("title").rlike(f"[{HAN}]"), F.when(foreign, -8).otherwise(-4))
        .otherwise(0)
    )
    scored = rows.select(key, "pos", "url", (words + standing + of_target).alias("score"), is_official.cast("int").alias("official"))
    best = F.max_by(F.struct("url", "score"), F.struct("score", "official", -F.col("pos")))
    return scored.groupBy(key).agg(best.alias("s")).select(key, "s.*")


#: Words that say nothing of a goal's topic.
GOAL_STOP = ["搜索", "总结", "分析", "报告", "最新", "当前", "现状", "发展", "历程", "集团", "财报", "历年", "年度", "数据", "信息", "内容", "情况", "相关", "进行", "需要", "完成", "输出", "生成", "配合", "the", "and", "with", "for", "report", "analysis", "search", "summary"]
#: Words with the digits and hyphens inside them.
GOAL_WORD = rf"[\p{{L}}&&[^{HAN}]](?:{ALNUM}|-)*"


def goal_overlap(messages: DataFrame, least: int = 4, word: str = rf"[\p{{L}}&&[^{HAN}]]+", stop: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Whether each turn shares a word of so many letters or a pair of Han characters with the turn before it."""
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(word), F.lit(0)), lambda w: F.char_length(w) >= least)
    tokens = F.array_distinct(F.concat(words, F.regexp_extract_all(low, F.lit(f"(?=([{HAN}]{{2}}))"), F.lit(1))))
    tokens = F.array_except(tokens, F.array(*[F.lit(w) for w in stop])) if stop else tokens
    before = F.lag("tokens").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = messages.select("conv_id", "turn", tokens.alias("tokens"))
    return rows.withColumn("before", before).select("conv_id", "turn", F.coalesce(F.arrays_overlap("tokens", "before"), F.lit(False)).alias("overlap"))


def latency_join(starts: DataFrame, results: DataFrame, key: str, seconds: float) -> DataFrame:
    """Each start (id, key, ts) with seconds to the first later result (key, ts), null beyond the limit: union and one window."""
    both = starts.select("id", key, "ts", F.lit(0).alias("side")).unionByName(results.select(F.lit(None).cast("long").alias("id"), key, "ts", F.lit(1).alias("side")))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy(key).orderBy("ts", "side").rowsBetween(0, Window.unboundedFollowing)
    after = F.first(F.when(F.col("side") == 1, micros), True).over(order)
    rows = both.withColumn("latency", F.round((after - micros) / 1e6, 3)).where("side = 0")
    return rows.select("id", key, F.when(F.col("latency") <= seconds, F.col("latency")).alias("latency"))


def run_checks(df: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """(key, check, ok) of every user check, from one scan; a check that yields null counts as failed."""
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in checks])
    return df.select(key, F.inline(cells))


@dataclass(frozen=True)
class Check:
    """A registered check: ok is a boolean column, or a struct(ok, detail) as ``python_check`` makes; it applies to tasks with one of the capabilities, or to all."""

    name: str
    ok: Column
    applies: tuple[str, ...] = ()


def python_check(check: Callable[..., tuple[bool, str]], *columns: str) -> Column:
    """struct(ok, detail) of a Python check over some columns, in Arrow batches; a check that raises has failed, with the error as detail."""

    def run(*values: object) -> tuple[bool, str]:
        try:
            ok, detail = check(*values)
            return bool(ok), str(detail)
        except Exception as problem:
            return False, f"{type(problem).__name__}: {problem}"

    return F.udf(run, "struct<ok:boolean,detail:string>", useArrow=True)(*columns)


def registered_checks(df: DataFrame, key: str, capabilities: Column, checks: list[Check], chars: int = 200) -> DataFrame:
    """(key, check, ok, detail) of the checks that apply to a row's capabilities (null: none), from one scan; null counts as failed."""
    cells = []
    for i, c in enumerate(checks):
        df = df.withColumn(f"check_{i}", c.ok)
        told = isinstance(df.schema[f"check_{i}"].dataType, StructType)
        ok, detail = (F.col(f"check_{i}.ok"), F.left(f"check_{i}.detail", F.lit(chars))) if told else (F.col(f"check_{i}"), F.lit(None).cast("string"))
        cell = F.struct(F.lit(c.name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail"))
        cells.append(F.when(F.arrays_overlap(capabilities, F.array(*map(F.lit, c.applies))), cell) if c.applies else cell)
    return df.select(key, F.inline(F.array_compact(F.array(*cells))))


def audit_rollup(results: DataFrame, key: str) -> DataFrame:
    """Pass or fail with the ordered gap list, from (key, check, ok)."""
    gaps = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("check")))), ",")
    return results.groupBy(key).agg(F.bool_and("ok").alias("passed"), gaps.alias("gaps"))


def lookup(df: DataFrame, column: Column, table: dict[str, str], default: Column) -> DataFrame:
    """Adds ``found`` from a fixed parameter table, else the default."""
    return df.withColumn("found", reduce(lambda out, kv: F.when(column == kv[0], kv[1]).otherwise(out), reversed(table.items()), default))


def spec_provenance(rows: DataFrame, texts: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows (key, label, value) whose value, as a whole number without sign, occurs in the blank-free text of the key; keys keep ``least`` rows or none."""
    plain = texts.select(key, F.regexp_replace("text", r"[ \t\n\r]+", "").alias("plain"))
    form = F.abs("value").cast("long").cast("string")
    kept = rows.join(plain, key).where(F.col("plain").contains(form)).select(key, "label", "value")
    return kept.withColumn("n_", F.count("*").over(Window.partitionBy(key))).where(F.col("n_") >= least).drop("n_")


def schedule_calendar(jobs: DataFrame, end: Column) -> DataFrame:
    """(job_id, due): every interval of minutes from the start to the end, the start itself being only a baseline."""
    step = F.make_dt_interval(mins=F.col("minutes"))
    due = F.filter(F.sequence("start", F.greatest(end, F.col("start")), step), lambda t: t > F.col("start"))
    return jobs.select("job_id", F.explode(due).alias("due"))

