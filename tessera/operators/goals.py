"""What a goal asks for: the structured source that it is routed to, its subject words, and the charts that keep to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import any_of, bind, strip
from tessera.operators.routing import CRYPTO_WORDS, MARKET_WORDS, NEWS_WORDS, goal_bigrams

# Fixed values of the routing.
US_WORDS = ("美股", "纳斯达克", "nasdaq", "nyse", "纽交所", "美国股市", "美国股票", "us股", "美股排行")
MACRO_ROUTE = ("gdp", "cpi", "通胀", "通货膨胀", "失业率", "宏观", "宏观经济", "unrate", "pmi", "消费者物价", "利率", "降息", "加息", "美联储", "联邦基金")
COIN_NAMES = (("比特币", "bitcoin"), ("以太坊", "ethereum"), ("大饼", "bitcoin"), ("二饼", "ethereum"), ("狗狗币", "dogecoin"), ("币安币", "binancecoin"))
COIN_CODES = {"btc": "bitcoin", "eth": "ethereum", "sol": "solana", "bnb": "binancecoin", "usdt": "tether", "usdc": "usd-coin", "xrp": "ripple", "doge": "dogecoin"}
NO_COINS = ("usd", "cny", "eur", "price")
INDICATORS = ((("失业",), "UNRATE"), (("通胀", "cpi", "消费者物价"), "CPIAUCSL"), (("gdp", "国内生产总值"), "GDP"), (("利率", "降息", "加息", "美联储", "联邦基金"), "DFF"))
#: Fields that are left out of charts unless the goal names them, words (and parts of words) that name no subject, and technical words that do.
SIDE_FIELDS = ("人形机器人", "机器人", "soc", "汽车", "手机", "白宫", "dram", "pcb", "oled", "投资", "财报", "具身智能", "蓝牙", "显示器", "面板")
NO_SUBJECTS = (
    "市场", "报告", "调研", "分析", "全球", "中国", "国内", "国际", "可视化", "生成", "最新", "现状", "趋势", "规模", "份额", "数据", "行业", "情况", "请分", "进行", "梳理", "汇总", "总结", "要点",
    "评估", "方案", "项目", "产品", "技术", "领域", "相关", "以及", "我们", "可以", "需要", "完成", "输出", "一份", "文档", "内容", "差异", "明确", "要求", "必须", "时间", "方面", "主要", "官方",
    "权威", "机构", "经济", "整理", "请调", "研并", "并总", "年至", "年间", "球主", "要经", "济体", "体在", "工智", "能算", "力基", "础设", "施方", "资规", "心技", "术路", "线差", "异及", "及相",
    "关的", "策法", "求数", "据必", "须附", "附带", "带明", "确的", "的官", "方或", "或权", "威机", "构出", "并按", "按时", "间线", "线整",
)
TECH_WORDS = ("ai", "gpu", "soc", "ev", "llm", "iot", "saas", "b2b", "b2c", "erp", "crm", "cpu")


def _first(goal: Column, cases, default: str) -> Column:
    return F.coalesce(*[F.when(any_of(goal, list(words)), F.lit(name)) for words, name in cases], F.lit(default))


def route_goal(goal: Column) -> Column:
    """struct(route, market, metric, coin, indicator) of the first structured source that a goal names: ranking, crypto, macro, news; all null without one."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    route = F.coalesce(*[F.when(any_of(low, list(words)), F.lit(name)) for name, words in (("ranking", MARKET_WORDS), ("crypto", CRYPTO_WORDS), ("macro", MACRO_ROUTE), ("news", NEWS_WORDS))])
    code = F.get(F.filter(F.regexp_extract_all(low, F.lit("([a-z]{2,12})"), F.lit(1)), lambda t: ~t.isin(*NO_COINS)), 0)
    codes = F.create_map(*[F.lit(x) for pair in COIN_CODES.items() for x in pair])
    coin = F.coalesce(*[F.when(low.contains(name), F.lit(value)) for name, value in COIN_NAMES], F.try_element_at(codes, code), code, F.lit("bitcoin"))
    metric = F.when(low.contains("成交量") & ~low.contains("成交额"), "volume").otherwise("amount")
    return bind(
        F.struct(route.alias("route"), low.alias("low")),
        lambda v: F.struct(
            v["route"].alias("route"), F.when(v["route"] == "ranking", _first(v["low"], ((US_WORDS, "us"),), "a")).alias("market"), F.when(v["route"] == "ranking", metric).alias("metric"),
            F.when(v["route"] == "crypto", coin).alias("coin"), F.when(v["route"] == "macro", _first(v["low"], INDICATORS, "GDP")).alias("indicator"),
        ),
    )


def side_fields(goal: Column) -> Column:
    """The side fields that a goal does not name."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    return F.filter(F.array(*map(F.lit, SIDE_FIELDS)), lambda w: ~low.contains(w))


def goal_subjects(goal: Column) -> Column:
    """The distinct subject words of a goal: pairs of Han characters and technical words that are neither general nor of a side field."""
    low = F.lower(F.coalesce(goal, F.lit("")))
    pairs = F.filter(goal_bigrams(low, 4), lambda p: ~p.isin(*NO_SUBJECTS))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z]{2,8})"), F.lit(1)), lambda w: w.isin(*TECH_WORDS))
    return bind(side_fields(goal), lambda off: F.filter(F.array_distinct(F.concat(pairs, words)), lambda c: ~F.exists(off, lambda e: c.contains(e))))


def filter_chart_specs(specs: DataFrame, goals: DataFrame, key: str) -> DataFrame:
    """Charts (key, pos, title, question, conclusion, data: array of structs with label, caliber and source) that keep to their goal (key, goal).

    A chart whose title, question or conclusion names a side field goes, as do such rows of others; so does a chart without rows, and one
    that names no subject of the goal in title, question, labels or calibers. A goal without subjects asks for none.
    """
    text = lambda *parts: F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    asked = goals.select(key, side_fields(F.col("goal")).alias("off_"), goal_subjects(F.col("goal")).alias("core_"))
    rows = specs.join(asked, key)
    names = lambda words, t: F.exists(words, lambda w: t.contains(w))
    kept = F.filter(F.coalesce("data", F.array().cast(specs.schema["data"].dataType)), lambda r: r.isNotNull() & ~names("off_", text(r["label"], r["caliber"], r["source"])))
    rows = rows.where(~names("off_", text(F.col("title"), F.col("question"), F.col("conclusion")))).withColumn("data", kept).where(F.size("data") > 0)
    said = F.concat_ws(" ", text(F.col("title"), F.col("question")), F.array_join(F.transform("data", lambda r: text(r["label"], r["caliber"])), " "))
    return rows.where((F.size("core_") == 0) | bind(said, lambda t: names("core_", t))).drop("off_", "core_")


def normalized(text: Column) -> Column:
    """Without separators and blanks, and without zeros behind a decimal point."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[,，\s]+", ""), r"\.0+(?=[^0-9]|$)", "")


def number_candidates(value: Column, unit: Column) -> Column:
    """The forms in which a text may state a figure: with its unit, with the magnitude only, and with either percent sign."""
    unit = F.coalesce(unit, F.lit(""))
    short = F.regexp_replace(unit, "^(万亿|千亿|百亿|亿|万).*$", "$1")
    forms = [F.when(unit != "", F.concat(value, unit)), F.when((unit != "") & (short != unit), F.concat(value, short)), *[F.when(unit.endswith("%"), F.concat(value, F.lit(p))) for p in ("%", "％")]]
    return F.array_distinct(F.transform(F.array_compact(F.array(*forms)), normalized))


def bare_match(value: Column, text: Column) -> Column:
    """Whether a text holds a plain number, not inside another number or word."""
    return F.rlike(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?<![A-Za-z0-9.])\s*\Q"), value, F.lit(r"\E\s*(?![A-Za-z0-9.])")))


#: Names of one currency.
CURRENCY_NAMES = (("usd", "美元", "$"), ("hkd", "港元", "港币", "hk$"), ("cny", "人民币", "元"))


def units_equivalent(a: Column, b: Column) -> Column:
    """Whether two units may mean the same: one is empty or holds the other, both are percent signs, or both name one currency."""
    a, b = (strip(F.lower(F.coalesce(c, F.lit("")))) for c in (a, b))
    of = lambda u, names: any_of(u, [n for n in names if len(n) >= 2]) | u.isin(*names)
    same = (a == "") | (b == "") | a.contains(b) | b.contains(a) | (a.isin("%", "％") & b.isin("%", "％"))
    for names in CURRENCY_NAMES:
        same = same | (of(a, names) & of(b, names))
    return same
