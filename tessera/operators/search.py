"""Results of a search: what is dropped whatever was asked, and the score of the rest by the words of the goal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import bind, strip
from tessera.operators.texts import HAN, token_weight

# Hosts, paths, titles and words of results that are dropped.
SPAM_HOSTS = ("susmeat.com", "aydvjch.cc", "example.com", "imty-web.com", "zhxsg.com", "mmzx2.cn", "ng28gaming.com", "online-28quan.com", "28quan.com", "365qp", "88qp", "h888", "ky777", "lywl")
LOW_HOSTS = ("wenku.baidu.com", "book118.com", "max.book118.com", "doc88.com", "docin.com", "jz.docin.com", "mbd.baidu.com", "wenku.so.com")
JUNK_PATHS = r"/works/\d+\.html|/tiyu-toutiao/|/login|/register|/agent"
JUNK_TITLES = ("google", "bing", "microsoft", "登录", "403", "404")
GAMBLING = (
    "博彩", "六合彩", "彩票", "投注", "下注", "返水", "棋牌", "电玩", "真人视讯", "娱乐城", "时时彩", "开户送", "注册送", "秒到账", "提现", "抢庄", "龙虎", "牛牛", "百家乐", "老虎机", "赌场",
    "casino", "lottery", "bet365", "betting", "gambling",
)
EMPTY_PAGES = ("404 not found", "page not found", "无法访问该页面", "页面不存在", "您访问的页面不存在")


def _holds(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words], F.lit(False))


def clean_goal(text: Column) -> Column:
    """The user's goal inside a wrapped instruction, else the instruction without its first label and without what follows a role block."""
    text = F.coalesce(text, F.lit(""))
    named = F.regexp_extract(text, "用户目标：([^\n]+)", 1)
    bare = F.regexp_replace(strip(text), r"^(任务目标|原始指令|用户目标)[：:]\s*", "")
    return F.when(named != "", strip(named)).otherwise(strip(F.regexp_replace(bare, "(?s)(?<=.)\n【角色】.*$", "")))


def asked_tokens(goal: Column) -> Column:
    """Distinct tokens of a goal: windows of 2 to 4 Han characters, runs of four digits, words of ASCII letters, digits and hyphens from three characters on."""
    found = lambda pattern, group=0: F.regexp_extract_all(F.lower(goal), F.lit(pattern), F.lit(group))
    grams = [found(f"(?=([{HAN}]{{{n}}}))", 1) for n in (2, 3, 4)]
    return F.array_distinct(F.concat(*grams, found("[0-9]{4}"), found("[a-z][a-z0-9-]{2,}")))


def sound_results(results: DataFrame, blocks: tuple[str, ...] = ()) -> DataFrame:
    """Results (title, url, snippet) with a title and a web address that are neither spam, documents of low standing, gambling, empty pages nor blocked."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))

    def sound(v: Column) -> Column:
        said, named = F.concat(v["title"], F.lit(" "), v["snippet"]), F.concat(v["url"], F.lit(" "), v["title"])
        bad = _holds(v["url"], SPAM_HOSTS + LOW_HOSTS) | v["url"].rlike(JUNK_PATHS) | strip(v["title"]).isin(*JUNK_TITLES) | _holds(named, blocks)
        return (v["title"] != "") & ~bad & bind(said, lambda text: ~_holds(text, GAMBLING + EMPTY_PAGES))

    return results.where(F.startswith("url", F.lit("http")) & bind(F.struct(*[low(c).alias(c) for c in ("title", "url", "snippet")]), sound))


def filter_results(results: DataFrame, goals: DataFrame, key: str, boosts: tuple[str, ...] = (), blocks: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """(key, doc_id, score, rank) of the results (key, doc_id, title, url, snippet) of each goal (key, goal) with at least so high a score, the best first.

    Pairs of Han characters and years that a result holds count 1, longer windows and whole words 2, a preferred word in its address or
    title 3. Each result is held against its own goal only.
    """
    title, snippet = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    said = F.lower(F.concat(title, F.lit(" "), snippet))
    preferred = F.when(_holds(F.lower(F.concat("url", F.lit(" "), title)), boosts), 3).otherwise(0)
    rows = sound_results(results, blocks).select(key, "doc_id", said.alias("said"), preferred.alias("preferred")).join(goals.select(key, asked_tokens(clean_goal(F.col("goal"))).alias("tokens")), key)
    plain = F.filter("tokens", lambda t: t.rlike("^[a-z][a-z0-9]*$"))  # whole words without hyphens are runs of the text
    rest = F.filter("tokens", lambda t: ~t.rlike("^[a-z][a-z0-9]*$"))
    held = lambda text, t: F.when(t.rlike("^[a-z]"), F.rlike(text, F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])")))).otherwise(True)

    def hits(text: Column) -> Column:
        words = F.array_intersect(plain, F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))
        return F.concat(words, F.filter(rest, lambda t: text.contains(t) & held(text, t)))

    score = F.aggregate(F.transform(bind(F.col("said"), hits), token_weight), F.lit(0), lambda a, b: a + b) + F.col("preferred")
    scored = F.filter(F.array(F.struct(score.alias("score"))), lambda s: s["score"] >= least)  # worked out once for filter and result
    order = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return rows.select(key, "doc_id", F.inline(scored)).withColumn("rank", F.row_number().over(order))
