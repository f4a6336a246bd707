"""Pages against html.parser, feeds, tables and the choice of pages."""

from html.parser import HTMLParser

import duckdb
from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.operators import reports as S
from tessera.operators.pages import HIDDEN, html_text
from tessera.plans import registry
from tessera.sources import readers as R

PAGES = [
    "a < b > c", "x<!-- c <b> -->y", "<p title='a>b'>t</p>", "<script>if (a<b) </scr x</script >z", "<script>open", "a<!-- open <b>c", "<p>&amp;&lt;&#65;&#x42;&nbsp;&copy &bogus; z</p>",
    "<nav><nav>a</nav>b</nav>c", "</nav>a<nav>b", "<nav/>x", "<br/>y<P>z", "a<b c", "<!DOCTYPE html><p>x", "<?php a>b", "<style>a</STYLE>b", "<svg/>q</svg>r", "a<3 b", "<iframe>a<b>c</iframe>d",
    "<noscript>x<nav></noscript>y</nav>z", "<![CDATA[x]]>y", "<!>a", "<!-->a-->b", "<p\n class='x'\n>t", "</>a", "</ p>b", "<p>&#0;&#xD800;&#99999999;x</p>", "  a \n\n b <b> </b>c", "<script/>x",
    "<SCRIPT src='a>b'>q</SCRIPT>t", "<a href=x\"y class=z>t<b title=\"q>r\">u</b>", "", None, "<p a=1 b = 'c>d' e>f", "<b>&#x1F600;&Eacute;&eacute;</b>", "<p " + "a='b' " * 5000 + ">t", "<p>" + "x " * 20_000 + "</p>",
]


class Shown(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in HIDDEN

    def handle_endtag(self, tag):
        self.depth -= bool(tag in HIDDEN and self.depth)

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.found.append(data.strip())


def test_pages_as_the_parser_sees_them(spark):
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")).collect()}
    for i, page in enumerate(PAGES):
        parser = Shown()
        parser.feed(page or "")
        assert got[i] == "\n".join(line for line in "\n".join(parser.found).splitlines() if line.strip())[:30_000], page[:80]


def test_names_without_semicolon(spark):
    pages = ["<title>a&amp</title>b&amp", "<p>x&ampy &copyz; &copysr; &notit; &notin; &amp_ &ampé", "&quot&quot&middot &amp;copy; &AMPx &bogusamp &ampamp;"]
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()}
    for i, page in enumerate(pages):
        parser = Shown()
        parser.feed(page)
        parser.close()
        assert got[i] == "\n".join(parser.found), page


def test_cut_names_in_the_twin(spark, tmp_path):
    rows = [(1, "<title>one&amp</title><p>and&amp</p><p>x&ampy &copyz</p>"), (2, "<p>&quot&quot;z&middot</p>&amp;copy; &amp")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["html_to_text"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(f"select page_id, title, text from ({registry.ORACLES['html_to_text']})").fetchall())
    assert got[0][2] == "one&\nand&\nx&y ©z"


def test_feeds(spark):
    feeds = {
        "a": "<rss><channel><title>feed</title><item><title type='html'>A &amp; B &#233;</title><link>http://a</link><pubDate> Mon </pubDate></item><item><title><![CDATA[x <b>y</b>]]></title><link/></item><item><title/></item></channel></rss>",
        "b": "<rss><channel><item><title>one</title><title>two</title><media:title xmlns:media='m'>no</media:title><source url='q'><title>inner</title></source></item></channel></rss>",
        "c": "<rss><channel><item><title>open</item>", "d": "not xml", "e": "", "f": "<?xml version='1.0'?><!DOCTYPE rss><rss><channel></channel></rss>",
        "g": "<rdf:RDF xmlns:rdf='r'><channel/><item><title>rdf</title></item></rdf:RDF>", "h": "<rss><channel>" + "<item><title>t</title></item>" * 30 + "</channel></rss>",
    }
    df = spark.createDataFrame(list(feeds.items()), "file string, value string")
    rows = R.read_news_rss(spark, df, errors=True).collect()
    got = {f: [(r.pos, r.title, r.link, r.published) for r in rows if r.file == f and r.error is None] for f in feeds}
    assert got["a"] == [(0, "A & B é", "http://a", "Mon"), (1, "x <b>y</b>", "", "")]
    assert [r[1] for r in got["b"]][0].startswith("one") and len(got["b"]) == 1
    assert got["f"] == [] and [r[1] for r in got["g"]] == ["rdf"] and len(got["h"]) == 20
    assert sorted(r.file for r in rows if r.error) == ["c", "d", "e"]


def test_table_facts(spark):
    table = "| 公司 | 市场规模（亿美元） | 占比 | 备注 | 链接 |\n|---|---|---|---|---|\n| 甲 | 1,200 | 12.5% | 2023年口径 | [x](http://a.example/1) |\n| 乙 | 数千 | 3% | | |\n| 丙 | 30万亿美元 | 无 | — | 见报 |\n|---|\n| 丁 |"
    none = "| 时间 | 事件 |\n|---|---|\n| 2020 | 上市 |"
    plain = "| 指标 | 数值 |\n|---|---|\n| — | 5亿元 |\n| 增速 | 8% |"
    rows = S.md_table_facts(spark.createDataFrame([(1, f"x\n{table}\n\n{none}\n\n{plain}"), (2, None), (3, "| a | b |")], "doc_id long, text string")).collect()
    assert sorted((r.block, r.n, r.metric, r.year, r.value, r.unit, r.caliber, r.source) for r in rows) == [
        (0, 0, "市场份额", 2023, 12.5, "%", "甲", "http://a.example/1"), (0, 0, "市场规模", 2023, 1200.0, "亿美元", "2023年口径", "http://a.example/1"),
        (0, 2, "市场规模", None, 30.0, "万亿美元", "—", "见报"), (2, 1, "增速", None, 8.0, "%", "表格", ""),
    ]


def test_choice_of_pages(spark):
    rows = [
        (1, 0, "腾讯年报", "http://x.com/a", "腾讯"), (1, 1, "腾讯年报", "http://www.hkex.com.hk/b", "腾讯"), (1, 2, "Line 财报", "http://ir.line.com", "腾讯"), (1, 3, "腾讯年报", "ftp://hkex", "腾讯"),
        (2, 0, "官宣与腾讯合作，Line 用户流失", "http://sina.com.cn/1", "腾讯"), (2, 1, "Lululemon 新闻稿", "http://sina.com.cn/2", "腾讯"), (3, 0, None, "https://blog.csdn.net/x", None), (3, 1, "t", None, None),
    ]
    df = spark.createDataFrame(rows, "k long, pos long, title string, url string, target string")
    got = {r.k: (r.url, r.score) for r in A.pick_url(df, "k", ("Line", "Lululemon")).collect()}
    assert got == {1: ("http://www.hkex.com.hk/b", 2 + 4 + 5), 2: ("http://sina.com.cn/1", 2 + 3 - 6), 3: ("https://blog.csdn.net/x", -4)}
    assert A.pick_url(df.where(F.lit(False)), "k").count() == 0
