"""Visible text of web pages by a tokenizer of tags, as column expressions and windows.

A page is cut into tokens (comments, scripts and styles with their content, declarations, tags whose quoted attributes may hold ">",
texts) by one pattern; each opening or closing of an element whose content is not shown moves a depth, which never falls below
zero, and texts at depth zero stay. References to characters are resolved behind that. What an unfinished tag or comment begins is dropped to the end
of the page. A page's tokens meet in one window.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements whose content is not shown.
HIDDEN = ("script", "style", "noscript", "iframe", "svg", "nav", "footer")
_INSIDE = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|=(?!\s*+[\"'])|[^=>])*+"
TOKEN = (
    rf"(?is)(<!--.*?-->|<(script|style)(?=[\s/>]){_INSIDE}(?<!/)>.*?</\2\s*+>|<(?:script|style)(?=[\s/>]){_INSIDE}(?<!/)>.*|"
    rf"<!\[.*?\]>|<!(?!--)[^>]*+>|<\?[^>]*+>|</[^>]*+>|<[a-z]{_INSIDE}>|<[a-z!?/].*|[^<]++|<)"
)


def unescaped(text: Column) -> Column:
    """A text with its references to characters resolved: numbers, names that end in a semicolon, and the older names without one, also before further letters (the longest that fits); others stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z0-9]+;?|&|[^&]+)"), F.lit(1))
    names = F.create_map(*[F.lit(x) for name, value in html.entities.html5.items() for x in (f"&{name}", value)])
    older = f"^&(?:{'|'.join(sorted((n for n in html.entities.html5 if not n.endswith(';')), key=len, reverse=True))})"

    def led(p: Column) -> Column:
        lead = F.regexp_extract(p, older, 0)
        return F.when(lead != "", F.concat(F.try_element_at(names, lead), F.substr(p, F.char_length(lead) + 1))).otherwise(p)

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#[xX]?([0-9a-fA-F]+)", 1)
        number = F.conv(digits, 16, 10).try_cast("long")
        number = F.when(p.rlike("^&#[xX]"), number).otherwise(digits.try_cast("long"))
        sound = number.isNotNull() & (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF) & (F.char_length(digits) <= 8)
        code = F.when(sound, number).otherwise(0xFFFD)
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~F.startswith(p, F.lit("&")), p).when(F.startswith(p, F.lit("&#")), letter).otherwise(F.coalesce(F.try_element_at(names, p), led(p)))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def html_text(pages: DataFrame, key: str = "page_id", chars: int = 30_000) -> DataFrame:
    """(key, title, text): the first title as it stands, and the shown texts, one a line, up to so many characters; a null page is empty."""
    blank = r"^[\s\x{a0}]+|[\s\x{a0}]+$"
    page = F.coalesce("html", F.lit(""))
    rows = pages.select(key, F.monotonically_increasing_id().alias("row_"), F.regexp_replace(F.regexp_extract(page, r"(?i)<title[^>]*>([^<]+)</title>", 1), blank, "").alias("title"), page.alias("html"))
    tokens = rows.select("row_", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(1))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][^\s/>]*)", 1))
    whole = F.col("token").rlike(r"(?is)^<(script|style)\b.*(</(script|style)\s*>|[^>])$") | F.endswith("token", F.lit("/>"))
    move = F.when(~tag.isin(*HIDDEN) | whole, 0).when(F.startswith("token", F.lit("</")), -1).otherwise(1)
    steps = tokens.select("row_", "pos", move.alias("move"), F.when(~F.startswith("token", F.lit("<")) | (F.col("token") == "<"), F.col("token")).alias("shown"))
    before = Window.partitionBy("row_").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("sum", F.sum("move").over(before))
    depth = F.col("sum") - F.least(F.min("sum").over(before), F.lit(0))
    shown = summed.withColumn("depth", depth).where("depth = 0 and shown is not null")
    clean = F.filter(F.transform(F.split(unescaped(F.col("shown")), r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), lambda s: s), lambda s: F.regexp_replace(s, blank, "") != "")
    text = F.regexp_replace(F.array_join(clean, "\n"), blank, "")
    lines = shown.select("row_", "pos", text.alias("text")).where("text <> ''")
    whole_text = lines.groupBy("row_").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return rows.drop("html").join(whole_text, "row_", "left").select(key, "title", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))
