"""Readers of staged files; bad records become nulls or are dropped, never a failed job.

A source is a path, or a DataFrame that holds the files as rows already: (file, value) for texts, (path, content) for bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.columns import strip

QUOTE = "struct<usd:double,usd_market_cap:double,usd_24h_vol:double,usd_24h_change:double>"
XBRL = "map<string,struct<units:map<string,array<struct<form:string,start:string,end:string,val:double>>>>>"
RANKING = "struct<data:struct<diff:array<struct<f2:string,f3:string,f5:string,f6:string,f8:string,f12:string,f14:string,f20:string>>>>"


def _whole(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, value): every file as one text."""
    if isinstance(path, DataFrame):
        return path.select("file", "value")
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def _num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def read_search_docs(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, pos, title, url, snippet) from files that hold a JSON array; an unreadable file has no rows."""
    rows = F.from_json("value", "array<struct<title:string,url:string,snippet:string>>")
    return _whole(spark, path).select("file", F.posexplode(rows).alias("pos", "d")).select("file", "pos", "d.*")


def read_structured_frame(spark: SparkSession, path: str | DataFrame, row: str, errors: bool = False) -> DataFrame:
    """Rows of CSV files with a header (a path that ends in .csv, one layout for all its files), or of JSON envelopes.

    Of an envelope the first that is not empty counts: the array data.rows, data.items or data.points, the plain fields of
    data as one row, the array itself. With ``errors`` there is a column error, and a file without rows gives one row of nulls that says so.
    """
    fields = StructType.fromDDL(row.removeprefix("struct<").removesuffix(">"))
    if isinstance(path, str) and path.endswith(".csv"):
        lines = _header_csv(spark, path)
        typed = [(F.col(f.name).try_cast(f.dataType) if f.name in lines.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
        out = lines.select(F.col("_metadata.file_name").alias("file"), *typed)
        return out.withColumn("error", F.lit(None).cast("string")) if errors else out
    inner = F.from_json("value", f"struct<data:struct<rows:array<{row}>,items:array<{row}>,points:array<{row}>>>")
    full = lambda a: F.when(F.size(a) > 0, a)
    files = _whole(spark, path).withColumns({"e": inner, "one": F.from_json("value", f"struct<data:{row}>")["data"]})
    plain = F.coalesce(*[F.col("one").getField(f.name).cast("string") for f in fields]).isNotNull()
    rows = F.coalesce(full(F.col("e.data.rows")), full(F.col("e.data.items")), full(F.col("e.data.points")), F.when(plain, F.array("one")), F.when(F.startswith(F.ltrim("value"), F.lit("[")), full(F.from_json("value", f"array<{row}>"))))
    if not errors:
        return files.select("file", F.explode(rows).alias("r")).select("file", "r.*")
    return files.select("file", F.explode_outer(rows).alias("r")).select("file", "r.*", F.when(F.col("r").isNull(), F.concat("file", F.lit(": no rows"))).alias("error"))


def read_ranking_snapshot(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """The eleven ranking columns from a vendor snapshot; hands and yuan are scaled to ten thousand hands and hundred millions."""
    rows = _whole(spark, path).select("file", F.posexplode(F.from_json("value", RANKING)["data"]["diff"]).alias("pos", "d")).select("file", "pos", "d.*")
    scaled = lambda c, by: F.round(_num(c) / by, 2)
    return rows.select(
        "file", (F.col("pos") + 1).alias("rank"), F.col("f12").alias("code"), F.col("f14").alias("name"), _num("f2").alias("price"), _num("f3").alias("change_pct"), _num("f5").alias("volume_hand"),
        scaled("f5", 1e4).alias("volume_wan_hand"), _num("f6").alias("amount_yuan"), scaled("f6", 1e8).alias("amount_yi"), _num("f8").alias("turnover_pct"), scaled("f20", 1e8).alias("market_cap_yi"),
    )


#: Bytes of a batch of files that are decoded at a time.
PIECE = 1 << 22


def decoded(spark: SparkSession, path: str | DataFrame, charsets: list[str]) -> DataFrame:
    """(file, value): each file's bytes in the first charset that fits; latin-1 always does."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from _pieces(part, charsets)

    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, value string")


def _pieces(part: pd.DataFrame, charsets: list[str]) -> Iterator[pd.DataFrame]:
    """The texts of a batch of files, PIECE bytes at a time, so that they are never all decoded at once."""
    size = part["content"].map(lambda b: 0 if b is None else len(b))
    for _, few in part.groupby((size.cumsum() - size) // PIECE):
        yield pd.DataFrame({"file": few["path"], "value": [None if b is None else _decode(bytes(b), charsets) for b in few["content"]]})


def _decode(data: bytes, charsets: list[str]) -> str:
    for name in charsets:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def files_to_text(spark: SparkSession, path: str | DataFrame, chars: int | None = 30_000) -> DataFrame:
    """Text files of unknown charset; the text is cut at the length the report form allows (None: whole)."""
    text = F.col("value") if chars is None else F.substring("value", 1, chars)
    return decoded(spark, path, ["utf-8-sig", "gb18030"]).select("file", text.alias("text"))


def read_quote_lines(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Quotes from lines v_<code>="a~b~..."; lines with under 39 fields are dropped."""
    lines = decoded(spark, path, ["gbk"]).select(F.explode(F.regexp_extract_all("value", F.lit(r'(v_\w+="[^"]*)'), 1)).alias("line"))
    rows = lines.select(F.regexp_extract("line", r"^v_[a-z]*(\w+)=", 1).alias("code"), F.split(F.regexp_extract("line", r'="(.*)$', 1), "~").alias("f")).where(F.size("f") >= 39)
    at = lambda i: _num(F.get("f", F.lit(i)))
    return rows.select(
        "code", F.get("f", F.lit(1)).alias("name"), at(3).alias("price"), F.coalesce(at(32), at(5)).alias("change_pct"), at(6).alias("volume"),
        F.round(at(37) * 1e4, 2).alias("amount"), at(38).alias("turnover_pct"), at(45).alias("market_cap_yi"),
    )


def read_xbrl_facts(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, tag, year, val): annual filings only; flows span 330 to 390 days; the last in file order wins."""
    tags = _whole(spark, path).select("file", F.explode(F.from_json("value", XBRL)).alias("tag", "fact"))
    rows = tags.select("file", "tag", F.posexplode(F.col("fact.units")["USD"]).alias("pos", "u")).select("file", "tag", "pos", "u.*")
    date = lambda c: F.expr(f"try_to_date(substring({c}, 1, 10), 'yyyy-MM-dd')")
    kept = rows.withColumns({"d0": date("start"), "d1": date("end")}).where(F.col("form").startswith("10-K") & F.col("d1").isNotNull())
    flow = F.coalesce("start", F.lit("")) == ""
    kept = kept.where(flow | F.datediff("d1", "d0").between(330, 390))
    return kept.groupBy("file", "tag", F.year("d1").alias("year")).agg(F.max_by("val", "pos").alias("val"))


def read_coin_quotes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    quotes = _whole(spark, path).select(F.explode(F.from_json("value", f"map<string,{QUOTE}>")).alias("id", "q"))
    return quotes.select("id", F.col("q.usd").alias("price"), F.col("q.usd_market_cap").alias("market_cap"), F.col("q.usd_24h_vol").alias("volume_24h"), F.col("q.usd_24h_change").alias("change_24h"))


def read_macro_csv(spark: SparkSession, path: str, series: str, newest: int = 240) -> DataFrame:
    """(series, date, value): points without a number are dropped; the newest ones of each series stay."""
    rows = spark.read.option("header", True).csv(path).select(F.lit(series).alias("series"), F.trim("DATE").alias("date"), _num(F.trim(series)).alias("value"))
    order = Window.partitionBy("series").orderBy(F.desc("date"))
    return rows.where("date <> '' and value is not null").withColumn("back", F.row_number().over(order)).where(F.col("back") <= newest).drop("back")


ITEM = "array<struct<title:array<string>,link:array<string>,pubDate:array<string>>>"


def read_news_rss(spark: SparkSession, path: str | DataFrame, each: int = 20, errors: bool = False) -> DataFrame:
    """(file, pos, title, link, published) of the items of feeds, parsed as XML: entities, CDATA and attributes are resolved, the first of repeated fields counts, namespaces are ignored.

    Items without title and link are dropped; the first ``each`` of a feed stay. A feed that is no XML gives no rows, or, with
    ``errors``, one row that names it in the column error.
    """
    schema = f"channel struct<item:{ITEM}>, item {ITEM}, _corrupt_record string"
    parsed = _whole(spark, path).select("file", F.from_xml("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"}).alias("feed"))
    field = lambda item, name: strip(F.get(item[name], F.lit(0)))
    items = F.coalesce("feed.channel.item", "feed.item", F.array().cast(ITEM))
    cells = F.transform(items, lambda item, i: F.struct(i.alias("pos"), field(item, "title").alias("title"), field(item, "link").alias("link"), field(item, "pubDate").alias("published")))
    kept = F.slice(F.filter(cells, lambda c: (c["title"] != "") | (c["link"] != "")), 1, each)
    rows = parsed.select("file", F.inline(kept))
    if not errors:
        return rows
    broken = parsed.where("feed is null or feed._corrupt_record is not null").select("file", F.concat("file", F.lit(": no feed")).alias("error"))
    return rows.unionByName(broken, allowMissingColumns=True)


def read_acl_refs(spark: SparkSession, path: str) -> DataFrame:
    """(kb_id, position_id) from a CSV whose position_ids is a list as text; an unreadable list is empty, apostrophes inside ids are kept."""
    ids = F.from_json("position_ids", "array<string>", {"allowSingleQuotes": "true"})
    refs = _header_csv(spark, path).where("trim(kb_id) <> ''")
    return refs.select(F.trim("kb_id").alias("kb_id"), F.explode(F.transform(ids, lambda i: F.trim(i))).alias("position_id"))


def read_acl_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users (user_id, position_id), positions (position_id, position_name) and controlled items (kb_id, position_id) of user.csv, position.csv and kb_position_ref.csv."""
    users = _header_csv(spark, f"{folder}/user.csv").select(F.trim("user_id").alias("user_id"), F.trim("position_id").alias("position_id")).where("user_id <> ''")
    positions = _header_csv(spark, f"{folder}/position.csv").select(F.trim("id").alias("position_id"), F.trim("position_name").alias("position_name"))
    return users, positions, read_acl_refs(spark, f"{folder}/kb_position_ref.csv")


def _header_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_eval_cases(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, id, goal) from JSON files with a list of cases."""
    return _whole(spark, path).select("file", F.inline(F.from_json("value", "struct<cases:array<struct<id:string,goal:string>>>")["cases"]))


#: Vendor fields of the annual columns, in the order (revenue, net_profit, gross_profit, gross_margin, operating_profit, total_assets,
#: total_liabilities, operating_cashflow, basic_eps, roe). Fixed values of the two formats.
STATEMENT_FIELDS = {
    "hk": ("OPERATE_INCOME", "HOLDER_PROFIT", "GROSS_PROFIT", "GROSS_PROFIT_RATIO", "OPERATE_PROFIT", "TOTAL_ASSETS", "TOTAL_LIABILITIES", "NETCASH_OPERATE", "BASIC_EPS", "ROE_AVG"),
    "ashare": ("TOTALOPERATEREVE", "PARENTNETPROFIT", "MLR", "XSMLL", "OPERATE_PROFIT_PK", "TOTAL_ASSETS_PK", "LIABILITY", "NETCASH_OPERATE_PK", "EPSJB", "ROEJQ"),
}
STATEMENT_COLUMNS = ("revenue", "net_profit", "gross_profit", "gross_margin", "operating_profit", "total_assets", "total_liabilities", "operating_cashflow", "basic_eps", "roe")
#: Digits of the columns that are ratios; all others are yuan and become hundred millions.
STATEMENT_RATIOS = {"gross_margin": 2, "basic_eps": 3, "roe": 2}


def read_statement_rows(spark: SparkSession, path: str | DataFrame, vendor: str, newest: int = 12, years: tuple[int, int] | None = None, annual: str = "年报") -> DataFrame:
    """(file, year, report_type, ten figures): annual reports of a vendor's answer, inside the years, the newest of each file."""
    fields = STATEMENT_FIELDS[vendor]
    row = "struct<REPORT_DATE:string,REPORT_TYPE:string," + ",".join(f"{f}:string" for f in fields) + ">"
    rows = _whole(spark, path).select("file", F.posexplode(F.from_json("value", f"struct<result:struct<data:array<{row}>>>")["result"]["data"]).alias("pos", "r")).select("file", "pos", "r.*")
    rows = rows.withColumn("year", F.substring("REPORT_DATE", 1, 4).try_cast("int")).where(F.col("REPORT_TYPE").contains(annual) & F.col("year").isNotNull())
    if years:
        rows = rows.where(F.col("year").between(*years))
    order = Window.partitionBy("file").orderBy(F.desc("REPORT_DATE"), "pos")
    kept = rows.withColumn("back", F.row_number().over(order)).where(F.col("back") <= newest)
    figures = [F.round(_num(f) / (1 if c in STATEMENT_RATIOS else 1e8), STATEMENT_RATIOS.get(c, 2)).alias(c) for c, f in zip(STATEMENT_COLUMNS, fields, strict=True)]
    return kept.select("file", "year", F.col("REPORT_TYPE").alias("report_type"), *figures)


def read_golden(spark: SparkSession, path: str | DataFrame, metrics: list[str]) -> DataFrame:
    """(file, id, question, answer, metrics...) from JSON lists of judged answers; an absent score is 0."""
    scores = "struct<" + ",".join(f"{m}:double" for m in metrics) + ">"
    rows = F.from_json("value", f"array<struct<id:string,question:string,answer:string,human_scores:{scores}>>")
    flat = _whole(spark, path).select("file", F.inline(rows))
    return flat.select("file", "id", "question", "answer", *[F.coalesce(F.col("human_scores")[m], F.lit(0.0)).alias(m) for m in metrics])


def fresh_files(files: DataFrame, since: Column, deny: str = r"(^|/)(__pycache__|screenshots)/|_check_|/\.test_") -> DataFrame:
    """Rows of files changed since a time, 60 seconds of grace included, outside the denied paths.

    files: any file scan; the conditions on ``_metadata`` prune whole files before they are read.
    """
    changed = F.col("_metadata.file_modification_time") >= since - F.expr("interval 60 seconds")
    return files.where(changed & ~F.col("_metadata.file_path").rlike(deny))
