"""Reader queries: the rows of a table are staged in a vendor's form, read back, and compared with the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.io import shared_folder
from tessera.plans.binding import Plans, Reader
from tessera.sources import readers as R

P = Plans()


def staged(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """(file, value): one staged text for each row."""
    return rows.select(key.cast("string").alias("file"), value.alias("value"))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def search_docs(r: Reader) -> DataFrame:
    doc = lambda title, url, snippet: F.struct(F.col(title).alias("title"), text(url, F.col("o_orderkey")).alias("url"), F.col(snippet).alias("snippet"))
    both = F.to_json(F.array(doc("o_orderpriority", "https://a.example/", "o_orderstatus"), doc("o_orderstatus", "https://b.example/", "o_orderpriority")))
    value = F.when(F.col("o_orderkey") % 10 == 0, "not json").otherwise(both)
    return R.read_search_docs(r("orders").sparkSession, staged(r("orders"), F.col("o_orderkey"), value))


P.add("read_search_docs", search_docs, """SELECT CAST(o_orderkey AS VARCHAR) AS file, 0 AS pos, o_orderpriority AS title, 'https://a.example/' || o_orderkey AS url, o_orderstatus AS snippet FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, o_orderstatus, 'https://b.example/' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0""")


def structured(r: Reader) -> DataFrame:
    rows = F.to_json(F.array(F.struct(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("q"))))
    form = F.col("l_linenumber") % 4
    value = F.when(form == 0, text('{"data":{"rows":', rows, "}}")).when(form == 1, text('{"data":{"rows":[],"items":', rows, "}}")).when(form == 2, text('{"data":{"points":', rows, "}}")).otherwise(rows)
    return R.read_structured_frame(r("lineitem").sparkSession, staged(r("lineitem"), text(F.col("l_orderkey"), "-", F.col("l_linenumber")), value), "struct<k:bigint,q:double>")


P.add("read_structured_frame", structured, "SELECT l_orderkey || '-' || l_linenumber AS file, l_partkey AS k, l_quantity AS q FROM lineitem")


def ranking(r: Reader) -> DataFrame:
    size = F.col("p_size").cast("long")
    row = F.struct(F.col("p_retailprice").alias("f2"), F.lit("-").alias("f3"), (size * 100).alias("f5"), (size * 1_000_000).alias("f6"), F.col("p_partkey").alias("f12"), F.col("p_name").alias("f14"), (size * 2_000_000).alias("f20"))
    return R.read_ranking_snapshot(r("part").sparkSession, staged(r("part"), F.col("p_partkey"), text('{"data":{"diff":', F.to_json(F.array(row)), "}}")))


P.add("read_ranking_snapshot", ranking, """SELECT CAST(p_partkey AS VARCHAR) AS file, 1 AS rank, CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_retailprice AS price, CAST(NULL AS DOUBLE) AS change_pct, p_size * 100.0::DOUBLE AS volume_hand,
p_size / 100::DOUBLE AS volume_wan_hand, p_size * 1e6::DOUBLE AS amount_yuan, p_size / 100::DOUBLE AS amount_yi, CAST(NULL AS DOUBLE) AS turnover_pct, p_size / 50::DOUBLE AS market_cap_yi FROM part""")


def quotes(r: Reader) -> DataFrame:
    at = {1: F.col("p_name"), 3: F.col("p_retailprice"), 5: F.lit("9.5"), 6: F.col("p_size"), 32: F.when(F.col("p_size") % 2 == 0, "1.25").otherwise(""), 37: F.col("p_size"), 38: F.lit("0.5"), 45: F.col("p_size") * 2}
    fields = F.array(*[at.get(i, F.lit("0")).cast("string") for i in range(46)])
    kept = F.when(F.col("p_size") % 10 == 0, F.slice(fields, 1, 30)).otherwise(fields)
    line = text("v_sh", F.lpad(F.col("p_partkey").cast("string"), 8, "0"), '="', F.array_join(kept, "~"), '";\n')
    return R.read_quote_lines(r("part").sparkSession, r("part").select(F.col("p_partkey").cast("string").alias("path"), F.encode(line, "UTF-8").alias("content")))


P.add("read_quote_lines", quotes, """SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, p_name AS name, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN 1.25::DOUBLE ELSE 9.5::DOUBLE END AS change_pct, CAST(p_size AS DOUBLE) AS volume,
p_size * 1e4::DOUBLE AS amount, 0.5::DOUBLE AS turnover_pct, p_size * 2::DOUBLE AS market_cap_yi FROM part WHERE p_size % 10 <> 0""")


def statement_rows(r: Reader) -> DataFrame:
    """Every order as a vendor's answer: this year's annual report, last year's, and a quarter."""
    def answer(names: tuple[str, ...]) -> Column:
        figures = [(F.lit("12.5") if c in R.STATEMENT_RATIOS else F.col("o_custkey") * 1_000_000).cast("string").alias(n) for c, n in zip(R.STATEMENT_COLUMNS, names, strict=True)]
        report = lambda years, kind: F.struct((F.year("o_orderdate") - years).cast("string").alias("REPORT_DATE"), F.lit(kind).alias("REPORT_TYPE"), *figures)
        return text('{"result":{"data":', F.to_json(F.array(report(0, "年报"), report(1, "年报"), report(0, "一季报"))), "}}")

    orders, parts = r("orders"), []
    for vendor, names in R.STATEMENT_FIELDS.items():
        own = F.col("o_orderkey") % 2 == (1 if vendor == "hk" else 0)
        parts.append(R.read_statement_rows(orders.sparkSession, staged(orders.where(own), F.col("o_orderkey"), answer(names)), vendor, newest=1))
    return parts[0].unionByName(parts[1])


P.add("read_statement_rows", statement_rows, f"""SELECT CAST(o_orderkey AS VARCHAR) AS file, CAST(year(o_orderdate) AS INTEGER) AS year, '年报' AS report_type,
{", ".join(("12.5::DOUBLE" if c in R.STATEMENT_RATIOS else "o_custkey / 100::DOUBLE") + f" AS {c}" for c in R.STATEMENT_COLUMNS)} FROM orders""")


def xbrl(r: Reader) -> DataFrame:
    entry = lambda form, start, end, value: F.struct(F.lit(form).alias("form"), (F.lit(start) if start else F.lit(None).cast("string")).alias("start"), F.lit(end).alias("end"), value.cast("double").alias("val"))
    price = F.col("o_totalprice")
    tag = lambda *entries: F.struct(F.create_map(F.lit("USD"), F.array(*entries)).alias("units"))
    flows = tag(entry("10-K", "2023-01-01", "2023-12-31", price), entry("10-K/A", "2023-01-01", "2023-12-31", price + 1), entry("10-K", "2023-10-01", "2023-12-31", price + 2), entry("10-Q", "2024-01-01", "2024-12-31", price))
    stocks = tag(entry("10-K", None, "2024-06-30", price * 2))
    return R.read_xbrl_facts(r("orders").sparkSession, staged(r("orders"), F.col("o_orderkey"), F.to_json(F.create_map(F.lit("Revenues"), flows, F.lit("Assets"), stocks))))


P.add("read_xbrl_facts", xbrl, """SELECT CAST(o_orderkey AS VARCHAR) AS file, 'Revenues' AS tag, 2023 AS year, o_totalprice + 1 AS val FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Assets', 2024, o_totalprice * 2 FROM orders""")


def coins(r: Reader) -> DataFrame:
    quote = F.create_map(text("coin-", F.col("p_partkey")), F.struct(F.col("p_retailprice").alias("usd"), F.col("p_size").cast("double").alias("usd_market_cap")))
    return R.read_coin_quotes(r("part").sparkSession, staged(r("part"), F.col("p_partkey"), F.to_json(quote)))


P.add("read_coin_quotes", coins, "SELECT 'coin-' || p_partkey AS id, p_retailprice AS price, CAST(p_size AS DOUBLE) AS market_cap, CAST(NULL AS DOUBLE) AS volume_24h, CAST(NULL AS DOUBLE) AS change_24h FROM part")


def macro(r: Reader) -> DataFrame:
    """Daily views written as a CSV series, with '.' on days of few views."""
    days = r("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("DATE")).agg(F.count_if(F.col("event_type") == "view").alias("n"))
    path = shared_folder(days.sparkSession)
    days.select("DATE", F.when(F.col("n") < 3, ".").otherwise(F.col("n").cast("string")).alias("VIEWS")).write.option("header", True).csv(path)
    return R.read_macro_csv(days.sparkSession, path, "VIEWS")


P.add("read_macro_csv", macro, """SELECT 'VIEWS' AS series, strftime(ts, '%Y-%m-%d') AS date, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS value FROM events GROUP BY 2
HAVING count(*) FILTER (event_type = 'view') >= 3 ORDER BY date DESC LIMIT 240""")


def rss(r: Reader) -> DataFrame:
    feed = text("<rss><channel><item><title>page ", F.col("page_id"), "</title><link>", F.replace("url", F.lit("&"), F.lit("&amp;")), "</link><pubDate>Mon</pubDate></item><item><title></title><link></link></item></channel></rss>")
    return R.read_news_rss(r("pages").sparkSession, staged(r("pages"), F.col("page_id"), feed))


P.add("read_news_rss", rss, "SELECT CAST(page_id AS VARCHAR) AS file, 0 AS pos, 'page ' || page_id AS title, trim(url) AS link, 'Mon' AS published FROM pages")


def acl_tables(r: Reader) -> DataFrame:
    """Suppliers as restricted bases, written and read as CSV; a list that cannot be read is empty."""
    path = shared_folder(r("supplier").sparkSession)
    ids = F.when(F.col("s_suppkey") % 5 == 0, "broken").otherwise(text("['", F.col("s_nationkey"), "', 'all']"))
    r("supplier").select(F.col("s_name").alias("kb_id"), ids.alias("position_ids")).write.option("header", True).csv(path)
    return R.read_acl_refs(r("supplier").sparkSession, path)


P.add("read_acl_tables", acl_tables, "SELECT s_name AS kb_id, unnest([CAST(s_nationkey AS VARCHAR), 'all']) AS position_id FROM supplier WHERE s_suppkey % 5 <> 0")


def texts_of_files(r: Reader) -> DataFrame:
    """Whole documents as bytes, every other one with a byte order mark."""
    content = F.when(F.col("doc_id") % 2 == 0, text("\ufeff", F.col("text"))).otherwise(F.col("text"))
    files = r("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(content, "UTF-8").alias("content"))
    return R.files_to_text(files.sparkSession, files, None).select("file", F.md5("text").alias("digest"))


P.add("files_to_text", texts_of_files, "SELECT CAST(doc_id AS VARCHAR) AS file, md5(text) AS digest FROM documents")


def eval_cases(r: Reader) -> DataFrame:
    cases = F.to_json(F.struct(F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("goal"))).alias("cases")))
    return R.read_eval_cases(r("benchmark").sparkSession, staged(r("benchmark"), F.col("item_id"), cases))


P.add("read_eval_cases", eval_cases, "SELECT CAST(item_id AS VARCHAR) AS file, CAST(item_id AS VARCHAR) AS id, text AS goal FROM benchmark")


def golden(r: Reader) -> DataFrame:
    row = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), F.struct(F.col("quality").cast("double").alias("faithfulness")).alias("human_scores"))
    return R.read_golden(r("labels").sparkSession, staged(r("labels"), F.col("doc_id"), F.to_json(F.array(row))), ["faithfulness", "recall"])


P.add("read_golden", golden, "SELECT CAST(doc_id AS VARCHAR) AS file, CAST(doc_id AS VARCHAR) AS id, 'q' AS question, 'a' AS answer, coalesce(CAST(quality AS DOUBLE), 0) AS faithfulness, 0::DOUBLE AS recall FROM labels")


def fresh(r: Reader) -> DataFrame:
    """Orders written by status a moment ago, less a folder of screenshots."""
    orders = r("orders")
    path = shared_folder(orders.sparkSession)
    orders.where("o_orderstatus <> 'P'").write.parquet(f"{path}/out")
    orders.where("o_orderstatus = 'P'").write.parquet(f"{path}/screenshots")
    files = orders.sparkSession.read.schema(orders.schema).option("recursiveFileLookup", True).parquet(path)
    return R.fresh_files(files, F.current_timestamp() - F.expr("interval 30 minutes")).select("o_orderkey", "o_orderstatus")


P.add("fresh_files", fresh, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")

QUERIES, ORACLES = P.queries, P.oracles
