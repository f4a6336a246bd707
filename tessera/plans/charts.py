"""Market, financial, chart and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import panels as N
from tessera.plans.binding import Plans

P = Plans()
def money():
    return F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount")).cast("decimal(10,4)")


QUOTES = "WITH quotes AS (SELECT n_name AS market, l_partkey AS code, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(10,4))) AS DOUBLE) AS amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)"


def quotes(r):
    market = r("supplier").join(r("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("market"))
    rows = r("lineitem").join(market, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("market", F.col("l_partkey").alias("code")).agg(F.sum(money()).cast("double").alias("amount"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"))


def statements(r):
    """(entity, year, metric, value) by nation of the customer."""
    who = r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("entity"))
    orders = r("orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select("entity", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    rows = orders.groupBy("entity", "year").agg(F.sum("p").cast("double").alias("revenue"), F.count("*").cast("double").alias("orders"))
    return rows.unpivot(["entity", "year"], ["revenue", "orders"], "metric", "value")


YEARS = "WITH y AS (SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, CAST(count(*) AS DOUBLE) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"


def part_rows(r):
    return r("part").select(F.col("p_name").alias("label"), F.col("p_type").alias("series"), F.col("p_brand").alias("unit"), F.col("p_retailprice").alias("value"), (F.col("p_size") % 20 + 2000).alias("year"))


PART = "WITH rows AS (SELECT p_name AS label, p_type AS series, p_brand AS unit, p_retailprice AS value, p_size % 20 + 2000 AS year FROM part)"

P.add("rank_topn", lambda r: N.rank_topn(quotes(r), "market", "amount", "code", 10), f"{QUOTES} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY market ORDER BY amount DESC, code) AS INTEGER) AS rank FROM quotes) WHERE rank <= 10")
P.add("price_volume_pairs", lambda r: N.price_volume_pairs(quotes(r).select(F.concat_ws("-", "market", "code").alias("name"), (F.col("amount") / F.col("volume")).alias("price"), "amount").unpivot("name", ["price", "amount"], "metric", "value")), f"{QUOTES} SELECT market || '-' || code AS name, amount / volume AS price, amount FROM quotes WHERE amount IS NOT NULL")
P.add("yoy_growth", lambda r: N.yoy_growth(statements(r).where("metric = 'revenue'").drop("metric"), "entity", "value"), f"{YEARS} SELECT entity, year, revenue AS value, round((revenue / lag(revenue) OVER (PARTITION BY entity ORDER BY year) - 1) * 100, 4) AS growth_pct FROM y")
P.add("latest_per_year", lambda r: r("orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("s")).select("o_custkey", "year", F.col("s.o_totalprice").alias("last_price")), "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS last_price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
P.add("merge_structured_rows", lambda r: (lambda w: N.melt_missing(w, ["entity", "year"], ["revenue", "orders"], w.where("year % 2 = 0").select("entity", "year", F.lit("orders").alias("label"), F.col("orders").alias("value"))))(N.pivot_panel(statements(r), ["entity", "year"], ["revenue", "orders"])), f"{YEARS} SELECT entity, year, 'orders' AS label, orders AS value FROM y UNION ALL SELECT entity, year, 'revenue', revenue FROM y")
P.add("merge_year_series", lambda r: N.merge_year_series(statements(r).select(F.col("entity").alias("unit"), "metric", "year", "value")), f"{YEARS}, l AS (SELECT entity AS unit, 'revenue' AS metric, year, revenue AS value FROM y UNION ALL SELECT entity, 'orders', year, orders FROM y) SELECT * FROM l QUALIFY count(*) OVER (PARTITION BY unit, metric) >= 2")
P.add("metric_year_panel", lambda r: N.metric_year_panel(statements(r).withColumn("metric", F.concat_ws("/", "entity", "metric"))), f"{YEARS}, l AS (SELECT entity || '/revenue' AS metric, year FROM y UNION ALL SELECT entity || '/orders', year FROM y) SELECT metric, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year FROM l GROUP BY metric HAVING count(DISTINCT year) >= 3")
P.add("specs_from_rows", lambda r: N.specs_from_rows(part_rows(r)), f"{PART} SELECT series, unit, count(*) AS rows, min(value) AS low, max(value) AS high, arg_max(label, struct_pack(v := value, l := label)) AS top_label, min(year) AS first_year, max(year) AS last_year FROM rows GROUP BY series, unit HAVING count(*) >= 2")
P.add("chart_type", lambda r: N.chart_type(part_rows(r), ["unit", "series"]), f"{PART} SELECT unit, series, count(*) AS rows, CASE WHEN count(year) = count(*) AND count(DISTINCT year) >= 2 THEN 'line' WHEN count(*) > 10 THEN 'hbar' ELSE 'bar' END AS type FROM rows GROUP BY unit, series")
P.add("pie_guard", lambda r: N.pie_guard(r("part").withColumn("half", F.col("p_size") <= 25).groupBy("p_brand", "half").agg(F.count("*").alias("n")).join(r("part").groupBy("p_brand").agg(F.count("*").alias("t")), "p_brand").select(F.col("p_brand").alias("group"), (F.col("n") * 100 / F.col("t")).alias("share"))), "WITH s AS (SELECT p_brand AS \"group\", count(*) AS slices FROM (SELECT DISTINCT p_brand, p_size <= 25 FROM part) GROUP BY 1) SELECT \"group\", 100.0::DOUBLE AS total, slices, slices <= 5 AS ok FROM s")
P.add("largest_unit_group", lambda r: N.largest_unit_group(part_rows(r)), f"{PART} SELECT unit, label, series, value, year FROM rows WHERE unit = (SELECT unit FROM rows GROUP BY unit HAVING count(*) >= 2 ORDER BY count(*) DESC, unit LIMIT 1)")
P.add("profile_table", lambda r: N.profile_table(r("lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, {n} AS is_numeric, count(*) AS rows FROM lineitem" for c, n in (("l_orderkey", "true"), ("l_quantity", "true"), ("l_returnflag", "false"), ("l_shipdate", "false"))))
P.add("load_dataset_profile", lambda r: (lambda d: d.agg(F.count("*").alias("rows"), F.lit(len(d.columns)).alias("columns")))(r("lineitem")), "SELECT count(*) AS rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS columns FROM lineitem")
P.add("corr_matrix", lambda r: N.corr_pairs(r("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))))
P.add("top_feature", lambda r: N.corr_pairs(r("lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]).where("a = 'l_extendedprice'").agg(F.max_by("b", F.abs("corr")).alias("feature"), F.max(F.abs("corr")).alias("corr")), "WITH c AS (" + " UNION ALL ".join(f"SELECT '{b}' AS feature, round(abs(corr(l_extendedprice, {b})), 6) AS corr FROM lineitem" for b in ("l_quantity", "l_discount", "l_tax")) + ") SELECT feature, corr FROM c ORDER BY corr DESC LIMIT 1")
P.add("margin_ratio", lambda r: r("lineitem").groupBy("l_returnflag").agg(F.round(F.sum(money()).cast("double") / F.nullif(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double"), F.lit(0.0)) * 100, 4).alias("margin_pct")), "SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(10,4))) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) * 100, 4) AS margin_pct FROM lineitem GROUP BY 1")
P.add("scale_round", lambda r: r("lineitem").select("l_orderkey", "l_linenumber", N.as_number(F.col("l_extendedprice").cast("string"), 7.0).alias("scaled")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 7.0, 2) AS scaled FROM lineitem")

QUERIES, ORACLES = P.queries, P.oracles
