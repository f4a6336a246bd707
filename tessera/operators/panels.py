"""Market, financial and chart-ready tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_topn(quotes: DataFrame, group: str, metric: str, key: str, n: int) -> DataFrame:
    """The n (1..50) greatest rows of each group with a rank; nulls are left out."""
    order = Window.partitionBy(group).orderBy(F.desc(metric), key)
    return quotes.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(50, max(1, n)))


def yoy_growth(yearly: DataFrame, entity: str, value: str) -> DataFrame:
    """Growth against the previous available year in percent."""
    before = F.lag(value).over(Window.partitionBy(entity).orderBy("year"))
    return yearly.withColumn("growth_pct", F.round((F.col(value) / F.nullif(before, F.lit(0)) - 1) * 100, 4))


def pivot_panel(long: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each key with a column for each metric (the values of a metric are summed)."""
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.sum("value"))


def melt_missing(wide: DataFrame, keys: list[str], metrics: list[str], facts: DataFrame) -> DataFrame:
    """Wide rows as (keys, label, value) appended to facts where (keys, label) is not there yet."""
    rows = wide.unpivot(keys, metrics, "label", "value").where("value is not null")
    return facts.unionByName(rows.join(facts.select(*keys, "label").distinct(), [*keys, "label"], "left_anti").select(*facts.columns))


def price_volume_pairs(rows: DataFrame, least: int = 5) -> DataFrame:
    """(name, price, amount) from rows (name, metric, value), by conditional aggregation; no rows below ``least`` pairs."""
    pairs = rows.groupBy("name").agg(F.max(F.when(F.col("metric") == "price", F.col("value"))).alias("price"), F.max(F.when(F.col("metric") == "amount", F.col("value"))).alias("amount"))
    pairs = pairs.where("price is not null and amount is not null")
    enough = pairs.agg((F.count("*") >= least).alias("enough")).where("enough")
    return pairs.join(F.broadcast(enough), F.lit(True), "left_semi")  # one row


def chart_type(rows: DataFrame, key: list[str]) -> DataFrame:
    """line with two or more years all present, horizontal bars above ten rows, else bars."""
    years = (F.count("year") == F.count("*")) & (F.count_distinct("year") >= 2)
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), F.when(years, "line").when(F.count("*") > 10, "hbar").otherwise("bar").alias("type"))


def specs_from_rows(rows: DataFrame) -> DataFrame:
    """One chart for each (series, unit) with two rows or more: extremes and time range."""
    grouped = rows.groupBy("series", "unit").agg(
        F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.max_by("label", F.struct("value", "label")).alias("top_label"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )
    return grouped.where("rows >= 2")


def merge_year_series(rows: DataFrame) -> DataFrame:
    """Series of one unit and metric with at least two years, one row a year."""
    yearly = rows.groupBy("unit", "metric", "year").agg(F.max("value").alias("value"))
    several = yearly.groupBy("unit", "metric").agg(F.count("*").alias("years")).where("years >= 2")
    return yearly.join(several, ["unit", "metric"]).select("unit", "metric", "year", "value")


def metric_year_panel(rows: DataFrame, least_years: int = 3) -> DataFrame:
    """Metrics with at least so many distinct years."""
    return rows.groupBy("metric").agg(F.count_distinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).where(F.col("years") >= least_years)


def pie_guard(rows: DataFrame, most: int = 5) -> DataFrame:
    """Groups of shares that sum to 95..105 percent with few slices."""
    return rows.groupBy("group").agg(F.round(F.sum("share"), 4).alias("total"), F.count("*").alias("slices")).withColumn("ok", F.col("total").between(95, 105) & (F.col("slices") <= most))


def largest_unit_group(rows: DataFrame, least: int = 2) -> DataFrame:
    """The rows of the unit with most rows (ties: least name)."""
    best = rows.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "unit").limit(1)
    return rows.join(F.broadcast(best.select("unit")), "unit", "left_semi")


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, nulls and distinct-free facts of every column, from one aggregation."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint")]
    stats = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.lit(c in numeric).alias("is_numeric"), F.count("*").alias("rows")) for c in df.columns]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def corr_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every two columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 6).alias("corr")) for a, b in pairs])
    return df.agg(cells.alias("c")).select(F.inline("c"))


def as_number(text: Column, factor: float = 1.0) -> Column:
    """A number or null, scaled and rounded to 2 places."""
    return F.round(text.try_cast("double") * factor, 2)


def facts_union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
