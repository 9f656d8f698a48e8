"""Logical research inputs from the order tables: brands as securities, weeks as bars.

Sums run over whole cents, so that every engine and every order of rows gives the
same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest, top_n

BENCHMARK = "MKT"
TOP = 20
#: A brand that the groups table excludes.
EXCLUDED = "Brand#55"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, qty, price and retail in cents, disc and tax in hundredths."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _cents("p_retailprice").alias("retail"))
    item = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), F.round("l_quantity").cast("long").alias("qty"), _cents("l_extendedprice").alias("price"), _cents("l_discount").alias("disc"), _cents("l_tax").alias("tax"))
    return item.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("symbol"), "day", "qty", "price", "retail", "disc", "tax")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day and the sums of its order lines (qty, price, rev, ast, tx), highest and lowest unit price: all that market, filings and members need of the lines.

    Settled once, it spares them a reading of the lines each; its rows are brands times days.
    """
    each = F.col("price") / 100.0 / F.col("qty")
    sums = {"price": F.sum("price"), "qty": F.sum("qty"), "high": F.max(each), "low": F.min(each), "rev": F.sum(F.col("price") * (100 - F.col("disc"))), "ast": F.sum(F.col("qty") * F.col("retail")), "tx": F.sum(F.col("price") * F.col("tax"))}
    return lines(spark, sf_dir).groupBy("symbol", "day").agg(*(x.alias(k) for k, x in sums.items()))


def market(spark: SparkSession, sf_dir: str, by_day: DataFrame | None = None) -> DataFrame:
    """date, symbol, close_adj, close_raw, high_raw, low_raw, volume of each brand and week, and of all brands as the benchmark. by_day: the settled `days`, here and below."""
    week = F.date_trunc("week", "day").cast("date").alias("date")
    base = (by_day or days(spark, sf_dir)).select(week, F.explode(F.array("symbol", F.lit(BENCHMARK))).alias("symbol"), "price", "qty", "high", "low")
    out = base.groupBy("date", "symbol").agg((F.sum("price") / 100.0 / F.sum("qty")).alias("close_adj"), F.max("high").alias("high_raw"), F.min("low").alias("low_raw"), F.sum("qty").cast("double").alias("volume"))
    return out.select("date", "symbol", "close_adj", F.col("close_adj").alias("close_raw"), "high_raw", "low_raw", "volume")


def fundamentals(spark: SparkSession, sf_dir: str, by_day: DataFrame | None = None) -> DataFrame:
    """Quarterly filings of each brand; every fifth brand restates each quarter, thirty days later."""
    quarter = F.last_day(F.add_months(F.trunc("day", "quarter"), 2)).alias("report_date")
    sums = (by_day or days(spark, sf_dir)).groupBy("symbol", quarter).agg(*(F.sum(c).alias(c) for c in ("rev", "ast", "tx")))
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    one = sums.select("symbol", "report_date", F.date_add("report_date", 45).alias("notice_date"), (F.col("rev") / 10000.0).alias("revenue"), (F.col("ast") / 100.0).alias("total_assets"), (F.col("rev") / 10000.0 * 0.7).alias("cost_of_goods_sold"), (F.col("rev") / 10000.0 * 0.1).alias("net_income"), (F.col("tx") / 10000.0).alias("operating_cash_flow"), (F.col("ast") / 100.0 * 0.4 + number).alias("total_liabilities"))
    again = one.where(number % 5 == 0).withColumn("revenue", F.col("revenue") * 1.02).withColumn("available_date", F.date_add("report_date", 75))
    return one.withColumn("available_date", F.col("notice_date")).unionByName(again)


def memberships(spark: SparkSession, sf_dir: str, top: int = TOP, by_day: DataFrame | None = None) -> DataFrame:
    """The `top` brands by revenue of each half-year: snapshot and availability date, weight and group; the excluded brand is left out."""
    half = F.when(F.month("day") <= 6, F.make_date(F.year("day"), F.lit(6), F.lit(30))).otherwise(F.make_date(F.year("day"), F.lit(12), F.lit(31)))
    rev = (by_day or days(spark, sf_dir)).groupBy("symbol", half.alias("snapshot_date")).agg(F.sum("rev").alias("rev"))
    best = top_n(rev, ("snapshot_date",), [F.desc("rev"), F.asc("symbol")], top)
    wait = F.when(F.month("snapshot_date") == 6, F.date_add("snapshot_date", 60)).otherwise(F.date_add("snapshot_date", 90))
    whole = best.groupBy("snapshot_date").agg(F.sum("rev").alias("total"))
    out = best.join(whole, "snapshot_date").select("snapshot_date", wait.alias("available_date"), "symbol", (F.col("rev") / F.col("total")).alias("benchmark_weight"), group("symbol").alias("industry_group"))
    return out.where(F.col("symbol") != EXCLUDED)


def group(symbol: str) -> Column:
    return F.concat(F.lit("g"), (F.regexp_extract(symbol, r"(\d+)", 1).cast("int") % 4).cast("string"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol (order priority), close_adj: mean order value of each day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol")).agg((F.sum(_cents("o_totalprice")) / 100.0 / F.count(F.lit(1))).alias("close_adj"))


__all__ = ["BENCHMARK", "days", "fundamentals", "group", "latest", "lines", "market", "memberships", "orders_daily", "table"]
