"""The weekly study's tables: model panel, peers' operating scores, revenue bridge and concentration.

The panel is one conditional aggregate of the weekly returns; scores, bridge and
shares are windows and joins on keys of their own. Nothing is pivoted by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from . import adapter, weekly

#: Quantiles at which the material's returns are clipped.
CLIP = (0.01, 0.99)


@dataclass(frozen=True)
class Roles:
    """Which series of the market plays which part."""

    focal: str = "1-URGENT"
    benchmark: str = "2-HIGH"
    peers: tuple[str, ...] = ("3-MEDIUM", "4-NOT SPECIFIED")
    material: str = "5-LOW"


NEEDED = ("focal_return", "market_return", "peer_return", "material_return")


def weekly_panel(weeks: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """week, the returns of the focal series, the benchmark and the peers (mean of those there are), excess returns over the benchmark, and the material's price, raw and clipped return.

    weeks: symbol, week, close_adj, log_return; one row for a symbol and week. A
    series without a return in a week is null there; no series of the roles, no row.
    """
    symbol, ret = F.col("symbol"), F.col("log_return")
    asked = weeks.where(symbol.isin(roles.focal, roles.benchmark, roles.material, *roles.peers))
    out = asked.groupBy("week").agg(
        F.max(F.when(symbol == roles.focal, ret)).alias("focal_return"),
        F.max(F.when(symbol == roles.benchmark, ret)).alias("market_return"),
        F.avg(F.when(symbol.isin(*roles.peers), ret)).alias("peer_return"),
        F.max(F.when(symbol == roles.material, F.col("close_adj"))).alias("material_price"),
        F.max(F.when(symbol == roles.material, ret)).alias("material_return_raw"),
    )
    out = out.withColumns({"focal_excess": F.col("focal_return") - F.col("market_return"), "peer_excess": F.col("peer_return") - F.col("market_return")})
    return windows.winsorised(out, "material_return_raw", *CLIP, "material_return")


def model_rows(panel: DataFrame) -> DataFrame:
    """Weeks in which the model has all its factors."""
    return panel.na.drop(subset=list(NEEDED))


def diagnostics(panel: DataFrame) -> DataFrame:
    """One row: weeks, those of the model, their first and last, and the bounds of clipping; nulls where there are none."""
    there = F.lit(True)
    for c in NEEDED:
        there = there & F.col(c).isNotNull()
    return panel.agg(F.count(F.lit(1)).alias("weeks"), F.count_if(there).alias("model_weeks"), F.min(F.when(there, F.col("week"))).alias("model_start"), F.max(F.when(there, F.col("week"))).alias("model_end"), F.min("material_return").alias("clip_low"), F.max("material_return").alias("clip_high"))


def operating_ratios(filings: DataFrame) -> DataFrame:
    """report_date, symbol and the ratios that peers are scored by, from first versions of year-end filings; growth is over the year before."""
    annual = filings.where((F.month("report_date") == 12) & (F.col("available_date") == F.col("notice_date")))
    income, revenue = F.col("net_income"), F.col("revenue")
    now = annual.select(
        "report_date",
        "symbol",
        revenue.alias("revenue"),
        income.alias("income"),
        (income / F.nullif(F.col("total_assets"), F.lit(0.0))).alias("return_on_assets"),
        (F.col("operating_cash_flow") / F.nullif(revenue, F.lit(0.0))).alias("cash_margin"),
        (F.col("total_liabilities") / F.nullif(F.col("total_assets"), F.lit(0.0))).alias("debt_ratio"),
    )
    last = now.select("symbol", F.add_months("report_date", 12).alias("report_date"), F.col("revenue").alias("__r"), F.col("income").alias("__i"))
    growth = now.join(last, ["symbol", "report_date"], "left").withColumns({"revenue_growth": F.col("revenue") / F.nullif(F.col("__r"), F.lit(0.0)) - 1, "income_growth": F.col("income") / F.nullif(F.col("__i"), F.lit(0.0)) - 1})
    return growth.drop("__r", "__i", "revenue", "income")


def operating_scores(filings: DataFrame) -> DataFrame:
    """The ratios with quality, growth, balance and operating scores, rank and universe of each report date."""
    return weekly.peer_scores(operating_ratios(filings), "report_date", ["return_on_assets", "cash_margin"], ["revenue_growth", "income_growth"], ["debt_ratio"])


def revenue_bridge(sales: DataFrame, keys: Sequence[str] = ("segment",)) -> DataFrame:
    """keys, year, effect (volume, price, net), value: how volume and price moved each segment's revenue from the year before.

    sales: keys, year, volume, price. The first year of a segment, and one after a gap, has none.
    """
    b = weekly.bridge(sales, "year", "volume", "price", keys)
    effects = [F.struct(F.lit(name).alias("effect"), F.col(c).alias("value")) for name, c in (("volume", "volume_effect"), ("price", "price_effect"), ("net", "total_effect"))]
    return b.select(*keys, "year", F.inline(F.array(*effects)))


def concentration(revenue: DataFrame, name: str, amount: str, top: int = 5) -> DataFrame:
    """One row: hhi and share_sum of the `top` largest names (ties by name), shares in percent of all revenue. A top-k report."""
    whole = revenue.agg(F.sum(amount).alias("__all"))
    best = revenue.orderBy(F.desc(amount), name).limit(top)
    shares = best.join(F.broadcast(whole)).select((F.col(amount) * 100 / F.nullif(F.col("__all"), F.lit(0.0))).alias("share_pct"))  # one row is sent
    return weekly.hhi(shares, "share_pct")


def segment_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment (return flag), year, volume and mean price of the order lines."""
    q = F.sum(F.col("l_quantity").cast("long"))
    line = adapter.table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("segment"), F.year("l_shipdate").alias("year")).agg(q.cast("double").alias("volume"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0 / q).alias("price"))


def customer_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey and its orders' value."""
    return adapter.table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("revenue"))
