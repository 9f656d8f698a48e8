"""The monthly fold: turnover, capacity, costs and cash of a long-only portfolio.

What doesn't depend on the path (targets, risk) is prepared across the cluster; only
the recurrence runs as one task for each scenario. State between months is weights,
cash, and what is last known of each name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MONTHS = 12
STAMP_CHANGE = pd.Timestamp("2023-08-28")


@dataclass(frozen=True)
class Costs:
    """Basis points each side, and the square-root impact coefficient."""

    commission_bps: float = 3.0
    spread_bps: float = 5.0
    stamp_bps_before: float = 10.0
    stamp_bps_from: float = 5.0
    impact_eta: float = 0.5


@dataclass(frozen=True)
class Mandate:
    min_holdings: int = 5
    turnover_cap: float = 0.25
    aum: float = 1e8
    max_adv_participation: float = 0.1
    costs: Costs = field(default_factory=Costs)


def trade_costs(trade: np.ndarray, adv: np.ndarray, vol: np.ndarray, day: pd.Timestamp, c: Costs, aum: float, multiplier: float) -> dict[str, float]:
    """Costs of weight changes as shares of opening value. Trading without known volume counts as full participation."""
    size = np.abs(trade)
    part = np.zeros(len(trade))
    on = size > 0
    known = on & np.isfinite(adv) & (adv != 0)
    part[on] = 1.0
    part[known] = np.maximum(size[known] * aum / adv[known], 0.0)
    sigma = np.maximum(np.where(np.isfinite(vol), vol, 0.03), 0.005)
    stamp = c.stamp_bps_from if day >= STAMP_CHANGE else c.stamp_bps_before
    out = {
        "commission_cost": size.sum() * c.commission_bps / 1e4,
        "spread_cost": size.sum() * c.spread_bps / 1e4,
        "stamp_duty_cost": -np.minimum(trade, 0).sum() * stamp / 1e4,
        "market_impact_cost": float((size * c.impact_eta * sigma * np.sqrt(part)).sum()),
    }
    out = {k: float(v) * multiplier for k, v in out.items()}
    return out | {"total_cost": sum(out.values()), "max_adv_participation": float(part.max()) if len(part) else 0.0}


def limited(target: np.ndarray, current: np.ndarray, adv: np.ndarray, turnover_cap: float, aum: float, participation: float) -> tuple[np.ndarray, float, float]:
    """One factor for the whole trade, so that turnover (half the traded weight) and each name's volume share keep their caps. A name that must trade without known volume stops all trading."""
    delta = target - current
    size = np.abs(delta)
    wish, cap, k = 0.5 * size.sum(), max(turnover_cap, 0.0), 1.0
    if wish > cap:
        k = cap / wish
    on = size > 0
    if on.any():
        k = min(k, float((participation * np.where(np.isfinite(adv), adv, 0.0)[on] / aum / size[on]).min()))
    done = current + max(k, 0.0) * delta
    return done, float(wish), float(0.5 * np.abs(done - current).sum())


def funded(planned: np.ndarray, start: np.ndarray, adv: np.ndarray, vol: np.ndarray, day: pd.Timestamp, m: Mandate, multiplier: float) -> tuple[np.ndarray, dict[str, float], float]:
    """Weights that leave room for their own costs: scaled down until weights and costs fit into opening value. Gives weights, costs and cash."""
    w, s = np.maximum(planned, 0.0), np.maximum(start, 0.0)
    for _ in range(100):
        cost = trade_costs(w - s, adv, vol, day, m.costs, m.aum, multiplier)
        room = 1.0 - cost["total_cost"]
        if room < 0:
            raise ValueError("costs exceed the portfolio's value")
        if w.sum() <= room + 1e-12 or w.sum() <= 0:
            break
        w = w * (room / w.sum())
    else:
        raise RuntimeError("cost funding did not converge")
    cost = trade_costs(w - s, adv, vol, day, m.costs, m.aum, multiplier)
    cash = 1.0 - w.sum() - cost["total_cost"]
    if cash < -1e-9:
        raise RuntimeError("the portfolio is not self-financing")
    return w, cost, max(float(cash), 0.0)


LEDGER = (
    "scenario string, cost_multiplier double, execution_date date, signal_date date, symbol string, research_split string, in_current_universe boolean, forced_exit boolean, "
    "benchmark_weight double, pre_trade_weight double, target_weight double, implemented_weight double, active_weight double, trade_weight double, trade_value double, adv20 double, "
    "forward_return double, market_beta_126d double, composite_score double, industry_group string, cash_weight double, pre_trade_cash_weight double, commission_cost double, spread_cost double, stamp_duty_cost double, market_impact_cost double, total_cost double, max_adv_participation double"
)


class Account:
    """What a scenario carries from month to month: weights, cash, and the last volume, deviation, score and group of every name met."""

    def __init__(self, scenario: str, multiplier: float, mandate: Mandate):
        self.scenario, self.multiplier, self.mandate = scenario, multiplier, mandate
        self.held: dict[str, float] = {}
        self.cash = 0.0
        self.facts: dict[str, tuple[float, float, float, str]] = {}

    def trade(self, month: pd.DataFrame) -> list[tuple]:
        """Ledger rows of one month (in order of symbol); none if it has too few names."""
        m, held, cash, facts, out = self.mandate, self.held, self.cash, self.facts, []
        if len(month) < m.min_holdings:
            return out
        day, names = month["execution_date"].iloc[0], month["symbol"].tolist()
        bench = dict(zip(names, month["benchmark"], strict=True))
        if not held:
            held, cash = dict(bench), 0.0
        else:
            total = sum(held.values()) + cash
            if total > 0:
                held, cash = {s: w / total for s, w in held.items()}, cash / total
        for s, *f in zip(names, month["adv20_rmb"], month["volatility_63d"], month["composite_score"], month["industry_group"].astype(str), strict=True):
            facts[s] = tuple(f)
        target = dict(zip(names, month["target"], strict=True))
        ahead = dict(zip(names, month["forward_return"], strict=True))
        betas = dict(zip(names, month["market_beta_126d"], strict=True))
        exits = [s for s in held if s not in bench]
        forced = sum(held[s] for s in exits)
        inside = np.array([held.get(s, 0.0) for s in names])
        plan, _, _ = limited(month["target"].to_numpy(float), inside, month["adv20_rmb"].to_numpy(float), max(0.0, m.turnover_cap - 0.5 * forced), m.aum, m.max_adv_participation)
        every = names + exits
        start = np.array([held.get(s, 0.0) for s in every])
        day_ = pd.Timestamp(day)
        w, cost, left = funded(np.append(plan, np.zeros(len(exits))), start, np.array([facts[s][0] for s in every], float), np.array([facts[s][1] for s in every], float), day_, m, self.multiplier)
        gain = np.array([ahead.get(s, 0.0) for s in every], float)
        value = w * (1 + gain)
        nav = float(value.sum() + left)
        if abs(nav - (1 + float((w * gain).sum()) - cost["total_cost"])) > 1e-9 or nav <= 0:
            raise RuntimeError("net asset value does not reconcile")
        for k, s in enumerate(every):
            b = bench.get(s, 0.0)
            out.append((self.scenario, self.multiplier, day, month["signal_date"].iloc[0], s, month["research_split"].iloc[0], s in bench, s not in bench, b, start[k], target.get(s, 0.0), w[k], w[k] - b, w[k] - start[k], (w[k] - start[k]) * m.aum, facts[s][0], ahead.get(s), betas.get(s), facts[s][2], facts[s][3], left, cash, *(cost[c] for c in ("commission_cost", "spread_cost", "stamp_duty_cost", "market_impact_cost", "total_cost", "max_adv_participation"))))
        self.held = {s: v / nav for s, v in zip(every, value, strict=True) if v / nav > 1e-14}
        self.cash = left / nav
        return out


def _months(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The months of rows that come in order of date and symbol; a batch may end within a month."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        rows = b.to_pandas()
        if not len(rows):
            continue
        for day, month in rows.groupby("execution_date", sort=True):
            if rest and rest[0]["execution_date"].iloc[0] != day:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(month)
    if rest:
        yield pd.concat(rest, ignore_index=True)



def backtest(targets: DataFrame, mandate: Mandate) -> DataFrame:
    """The ledger of every scenario (scenario, cost_multiplier): a row for each month and name, exits included.

    targets: scenario, cost_multiplier, execution_date, signal_date, symbol, benchmark,
    target, forward_return, composite_score, adv20_rmb, volatility_63d,
    market_beta_126d, industry_group, research_split; rows without label or score
    must be gone before. Scenarios are independent tasks. Their months come in order, sorted
    by Spark, and go as they are folded: memory holds one month, one batch and the state.
    """
    keys = ["scenario", "cost_multiplier"]
    names = [c.split()[0] for c in LEDGER.split(", ")]
    ordered = targets.repartition(*keys).sortWithinPartitions(*keys, "execution_date", "symbol")
    schema = to_arrow_schema(StructType.fromDDL(LEDGER))

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account = Account(key[0].as_py(), float(key[1].as_py()), mandate)
        for month in _months(batches):
            rows = pd.DataFrame(account.trade(month), columns=names)
            yield pa.RecordBatch.from_pandas(rows, schema=schema, preserve_index=False)

    return ordered.groupBy(*keys).applyInArrow(fold, LEDGER)


def monthly(ledger: DataFrame, cap: float) -> DataFrame:
    """One row for each scenario and month, from the ledger."""
    one = [F.first(c).alias(c) for c in ("research_split", "cash_weight", "commission_cost", "spread_cost", "stamp_duty_cost", "market_impact_cost", "total_cost", "max_adv_participation")]
    ret, traded = F.coalesce("forward_return", F.lit(0.0)), F.abs("trade_weight")
    exit_ = F.col("forced_exit")
    out = ledger.groupBy("scenario", "cost_multiplier", "execution_date").agg(
        *one,
        F.count_if(F.col("implemented_weight") > 1e-8).alias("holdings"),
        F.sum(F.when(F.col("in_current_universe"), F.col("implemented_weight") * ret).otherwise(0.0)).alias("strategy_gross_return"),
        F.sum(F.col("benchmark_weight") * ret).alias("benchmark_return"),
        (F.sum(F.abs(F.col("target_weight") - F.col("pre_trade_weight"))) / 2).alias("desired_one_way_turnover"),
        (F.sum(traded) / 2).alias("implemented_one_way_turnover"),
        F.sum(traded).alias("gross_traded_weight"),
        F.count_if(exit_ & (F.col("pre_trade_weight") > 1e-12)).alias("forced_exit_count"),
        F.sum(F.when(exit_, F.col("pre_trade_weight")).otherwise(0.0)).alias("forced_exit_sell_weight"),
        F.sum("implemented_weight").alias("post_trade_risky_weight"),
        F.sum(F.when(F.col("in_current_universe"), F.col("active_weight") * F.coalesce("market_beta_126d", F.lit(1.0))).otherwise(0.0)).alias("active_market_beta"),
    )
    out = out.withColumn("strategy_net_return", F.col("strategy_gross_return") - F.col("total_cost"))
    return out.withColumns({"gross_active_return": F.col("strategy_gross_return") - F.col("benchmark_return"), "net_active_return": F.col("strategy_net_return") - F.col("benchmark_return"), "turnover_cap_breached": F.col("implemented_one_way_turnover") > cap + 1e-10})


def performance(months: DataFrame) -> DataFrame:
    """The performance record of each scenario and split (and all): 28 fields."""
    keys = ["scenario", "cost_multiplier", "research_split"]
    both = months.withColumn("research_split", F.explode(F.array_distinct(F.array(F.lit("all"), F.col("research_split")))))
    w = Window.partitionBy(*keys).orderBy("execution_date").rowsBetween(Window.unboundedPreceding, 0)
    net, gross, bench = (F.coalesce(c, F.lit(0.0)) for c in ("strategy_net_return", "strategy_gross_return", "benchmark_return"))
    curve = both.withColumns({"__n": net, "__g": gross, "__b": bench, "__a": net - bench, "__e": F.product(1 + net).over(w)}).withColumn("__dd", F.col("__e") / F.max("__e").over(w) - 1)
    size, root = F.count(F.lit(1)), F.sqrt(F.lit(float(MONTHS)))

    def yearly(c: str):
        return F.pow(F.product(1 + F.col(c)), F.lit(float(MONTHS)) / size) - 1

    def sharpe(c: str):
        return F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * root)

    return curve.groupBy(*keys).agg(
        size.alias("months"),
        (F.product(1 + F.col("__g")) - 1).alias("cumulative_gross_return"),
        (F.product(1 + F.col("__n")) - 1).alias("cumulative_net_return"),
        (F.product(1 + F.col("__b")) - 1).alias("cumulative_benchmark_return"),
        yearly("__g").alias("annualized_gross_return"),
        yearly("__n").alias("annualized_net_return"),
        yearly("__b").alias("annualized_benchmark_return"),
        (F.stddev_samp("__n") * root).alias("annualized_net_volatility"),
        sharpe("__n").alias("net_sharpe_zero_rf"),
        (yearly("__n") - yearly("__b")).alias("annualized_active_return"),
        (F.stddev_samp("__a") * root).alias("tracking_error"),
        sharpe("__a").alias("information_ratio"),
        F.min("__dd").alias("max_drawdown"),
        F.avg((F.col("__a") > 0).cast("double")).alias("active_month_hit_rate"),
        F.avg("implemented_one_way_turnover").alias("average_one_way_turnover"),
        F.avg("gross_traded_weight").alias("average_gross_traded_weight"),
        F.sum("forced_exit_sell_weight").alias("total_forced_exit_sell_weight"),
        F.count_if(F.col("forced_exit_count") > 0).alias("months_with_forced_exits"),
        F.avg("cash_weight").alias("average_cash_weight"),
        F.max("cash_weight").alias("maximum_cash_weight"),
        F.sum("total_cost").alias("total_cost_arithmetic"),
        (F.avg("total_cost") * MONTHS).alias("annualized_cost_drag_arithmetic"),
        (yearly("__g") - yearly("__n")).alias("annualized_cost_drag_geometric"),
        *((F.avg(f"{c}_cost") * MONTHS).alias(f"annualized_{c}_drag") for c in ("commission", "spread", "stamp_duty", "market_impact")),
    )


def contributions(ledger: DataFrame, split: str = "final_holdout") -> DataFrame:
    """symbol, signed and absolute active contribution, months, share: which names carry the active return. Forced exits have no label and stay out."""
    part = F.col("active_weight") * F.col("forward_return")
    own = ledger.where((F.col("research_split") == split) & F.col("in_current_universe")).withColumn("__c", F.coalesce(part, F.lit(0.0)))
    by_name = own.groupBy("scenario", "cost_multiplier", "symbol").agg(F.sum("__c").alias("signed_active_contribution"), F.sum(F.abs("__c")).alias("absolute_active_contribution"), F.countDistinct("execution_date").alias("months"))
    total = F.sum("absolute_active_contribution").over(Window.partitionBy("scenario", "cost_multiplier"))
    return by_name.withColumn("share_of_absolute_active_contribution", F.when(total > 0, F.col("absolute_active_contribution") / total).otherwise(0.0))


def concentration(ledger: DataFrame, split: str = "final_holdout") -> DataFrame:
    """For each scenario: the top contributor (of equal ones the first name) and its share, and the largest absolute active weight of a name and of a group."""
    keys = ["scenario", "cost_multiplier"]
    top = contributions(ledger, split).groupBy(*keys).agg(F.min_by(F.struct("symbol", "share_of_absolute_active_contribution"), F.struct(-F.col("absolute_active_contribution"), "symbol")).alias("t"))
    own = ledger.where((F.col("research_split") == split) & F.col("in_current_universe"))
    single = own.groupBy(*keys).agg(F.max(F.abs("active_weight")).alias("maximum_absolute_single_name_active_weight"))
    group = own.groupBy(*keys, "execution_date", "industry_group").agg(F.sum("active_weight").alias("g")).groupBy(*keys).agg(F.max(F.abs("g")).alias("maximum_absolute_group_active_weight"))
    return top.select(*keys, F.col("t.symbol").alias("top_symbol"), F.col("t.share_of_absolute_active_contribution").alias("top_symbol_share")).join(single, keys).join(group, keys)
