"""The research run: panels for each signal lag, diagnostics, portfolios under cost scenarios, and failure gates."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate, portfolio, risk
from . import adapter, panel


def settled(df: DataFrame) -> DataFrame:
    """The frame as files in the shared checkpoint folder: a panel is read many times, and its plan is long.

    This runs a job at once. A folder of our own only in local mode, where none is
    named; on a cluster its absence is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


SIGNALS = ("composite_score", *(f"{f}_score" for f in panel.FAMILIES))


@dataclass(frozen=True)
class Setup:
    """Parameters of a run; the defaults suit weekly bars of the order tables."""

    features: panel.Features = panel.WEEKLY
    mandate: portfolio.Mandate = portfolio.Mandate(aum=1e4)
    design_end: str = "1998-12-31"
    validation_end: str = "2000-06-30"
    hac_lags: int = 3
    min_cross_section: int = 10
    score_tilt: float = 0.5
    max_weight: float = 0.15
    max_active: float = 0.05
    te_cap: float = 0.06
    beta_cap: float = 0.1
    lookback: int = 40
    shrinkage: float = 0.35
    min_history: int = 53
    min_adv: float = 1.0
    multipliers: tuple[float, ...] = (0.5, 1.0, 2.0)

    def __post_init__(self) -> None:
        if not self.design_end < self.validation_end:
            raise ValueError("the design period must end before validation does")


@dataclass(frozen=True)
class Inputs:
    """What a run knows: the market, the filings and the members."""

    market: DataFrame
    filings: DataFrame
    members: DataFrame


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    """All inputs from one reading of the order lines, settled; every lag and step of a run can share them."""
    by_day = settled(adapter.days(spark, sf_dir))
    return Inputs(settled(adapter.market(spark, sf_dir, by_day)), settled(adapter.fundamentals(spark, sf_dir, by_day)), settled(adapter.memberships(spark, sf_dir, by_day=by_day)))


def eligible_panel(known: Inputs, setup: Setup, lag: int = 1) -> DataFrame:
    """Scored rows that are fit for research, with their split."""
    f = replace(setup.features, lag=lag)
    built = panel.build(known.market, known.filings, known.members, adapter.BENCHMARK, f)
    out = panel.composite(built, setup.min_history, setup.min_adv, yearly=f.yearly)
    return out.withColumn("research_split", S.split_label(F.col("execution_date"), setup.design_end, setup.validation_end)).where("systematic_eligible")


def targets(eligible: DataFrame, market: DataFrame, setup: Setup) -> DataFrame:
    """Monthly target weights after projection and risk scaling; none of it depends on the path."""
    keep = ["execution_date", "signal_date", "symbol", "forward_return", "composite_score", "adv20_rmb", "volatility_63d", "market_beta_126d", "industry_group", "research_split"]
    rows = eligible.where("forward_return is not null and composite_score is not null").select(*keep, "benchmark_weight")
    rows = settled(risk.normalised(rows, "benchmark_weight", ["execution_date"], "benchmark").drop("benchmark_weight"))
    tilted = risk.score_tilt(rows, ["execution_date"], setup.score_tilt)
    aimed = settled(risk.projected(tilted, ["execution_date"], setup.max_weight, setup.max_active))
    cov = settled(covariances(rows, market, setup))
    return risk.scaled(aimed, risk.active_risk(aimed, cov), setup.te_cap, setup.beta_cap)


def covariances(rows: DataFrame, market: DataFrame, setup: Setup) -> DataFrame:
    months = rows.select("signal_date", "symbol").distinct()
    return risk.covariance(settled(risk.recent_returns(market, settled(months), setup.lookback)), setup.lookback, setup.shrinkage, setup.features.yearly)


def simulate(aims: DataFrame, setup: Setup, scenario: str, multipliers: tuple[float, ...]) -> DataFrame:
    """The ledger of each cost multiplier."""
    each = aims.withColumns({"scenario": F.lit(scenario), "cost_multiplier": F.explode(F.array(*map(F.lit, multipliers)))})
    return portfolio.backtest(each.drop("raw_weight", "target_ex_ante_tracking_error", "target_active_market_beta"), setup.mandate)


def ledgers(known: Inputs, setup: Setup, panels: dict[int, DataFrame] | None = None) -> DataFrame:
    """Baseline under every cost multiplier, and the extra-lag run under the first of 1.0."""
    out = None
    for lag, name, costs in ((1, "baseline", setup.multipliers), (2, "extra_lag", (1.0,))):
        one = simulate(targets(panels[lag] if panels else eligible_panel(known, setup, lag), known.market, setup), setup, name, costs)
        out = one if out is None else out.unionByName(one)
    return settled(out)


def gates(known: Inputs, setup: Setup, panels: dict[int, DataFrame] | None = None, perf: DataFrame | None = None) -> DataFrame:
    """check_name, value, passed: eight numbers of the final holdout that must be positive. A missing number fails. Panels by lag and the performance are made here unless they are given."""
    split = "final_holdout"
    panels = panels or {lag: settled(eligible_panel(known, setup, lag)) for lag in (1, 2)}
    if perf is None:
        perf = settled(portfolio.performance(portfolio.monthly(ledgers(known, setup, panels), setup.mandate.turnover_cap)))
    found = []
    for lag, name in ((1, ""), (2, "additional_lag_")):
        rows = panels[lag]
        ic = evaluate.information_coefficients(rows, ["composite_score"], least=setup.min_cross_section, p_values=False).withColumn("research_split", S.split_label(F.col("execution_date"), setup.design_end, setup.validation_end))
        legs = evaluate.quantile_returns(rows, ["composite_score"], least=setup.min_cross_section).withColumn("research_split", S.split_label(F.col("execution_date"), setup.design_end, setup.validation_end))
        found.append((f"{name}final_holdout_rank_ic_positive", evaluate.metric(evaluate.ic_summary(ic, lags=setup.hac_lags, p_values=False), "mean_rank_ic", research_split=split)))
        found.append((f"{name}final_holdout_top_minus_bottom_positive", evaluate.metric(evaluate.quantile_summary(legs, lags=setup.hac_lags, p_values=False), "mean_monthly_return", research_split=split, leg="top_minus_bottom")))
    for label, scenario, cost, column in (("baseline_active_return_positive", "baseline", 1.0, "annualized_active_return"), ("baseline_information_ratio_positive", "baseline", 1.0, "information_ratio"), ("double_cost_active_return_positive", "baseline", 2.0, "annualized_active_return"), ("additional_lag_active_return_positive", "extra_lag", 1.0, "annualized_active_return")):
        found.append((label, evaluate.metric(perf.where(F.col("cost_multiplier") == cost), column, research_split=split, scenario=scenario)))
    out = None
    for label, df in found:
        one = df.select(F.lit(label).alias("check_name"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("passed", F.coalesce(F.col("value") > 0, F.lit(False)))
