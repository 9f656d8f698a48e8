"""Frames of charts, and the Markdown report of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..sources import files


def cumulative_ic(ic: DataFrame) -> DataFrame:
    """signal, execution_date, cumulative_rank_ic: the line chart of information coefficients."""
    w = Window.partitionBy("signal").orderBy("execution_date").rowsBetween(Window.unboundedPreceding, 0)
    return ic.select("signal", "execution_date", F.sum(F.coalesce("rank_ic", F.lit(0.0))).over(w).alias("cumulative_rank_ic"))


def quantile_bars(legs: DataFrame) -> DataFrame:
    """signal, leg, mean_return: the bar chart of quantile portfolios."""
    return legs.groupBy("signal", "leg").agg(F.avg("leg_return").alias("mean_return"))


def drawdown_lines(months: DataFrame) -> DataFrame:
    """scenario, cost_multiplier, execution_date, equity and drawdown of net returns: the chart of a portfolio's path."""
    keys = ("scenario", "cost_multiplier")
    return windows.equity(months, "strategy_net_return", keys, "execution_date").select(*keys, "execution_date", "equity", "drawdown")


def correlation_heatmap(panel: DataFrame, signals: Sequence[str]) -> DataFrame:
    """x, y, correlation of each pair of signals over all rows, in one pass: the heat map of signals."""
    cells = [(a, b) for a in signals for b in signals]
    one = panel.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(cells)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(cells)))).alias("s")).select("s.*")


def report(title: str, sections: Sequence[tuple[str, str, DataFrame | None]], facts: Mapping[str, object] | None = None) -> str:
    """A Markdown text: the title, facts as a list, and sections of a heading, prose and a table each. Tables are small; a long one is an error, not cut."""
    lines = [f"# {title}", ""]
    if facts:
        lines += [f"- {k}: {v}" for k, v in facts.items()] + [""]
    for heading, prose, table in sections:
        lines += [f"## {heading}", ""]
        if prose:
            lines += [prose, ""]
        if table is not None:
            lines += [files.markdown_table(table), ""]
    return "\n".join(lines).rstrip() + "\n"


def write_report(path: str, text: str) -> None:
    """Written beside and renamed."""
    files.write_text(path, text)
