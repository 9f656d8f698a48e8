"""Command line: `python -m tidemark.cli <command> --config file.yaml`.

download            source tables of the weekly study: daily means of orders, with a manifest
build               weekly series and model panel, peers' operating scores, revenue bridge, diagnostics
analyze             models, rolling fits, forecasts, attribution, peer validation and the study of price
                    series with its scenarios, as tables and JSON
report              a Markdown report of the analysis
systematic-download market, filings and members, with a manifest
systematic-run      panel, diagnostics, portfolios and gates, as tables, JSON and a report

The configuration has `project` (input: folder of the order tables, output: a local
folder for the results) and, for the systematic commands, `evaluation` (design_end,
validation_end). Tables go through Spark; JSON, manifests and reports are small files
of the driver.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import evaluate, portfolio, windows
from .plans import adapter, assets, commodity, regression, report, research, study, weekly
from .sources import files

COMMANDS = ("download", "build", "analyze", "report", "systematic-download", "systematic-run")
MODELS = {"market_only": ["market"], "full": ["market", "peer", "material"]}
#: Models that are fitted; of these, MODELS are compared out of sample.
FITTED = {**MODELS, "market_plus_peers": ["market", "peer"]}
#: Window of the attribution, end of the peers' windows, and the scenarios of the material's price.
ATTRIBUTED, CUTOFF = ("1997-01-01", "1998-12-31"), "1998-07-15"
SIMULATIONS, HORIZON, SEED, MATERIAL, BETAS, PASSED = 10_000, 52, 7, 1000.0, [0.3, 0.5], [0.0, 0.5, 0.9]
SERIES = {"y": "1-URGENT", "market": "2-HIGH", "peer": "3-MEDIUM", "material": "5-LOW"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description="Point-in-time panel research on Spark")
    commands = out.add_subparsers(dest="command", required=True)
    for c in COMMANDS:
        commands.add_parser(c).add_argument("--config", required=True)
    return out


def _saved(df: DataFrame, out: str, name: str) -> DataFrame:
    files.write_frame(df, f"{out}/{name}.parquet")
    return files.read_parquet(df.sparkSession, f"{out}/{name}.parquet", df.schema)


def weekly_factors(weeks: DataFrame) -> DataFrame:
    """week, y and the factors: log returns of the study's series, weeks with all of them."""
    one = weeks.groupBy("week").agg(*(F.max(F.when(F.col("symbol") == s, F.col("log_return"))).alias(c) for c, s in SERIES.items()))
    return one.na.drop().withColumn("study", F.lit(1))


def download(spark: SparkSession, source: str, out: str) -> dict[str, Any]:
    daily = _saved(adapter.orders_daily(spark, source), out, "daily")
    record = files.source_record(daily, "orders", {"input": source})
    files.write_manifest(f"{out}/manifest.json", {"daily": record})
    return record


def build(spark: SparkSession, source: str, out: str) -> dict[str, Any]:
    daily = files.read_parquet(spark, f"{out}/daily.parquet")
    weeks = _saved(windows.log_return(windows.weekly_last(daily, "close_adj"), "close_adj"), out, "weekly")
    panel = _saved(study.weekly_panel(weeks), out, "weekly_panel")
    _saved(study.model_rows(panel), out, "weekly_model_panel")
    _saved(study.operating_scores(adapter.fundamentals(spark, source)), out, "peer_operating_scores")
    _saved(study.revenue_bridge(study.segment_sales(spark, source)), out, "revenue_bridge")
    held = study.concentration(study.customer_revenue(spark, source), "o_custkey", "revenue")
    found = {**study.diagnostics(panel).first().asDict(), **held.first().asDict()}
    files.write_json(f"{out}/build_diagnostics.json", found)
    return {**found, "series": weeks.select("symbol").distinct().count()}


def model_factors(panel: DataFrame) -> DataFrame:
    """week, y and the factors under the names of `FITTED`, from rows of the model panel."""
    return panel.select("week", F.col("focal_return").alias("y"), F.col("market_return").alias("market"), F.col("peer_return").alias("peer"), F.col("material_return").alias("material"), F.lit(1).alias("study"))


def analyze(spark: SparkSession, source: str, out: str) -> dict[str, Any]:
    factors = model_factors(files.read_parquet(spark, f"{out}/weekly_model_panel.parquet"))
    models = _saved(regression.hac_models(factors, FITTED, "y", "week"), out, "models")
    _saved(weekly.rolling_fit(factors, "y", MODELS["full"], ["study"], "week"), out, "rolling")
    forecasts = _saved(weekly.walk_forward_models(factors, "y", MODELS, ["study"], "week"), out, "forecasts")
    oos = weekly.compared(forecasts, ["study"], "y", "market_only", "full").drop("study").first()
    parts = _saved(regression.attribution(factors, models, MODELS["full"], "y", *ATTRIBUTED, "week"), out, "attribution")
    scores = files.read_parquet(spark, f"{out}/peer_operating_scores.parquet")
    market = _saved(adapter.market(spark, source), out, "market")
    checked = _saved(weekly.validated(scores, market, adapter.BENCHMARK, CUTOFF), out, "peer_validation")
    weeks = files.read_parquet(spark, f"{out}/weekly.parquet").select("symbol", "week", "close_adj")
    fitted = _saved(commodity.fits(weeks, ["symbol"], "close_adj", "week"), out, "price_models")
    paths = commodity.simulated(weeks, fitted, ["symbol"], "close_adj", "week", SIMULATIONS, HORIZON, SEED)
    scenarios = _saved(weekly.scenario_grid(spark, paths, MATERIAL, BETAS, PASSED, ["symbol"]), out, "scenarios")

    def rows(df: DataFrame, *order: str) -> list[dict[str, Any]]:
        return [r.asDict() for r in df.orderBy(*order).collect()]  # a table of the report

    summary = {
        "weeks": factors.count(),
        "models": rows(models, "model", "term"),
        "out_of_sample": oos.asDict() if oos else None,
        "attribution": rows(parts.where("model = 'full'"), "component"),
        "peer_validation": rows(checked, "report_date"),
        "price_models": rows(fitted, "symbol"),
        "scenarios": scenarios.count(),
    }
    files.write_json(f"{out}/analysis.json", summary)
    return summary


def study_report(spark: SparkSession, source: str, out: str) -> dict[str, Any]:
    models = files.read_parquet(spark, f"{out}/models.parquet").orderBy("model", "term")
    titles = {"attribution": ("Attribution", ("model", "component")), "peer_validation": ("Peers", ("report_date",)), "price_models": ("Price series", ("symbol",)), "scenarios": ("Scenarios", ("symbol", "beta", "pass_through", "quantile")), "revenue_bridge": ("Revenue bridge", ("segment", "year", "effect"))}
    tables = [(title, "", files.read_parquet(spark, f"{out}/{name}.parquet").orderBy(*order)) for name, (title, order) in titles.items()]
    text = report.report("Weekly study", [("Models", "Least squares with Newey-West errors.", models.select("model", "term", "coefficient", "hac_t", "p_value", "n")), *tables], {"input": source})
    report.write_report(f"{out}/report.md", text)
    return {"characters": len(text)}


def systematic_download(spark: SparkSession, source: str, out: str) -> dict[str, Any]:
    known = research.inputs(spark, source)
    market, wanted = known.market, known.market.select("symbol").distinct()
    return assets.collect_assets(out, wanted, market, lambda lacking: market.join(lacking, "symbol", "left_semi"), known.filings, known.members, {"input": source})


def systematic_run(spark: SparkSession, source: str, out: str, setup: research.Setup) -> dict[str, Any]:
    known = research.inputs(spark, source)
    panels = {lag: research.settled(research.eligible_panel(known, setup, lag)) for lag in (1, 2)}
    ic = evaluate.information_coefficients(panels[1], list(research.SIGNALS), least=setup.min_cross_section)
    ic = _saved(ic.withColumn("research_split", research.S.split_label(F.col("execution_date"), setup.design_end, setup.validation_end)), out, "monthly_ic")
    summary = _saved(evaluate.ic_summary(ic, lags=setup.hac_lags), out, "signal_summary")
    months = portfolio.monthly(research.ledgers(known, setup, panels), setup.mandate.turnover_cap)
    performance = _saved(portfolio.performance(_saved(months, out, "portfolio_monthly")), out, "portfolio_summary")
    gates = _saved(research.gates(known, setup, panels, performance), out, "gates")
    checks = [r.asDict() for r in gates.orderBy("check_name").collect()]  # eight rows
    result = {"panel_rows": panels[1].count(), "gates": checks, "passed": all(c["passed"] for c in checks)}
    files.write_json(f"{out}/summary.json", result)
    columns = ("scenario", "cost_multiplier", "research_split", "months", "annualized_active_return", "information_ratio")
    ordered = Window.partitionBy("scenario").orderBy("cost_multiplier", "research_split")
    table = performance.withColumn("__r", F.row_number().over(ordered)).orderBy("scenario", "__r").select(*columns)
    report.write_report(f"{out}/report.md", report.report("Systematic research", [("Signals", "", summary.orderBy("research_split", "signal")), ("Portfolios", "", table), ("Gates", "", gates.orderBy("check_name"))], {"passed": result["passed"]}))
    return result


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    args = parser().parse_args(argv)
    systematic = args.command.startswith("systematic")
    raw = files.load_config(args.config, ("project", "evaluation") if systematic else ("project",))
    source, out = str(raw["project"]["input"]), str(raw["project"]["output"])
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if args.command == "systematic-run":
        dates = {k: str(raw["evaluation"][k]) for k in ("design_end", "validation_end")}
        return systematic_run(spark, source, out, replace(research.Setup(), **dates))
    steps = {"download": download, "build": build, "analyze": analyze, "report": study_report, "systematic-download": systematic_download}
    return steps[args.command](spark, source, out)


if __name__ == "__main__":
    main()
