"""Source tables of a research project: primary and fallback prices, filings and members, with a manifest."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..sources import connectors, files


def collect_assets(folder: str, wanted: DataFrame, primary: DataFrame, fallback: Callable[[DataFrame], DataFrame], filings: DataFrame, members: DataFrame, parameters: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Write market, fundamentals and membership tables below `folder`, and their records to its manifest; gives the records.

    Symbols that the primary provider lacks are asked of the fallback; those that
    neither has are an error, and nothing is written. The manifest is a small file
    of the driver; tables go through Spark's writers.
    """
    prices = connectors.with_fallback(wanted, primary, fallback)
    records = {}
    for name, df in (("market_daily", prices), ("fundamentals_pit", filings), ("membership", members)):
        path = f"{folder}/{name}.parquet"
        files.write_frame(df, path)
        records[name] = files.source_record(files.read_parquet(df.sparkSession, path, df.schema), name, parameters) | {"path": f"{name}.parquet"}
    files.write_manifest(f"{folder}/manifest.json", records)
    return records
