"""Contracts on inputs. Checks on columns run no job; checks on rows run one aggregate each."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str], label: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {missing}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str], label: str) -> str:
    """The first candidate that is a column."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"{label}: none of {list(candidates)} is a column")


def rename_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """aliases: canonical name -> other name, used where the canonical one is missing."""
    return df.withColumnsRenamed({other: name for name, other in aliases.items() if name not in df.columns and other in df.columns})


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    if duplicates(df, keys).limit(1).count():
        raise ValueError(f"{label} repeats the key {list(keys)}")
    return df


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows break each rule (a condition that should hold; null counts as holding)."""
    return df.agg(*(F.count_if(~rule).alias(name) for name, rule in rules.items()))


def require_domain(df: DataFrame, rules: Mapping[str, Column], label: str) -> DataFrame:
    found = violations(df, rules).first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ValueError(f"{label} breaks rules: {broken}")
    return df


def point_in_time(tables: Mapping[str, tuple[DataFrame, str]], cutoff: str) -> DataFrame:
    """table, latest, ok: the latest date of each table against the cutoff."""
    out = None
    for name, (df, day) in tables.items():
        one = df.agg(F.max(F.col(day).cast("date")).alias("latest")).select(F.lit(name).alias("table_name"), "latest")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", F.coalesce(F.col("latest") <= F.lit(cutoff).cast("date"), F.lit(True)))


def require_point_in_time(tables: Mapping[str, tuple[DataFrame, str]], cutoff: str) -> None:
    late = [r.table_name for r in point_in_time(tables, cutoff).where("not ok").collect()]
    if late:
        raise ValueError(f"dates after {cutoff} in: {', '.join(late)}")
