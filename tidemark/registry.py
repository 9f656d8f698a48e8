"""The registered queries and their SQL, and helpers that they share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded (own: digits of single columns), NaN as null, decimals as doubles."""
    kinds = dict(df.dtypes)
    return df.select(*((F.round(S.finite(F.col(c).cast("double")), own.get(c, digits)) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; in a folder of our own only where none is named, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/{uuid.uuid4().hex}"
