"""Typed scans, deterministic sinks, strict JSON, manifests and content digests."""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Callable, Iterable
from datetime import date, datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header and explicit types, so that codes keep their zeros."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document or array for each file; with a schema, a record for each line, read in parallel."""
    return spark.read.schema(schema).json(path) if schema else spark.read.option("multiLine", True).json(path)


def load_config(path: str, sections: Iterable[str] = ()) -> dict[str, Any]:
    """A YAML mapping that has the required sections."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError("the configuration isn't a mapping")
    missing = [s for s in sections if s not in data]
    if missing:
        raise ValueError(f"the configuration lacks sections: {missing}")
    return data


def write_frame(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """Parquet or CSV by suffix. With `order`, one sorted file: for small exports only."""
    suffix = os.path.splitext(path)[1]
    if suffix not in (".parquet", ".csv"):
        raise ValueError(f"no writer for {suffix or 'a path without suffix'}")
    out = df.coalesce(1).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("header", True).format(suffix[1:]).save(path)


def json_ready(value: Any) -> Any:
    """The value with dates as ISO text and NaN and infinities as null, all the way down."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if hasattr(value, "item"):
        return json_ready(value.item())
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _replace(path: str, text: str) -> None:
    """Written beside and renamed, so that readers never see half a file."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    tmp = f"{path}.tmp"
    Path(tmp).write_text(text, encoding="utf-8")
    os.replace(tmp, path)


def write_text(path: str, text: str) -> None:
    _replace(path, text)


def write_json(path: str, value: Any) -> None:
    _replace(path, json.dumps(json_ready(value), indent=2, sort_keys=True, allow_nan=False) + "\n")


def write_manifest(path: str, records: dict[str, dict[str, Any]], merge: bool = True) -> None:
    """Records by key; with `merge`, others stay."""
    old = json.loads(Path(path).read_text()) if merge and os.path.exists(path) else {}
    write_json(path, {**old, **records})


def update_manifest(path: str, key: str, record: dict[str, Any]) -> None:
    """One record, stamped with the time unless it has one."""
    write_manifest(path, {key: {"retrieved_at_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), **record}})


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, digest. SHA-256 that depends on names, types and rows, not on the order of rows or columns.

    Rows are hashed, sums of the hashes' four parts (and the count of rows) hashed
    again: no sort, no collected list, and repeated rows count.
    """
    cols = sorted(df.columns)
    head = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in cols)
    # every value follows its length, so that no two rows give one text
    values = [F.col(c).cast("string") for c in cols]
    text = F.concat(*(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values))
    sha = F.sha2(text, 256)
    summed = df.select(sha.alias("s")).select(*(F.conv(F.substring("s", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(5)))
    out = summed.agg(F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("string").alias(f"p{k}") for k in range(5)))
    return out.select("rows", F.sha2(F.concat_ws("|", F.lit(head), F.col("rows").cast("string"), *(F.col(f"p{k}") for k in range(5))), 256).alias("digest"))


def source_record(df: DataFrame, provider: str, parameters: dict[str, Any]) -> dict[str, Any]:
    d = content_digest(df).first()
    return {"provider": provider, "rows": d["rows"], "columns": df.columns, "sha256": d["digest"], "parameters": json_ready(parameters)}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files (by name) of `expected` (name, sha256) with ok: there, and unchanged."""
    found = file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return expected.join(found, "name", "left").withColumn("ok", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)))


def markdown_table(df: DataFrame, columns: Iterable[str] | None = None, most: int = 1000) -> str:
    """A small frame as Markdown; raises above `most` rows instead of cutting."""
    cols = list(columns or df.columns)
    rows = df.select(*cols).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    show = [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(r) + " |" for r in show)])


def with_retries(call: Callable[[], Any], kind: type, attempts: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The call's result, of the wanted type; failures wait backoff, 2 * backoff, and so on."""
    if attempts < 1:
        raise ValueError("attempts must be positive")
    for k in range(attempts):
        try:
            out = call()
            if not isinstance(out, kind):
                raise TypeError(f"the provider gave {type(out).__name__}, not {kind.__name__}")
            return out
        except Exception:
            if k == attempts - 1:
                raise
            sleep(backoff * 2**k)
    raise AssertionError
