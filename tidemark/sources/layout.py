"""The market table as it should lie in a store: bucketed by symbol, each bucket sorted by symbol and date.

All windows over a symbol then read their bucket as it lies: no bar is moved by
rolling features, however many of them there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a bucket that one task sorts and holds windows of.
BUCKET_BYTES = 256 << 20


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets for so many bytes of bars, at least Spark's number of shuffle partitions. Buckets beyond the number of symbols stay empty."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def store_by_symbol(df: DataFrame, path: str, name: str | None = None, symbol: str = "symbol", day: str = "date", size: int = 0, buckets: int | None = None) -> DataFrame:
    """Write the table below `path`, as `name` (one of its own by default) in the catalog, and give it back as it is read.

    One file for each bucket: rows are brought together by symbol once, when the
    table is stored. `size`, the table's bytes where the caller knows them, or
    `buckets` sets their number. A table of that name is replaced.
    """
    spark = df.sparkSession
    n, name = buckets or buckets_for(spark, size), name or f"market_{uuid.uuid4().hex}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(n, symbol).write.mode("overwrite").format("parquet").option("path", path).bucketBy(n, symbol).sortBy(symbol, day).saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession, name: str, path: str) -> None:
    """Take the table out of the catalog and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
