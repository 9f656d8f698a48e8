"""Shared folders, written tables and Arrow batch helpers of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step takes at a time; its arrays take some hundred times as much.
SLICE_BYTES = 1 << 20
#: Text bytes for each part of a shuffle, so that a part's memory doesn't grow with the input.
PART_BYTES = 16 << 20
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own only in local mode, where none is named; on a cluster its absence is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own_dir[0]


_zstd = pa.Codec("zstd", 1)


def squeeze(data: bytes) -> bytes:
    """Compressed bytes after their own length; shuffles then move less."""
    return len(data).to_bytes(8, "little") + _zstd.compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return _zstd.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of a text column."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("n")).first()["n"])


def parts(spark: SparkSession, size: int = 0) -> int:
    """Parts for a shuffle of `size` bytes of text, or the buckets of a table: as many as Spark's partitions, more where the input asks for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


_scopes: list[list[Workspace]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """What the workspaces opened inside have written, results and catalog entries too, goes at the end; frames made inside must have been written elsewhere by then."""
    opened: list[Workspace] = []
    _scopes.append(opened)
    try:
        yield
    finally:
        _scopes.pop()
        for ws in opened:
            ws.clear()


class Workspace:
    """Tables that one operator writes to the shared folder, which cut lineage and survive lost executors.

    `write` gives back what it wrote; `bucket` writes a table that later joins on
    its key without moving it again; `drop` deletes what was written under a name, `release`
    the bucketed tables, `close` all but the result, which stays in
    `<shared folder>/llm` until `clear_results`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
        self.tables: list[str] = []
        for scope in _scopes:
            scope.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucket(self, df: DataFrame, key: str, n: int | None = None) -> DataFrame:
        name = f"llm_{uuid.uuid4().hex}"
        self.tables.append(name)
        # below the shared folder: the default warehouse is a folder of the driver
        df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(n or parts(self.spark), key).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def release(self, tables: Sequence[str] | None = None) -> None:
        """Delete these of the tables that `bucket` wrote, or all."""
        for t in list(self.tables if tables is None else tables):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            delete(self.spark, f"{self.root}/{t}")
            self.tables.remove(t)

    def clear(self) -> None:
        """Delete all that was written, the result too."""
        self.release()
        delete(self.spark, self.root)
        delete(self.spark, f"{self.root}-result")

    def close(self, result: DataFrame) -> DataFrame:
        """Write the result, then drop every table it was made from."""
        path = f"{self.root}-result"
        result.write.option("compression", "zstd").parquet(path)
        self.release()
        delete(self.spark, self.root)
        return self.spark.read.schema(result.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_results(spark: SparkSession) -> None:
    """Delete the results of all calls that used this shared folder, and their tables in the catalog; frames that read them end."""
    for t in spark.catalog.listTables(pattern="llm_*"):
        if re.fullmatch("llm_[0-9a-f]{32}", t.name):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    delete(spark, f"{shared_dir(spark)}/llm")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, source: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `most` bytes of `column`, one row at least; null texts become empty. With `source`, the column is made beside that one, which stays as it is."""
    for b in batches:
        if not b.num_rows:
            continue
        if source:
            b = b.append_column(column, b.column(source))
        k = b.schema.get_field_index(column)
        text = b.column(k)
        if text.null_count:
            text = pc.fill_null(text, b"" if pa.types.is_binary(text.type) else "")
        b = b.set_column(k, pa.field(column, pa.large_binary()), text.cast(pa.large_binary()))
        size = pc.binary_length(b.column(k)).to_numpy(zero_copy_only=False)
        at = total = 0
        for i, n in enumerate(size.tolist()):
            if i > at and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        yield b.slice(at)
