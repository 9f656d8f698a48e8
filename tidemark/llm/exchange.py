"""Blocks of documents and packed questions between blocks and hash parts.

Operators that look for equal passages read documents in blocks of bounded size.
A block asks each hash part about its distinct keys in one packed row, and the part
answers each block in one; a key that a third of all documents hold costs one
entry for each block. The table of blocks is bucketed, so that joining answers to
their blocks doesn't move text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

from .common import Workspace, slices, squeeze, unsqueeze

BLOCK_BYTES = 8 << 20
#: Stands for a missing doc_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max
PACKED = "part int, block long, kind int, blob binary"
_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, which compress well where upper bytes repeat."""
    out = [np.uint32(len(arrays[0])).tobytes()]
    for a in arrays:
        out.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return squeeze(b"".join(out))


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    blob = unsqueeze(blob)
    n, at, out = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
    for t in dtypes:
        size = np.dtype(t).itemsize * n
        planes = np.frombuffer(blob, np.uint8, size, at).reshape(-1, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel() if n else np.zeros(0, t))
        at += size
    return out


def blocked(ws: Workspace, docs: DataFrame, block_bytes: int = BLOCK_BYTES, n: int | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text) as a table bucketed by block: block, seq, doc_id, text (binary; null texts are empty), and the columns of `carried`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seq, size = TaskContext.get().partitionId() << 28, 0, 0
        for b in slices(batches, "text", max(1, block_bytes // 4)):
            if size >= block_bytes:
                block, size = block + 1, 0
            size += b.column("text").nbytes
            columns = [pa.array([block] * b.num_rows, pa.int64()), pa.array(np.arange(seq, seq + b.num_rows), pa.int64()), b.column("doc_id"), b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(b.column(c) for c in carried)], names=["block", "seq", "doc_id", "text", *carried])
            seq += b.num_rows

    src = docs.select(F.col("doc_id").cast("long"), "text", *carried)
    schema = st.StructType([*(st.StructField(c, st.LongType()) for c in ("block", "seq", "doc_id")), st.StructField("text", st.BinaryType()), *(src.schema[c] for c in carried)])
    return ws.bucket(src.mapInArrow(run, schema), "block", n)


class Documents:
    """The documents of a block in their order."""

    def __init__(self, table: pa.Table):
        table = table.select(["block", "seq", "doc_id", "text"]).sort_by("seq").combine_chunks()
        self.block = table["block"][0].as_py() if table.num_rows else -1
        self.ids = table["doc_id"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.doc = np.array([NO_ID if i is None else i for i in self.ids.to_pylist()], np.int64)
        text = table["text"].combine_chunks().cast(pa.large_binary()) if table.num_rows else pa.array([], pa.large_binary())
        from .text import packed

        self.buf, self.offs = packed(text)


def deal(block: int, kind: int, key: np.ndarray, n_parts: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Packed rows of arrays for the part of each key; the order within a part is kept."""
    part = (key % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        mine = order[a:z]
        yield int(part[mine[0]]), block, kind, pack(*(x[mine] for x in arrays))


def packed_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _PACKED.types, strict=True)], schema=_PACKED)


def collected(answers: pa.Table, kind: int, key: np.ndarray, n_parts: int, *dtypes: str) -> list[np.ndarray]:
    """Answers of a kind, put back into the order of the keys that `deal` dealt."""
    part = (key % np.uint64(n_parts)).astype(np.int64)
    out = [np.zeros(len(key), t) for t in dtypes]
    order = np.argsort(part, kind="stable")
    first = dict(zip(*np.unique(part[order], return_index=True), strict=True)) if len(key) else {}
    for p, k, blob in zip(answers["part"].to_pylist(), answers["kind"].to_pylist(), answers["blob"].to_pylist(), strict=True):
        if k == kind:
            got = unpack(blob, *dtypes)
            at = order[first[p] : first[p] + len(got[0])]
            for o, g in zip(out, got, strict=True):
                o[at] = g
    return out


def ask(questions: DataFrame, serve: Callable[[list[tuple[int, int, bytes]]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Each part sees all its packed questions (block, kind, blob) and gives answers of the same form."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        rows = list(zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True))
        return packed_table([(part, *r) for r in serve(rows)])

    return questions.groupBy("part").applyInArrow(run, PACKED)


def ask_streamed(questions: DataFrame, serve: Callable[[Iterator[tuple[int, int, bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """As `ask`, for parts whose questions don't fit in memory: they come, and answers go, a few at a time."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        rows = ((block.as_py(), kind.as_py(), blob.as_py()) for b in batches for block, kind, blob in zip(b.column("block"), b.column("kind"), b.column("blob"), strict=True))
        for r in serve(rows):
            yield from packed_table([(part, *r)]).to_batches()

    return questions.groupBy("part").applyInArrow(run, PACKED)


def per_block(blocks: DataFrame, answers: DataFrame | None, run: Callable[[Documents, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(documents, answers) for each block."""
    if answers is None:
        return blocks.groupBy("block").applyInArrow(lambda t: run(Documents(t), packed_table([])), schema)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: run(Documents(t), a), schema)
