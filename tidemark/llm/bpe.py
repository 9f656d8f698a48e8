"""BPE encoding and decoding through a table of distinct words.

Documents are split into words (at ASCII white space) in blocks of bounded size.
A block keeps each document as numbers of its own distinct words, the most
frequent first, and deals those words out by hash. Each hash part brings the words
of all blocks together and encodes every distinct one once; the ids return to the
block, where they are joined by position. Decoding joins ids to pieces.

This holds for tokenizers whose tokens never span white space and which drop it,
as `word_bpe_49k` does; `check_tokenizer` refuses others.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import Workspace, parts, slices, squeeze, text_bytes, unsqueeze

BLOCK_BYTES = 32 << 20
_TABLE = "block long, part int, doc_id long, n int, data binary, blob binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("blob", pa.binary())])


#: Normalizers that give a word the same result alone as within its text.
WORD_NORMALIZERS = ("NFC", "NFD", "Lowercase")


def _keeps_words(step: dict[str, Any]) -> bool:
    """A normalizer that changes each word by itself, or only the white space between words."""
    if step.get("type") == "Sequence":
        return all(map(_keeps_words, step["normalizers"]))
    blanks = step.get("type") == "Replace" and step.get("pattern") == {"Regex": r"\s+"} and step.get("content") == " "
    return blanks or step.get("type") in WORD_NORMALIZERS


def check_tokenizer(path: str) -> None:
    """Raise ValueError unless words at white space can be encoded each on its own, and decoding joins pieces as they are (no decoder)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    split = [s for s in steps if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")]
    added = [t for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
    if spec.get("decoder"):
        raise ValueError("this tokenizer's decoder changes pieces as it joins them")
    if spec.get("normalizer") and not _keeps_words(spec["normalizer"]):
        raise ValueError("this tokenizer's normalizer doesn't treat words independently")
    if not split or added or spec.get("post_processor"):
        raise ValueError("this tokenizer doesn't encode words at white space independently")


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as four byte planes, the lowest first; upper planes are mostly zero and compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces [start, start + length) of buf, one after another."""
    total = np.cumsum(length)
    if not len(total) or not total[-1]:
        return buf[:0]
    return buf[np.repeat(start - (total - length), length) + np.arange(total[-1])]


def _pieces(numbers: np.ndarray, lengths: np.ndarray, blob: np.ndarray) -> bytes:
    """Ascending numbers, the lengths and the content of their variable pieces."""
    lists = _planes(np.diff(numbers, prepend=0)) + _planes(lengths)
    content = _planes(blob) if blob.dtype.itemsize == 4 else blob.tobytes()
    return squeeze(np.uint32(len(lengths)).tobytes() + lists + content)


def _unpieces(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    data = unsqueeze(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.cumsum(_unplanes(data[4 : 4 + 4 * n]).astype(np.int64)), _unplanes(data[4 + 4 * n : 4 + 8 * n]).astype(np.int64), data[4 + 8 * n :]


class _Block:
    """Documents of a block and its distinct words while it is read."""

    def __init__(self) -> None:
        self.docs: list[tuple[pa.Array, np.ndarray]] = []
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.blobs: list[np.ndarray] = []
        self.local: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, buf: np.ndarray, offs: np.ndarray) -> None:
        w = T.Words(buf, offs, T.PLAIN)
        keys, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        length = (w.end - w.start)[first]
        self.keys.append(keys)
        self.lengths.append(length)
        self.blobs.append(gather(buf, w.start[first], length))
        self.local.append(back.astype(np.uint32))
        self.docs.append((ids, w.rows))
        self.size += len(buf)

    def rows(self, block: int, n_parts: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(self.keys)
        keys, first, back = np.unique(every, return_index=True, return_inverse=True)
        # numbers of words: the most frequent first
        times = np.zeros(len(keys), np.int64)
        at, maps = 0, []
        for k, local in zip(self.keys, self.local, strict=True):
            m = back[at : at + len(k)]
            np.add.at(times, m, np.bincount(local, minlength=len(k)))
            maps.append(m)
            at += len(k)
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(keys), np.int64)
        number[order] = np.arange(len(keys))
        for (ids, rows), local, m in zip(self.docs, self.local, maps, strict=True):
            x = number[m][local] if len(m) else np.zeros(0, np.int64)
            data = [_planes(x[a:z]) for a, z in zip(rows[:-1], rows[1:], strict=True)]
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids)), none.cast(pa.int32()), ids.cast(pa.int64()), pa.array(np.diff(rows), pa.int32()), pa.array(data, pa.binary()), none.cast(pa.binary())], schema=_SCHEMA)
        length = np.concatenate(self.lengths)
        start = np.cumsum(length) - length
        blob = np.concatenate(self.blobs)
        part = (keys % T.U(n_parts)).astype(np.int64)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            mine = mine[np.argsort(number[mine])]
            f = first[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([p], pa.int32()), pa.array([None], pa.int64()), pa.array([len(mine)], pa.int32()), pa.nulls(1, pa.binary()), pa.array([_pieces(number[mine], length[f], gather(blob, start[f], length[f]))], pa.binary())], schema=_SCHEMA
            )


def blocks(docs: DataFrame, n_parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) as blocks: a row for each document (numbers of its words) and, for each hash part, one with the block's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held = 0, _Block()
        pid = TaskContext.get().partitionId()
        for b in slices(batches, "text"):
            held.add(b.column("doc_id"), *T.packed(b.column("text")))
            if held.size >= block_bytes:
                yield from held.rows((pid << 24) + k, n_parts)
                k, held = k + 1, _Block()
        if held.docs:
            yield from held.rows((pid << 24) + k, n_parts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TABLE)


def load(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def encode_words(words: DataFrame, file: str) -> DataFrame:
    """For each hash part, encode every distinct word once: block, blob (word numbers and their ids)."""

    def run(table: pa.Table) -> pa.Table:
        tokenizer = load(SparkFiles.get(file))
        known: dict[bytes, int] = {}
        slots, numbers = [], []
        for blob in table["blob"]:
            number, lengths, raw = _unpieces(blob.as_py())
            numbers.append(number)
            ends = np.cumsum(lengths)
            slots.append(np.fromiter((known.setdefault(raw[a:z], len(known)) for a, z in zip((ends - lengths).tolist(), ends.tolist(), strict=True)), np.int64, len(lengths)))
        words = list(known)
        ids: list[list[int]] = []
        for k in range(0, len(words), 4096):
            ids += [e.ids for e in tokenizer.encode_batch_fast([x.decode() for x in words[k : k + 4096]], add_special_tokens=False)]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), "<u4", int(n.sum()))
        start = np.cumsum(n) - n
        out = [_pieces(number, n[s], gather(flat, start[s], n[s])) for number, s in zip(numbers, slots, strict=True)]
        return pa.table({"block": table["block"], "blob": pa.array(out, pa.binary())})

    return words.groupBy("part").applyInArrow(run, "block long, blob binary")


def _join_back(file: str):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        tokenizer = load(SparkFiles.get(file))
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        piece = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            piece[i] = token.encode()
        numbers, lengths, flats = [], [], []
        for blob in words["blob"]:
            x, n, raw = _unpieces(blob.as_py())
            numbers.append(x)
            lengths.append(n)
            flats.append(_unplanes(raw))
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        length, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        ids = np.concatenate(flats) if flats else np.zeros(0, "<u4")
        if numbers:
            n = np.concatenate(lengths)
            length[number], start[number] = n, np.cumsum(n) - n
        decoded = [b" ".join([piece[i] for i in ids[s : s + n].tolist()]) for s, n in zip(start.tolist(), length.tolist(), strict=True)]
        none = bool((length == 0).any())
        counts, shas, texts = [], [], []
        for data in docs["data"]:
            x = _unplanes(data.as_buffer())
            own = gather(ids, start[x], length[x])
            counts.append(len(own))
            shas.append(hashlib.sha256(own.tobytes()).hexdigest())
            if none:
                x = x[length[x] > 0]
            texts.append(hashlib.sha256(b" ".join(map(decoded.__getitem__, x.tolist()))).hexdigest())
        return pa.table({"doc_id": docs["doc_id"], "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(texts, pa.string())})

    return run


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode and decode each row's whole text; only doc_id and text are read.

    doc_id, n_tokens, ids_sha256, decoded_sha256. A null text is empty: no ids, and
    an empty decoded text. Repeated rows are encoded each. `tokenizer` is the path
    of the tokenizer's file, which is sent to the executors.
    """
    check_tokenizer(tokenizer)
    spark.sparkContext.addFile(tokenizer)
    ws, file = Workspace(spark), os.path.basename(tokenizer)
    src = docs.select("doc_id", F.col(text).alias("text"))
    n = parts(spark, text_bytes(src))
    table = ws.bucket(blocks(src, n, block_bytes), "block", n)
    ids = encode_words(table.where("part is not null").select("part", "block", "blob"), file)
    rows = table.where("part is null").select("block", "doc_id", "data")
    out = rows.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_join_back(file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return ws.close(out)
