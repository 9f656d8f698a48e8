"""Secret scans with corpus-wide ownership frequency.

Each text gives candidate spans. A candidate's value is hashed, and the corpus
tells how many repositories (documents) and owners (sources) hold it: a value
that three owners or fifty repositories share is widely copied, an example; one
that belongs to an owner or two and few of their repositories, and looks random,
is a live credential. Base kinds (assign,
access, hex) stay as they are found; the generic kind is added only for
owner-specific, live-looking values.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from .common import Workspace, slices
from .text import packed

# The base patterns, and their kinds in the order in which spans are listed.
KINDS = ("assign", "access", "hex", "generic")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key", re.I)
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: A value of at least so many owners is a copied example.
EXAMPLE_OWNERS = 3
#: So is one of at least so many repositories, whoever owns them.
EXAMPLE_REPOS = 50
MIN_GENERIC, MIN_ENTROPY = 20, 3.5
#: Tasks among which the rows of one value are spread.
SALTS = 16

SPAN = st.StructType([st.StructField("kind", st.IntegerType()), st.StructField("start", st.IntegerType()), st.StructField("end", st.IntegerType()), st.StructField("value", st.BinaryType()), st.StructField("live", st.BooleanType())])
SPANS = st.ArrayType(SPAN)
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())]))

_HEX, _GENERIC, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.array([b & 0xC0 != 0x80 for b in range(256)])
_HEX[list(b"0123456789abcdef")] = True
_GENERIC[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_UPPER_NUM = np.zeros(256, bool)
_UPPER_NUM[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


def entropy(value: bytes) -> float:
    """Bits for each byte."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: bytes) -> bool:
    """Random enough for a real credential: varied bytes, two classes of characters, no placeholder."""
    classes = bool(re.search(rb"[a-z]", value)) + bool(re.search(rb"[A-Z]", value)) + bool(re.search(rb"[0-9]", value))
    return classes >= 2 and entropy(value) >= 2.5 and not re.search(rb"example|changeme|placeholder|xxxx|your[_-]", value, re.I)


def _runs(flags: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of flagged bytes within rows, of `least` bytes or more."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], flags[:-1]]) & ~edge[:-1]
    after = np.concatenate([flags[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    long = end - start >= least
    return start[long], end[long]


def find(buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int, bytes]]]:
    """For each row (kind, start, end, value) in order of start, then kind; in code points."""
    rows: list[list[tuple[int, int, int, bytes]]] = [[] for _ in range(len(offs) - 1)]
    whole = buf.tobytes()
    if not whole:
        return rows
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LEAD[buf], out=points[1:])

    def put(kind: int, s: int, e: int, value: bytes) -> None:
        r = int(np.searchsorted(offs, s, side="right")) - 1
        base = points[offs[r]]
        rows[r].append((kind, int(points[s] - base), int(points[e] - base), value))

    taken = np.zeros(len(buf) + 1, np.int64)
    # keywords first show which rows the pattern has to read
    hit = np.unique(np.searchsorted(offs, [m.start() for m in KEYWORD.finditer(whole)], side="right") - 1).astype(int)
    for r in hit.tolist():
        s0 = int(offs[r])
        text = whole[s0 : int(offs[r + 1])].decode("utf-8", "replace")
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                rows[r].append((0, m.start(), m.end(), m[2].encode()))
                s = s0 + len(text[: m.start()].encode())
                taken[s] += 1
                taken[s + len(m[0].encode())] -= 1
    spans = []
    start, end = _runs(_UPPER_NUM[buf], offs, MIN_ACCESS)
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        k = whole.find(b"AKIA", s, e)
        if k >= 0 and e - k >= MIN_ACCESS:
            spans.append((1, k, e))
    start, end = _runs(_HEX[buf], offs, MIN_HEX)
    spans += [(2, s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    for kind, s, e in spans:
        put(kind, s, e, whole[s:e])
        taken[s] += 1
        taken[e] -= 1
    used = np.cumsum(taken)[:-1] > 0
    start, end = _runs(_GENERIC[buf] & ~used, offs, MIN_GENERIC)
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        v = whole[s:e]
        if re.search(rb"[a-z]", v) and re.search(rb"[A-Z]", v) and re.search(rb"[0-9]", v) and entropy(v) >= MIN_ENTROPY:
            put(3, s, e, v)
    for x in rows:
        x.sort(key=lambda t: (t[1], t[0]))
    return rows


def scan(docs: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """The columns of `docs`, and `spans`: array of kind, start, end, value (hash), live (looks so). Null texts have none."""
    names = [c for c in docs.columns if carry_text or c != text]
    out = st.StructType([*(docs.schema[n] for n in names), st.StructField("spans", SPANS, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", source=text if carry_text else None):
            found = find(*packed(b.column("__text")))
            spans = [[{"kind": k, "start": s, "end": e, "value": hashlib.blake2b(v, digest_size=16).digest(), "live": looks_live(v)} for k, s, e, v in row] for row in found]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(spans, _ARROW)], names=[*names, "spans"])

    return (docs.select(*names) if carry_text else docs.select(*names, F.col(text).alias("__text"))).mapInArrow(run, out)


def ownership(spans: DataFrame, repo: str, owner: str) -> DataFrame:
    """value, n_repos, n_owners: distinct repositories and owners of each hash. Counts first add up for each owner, so that no common value gathers its rows."""
    each = spans.groupBy("value", repo, owner).agg(F.lit(1).alias("one"))
    return each.groupBy("value", owner).agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(ws: Workspace, docs: DataFrame, text: str, repo: str, owner: str, example_owners: int, example_repos: int, carry_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with __rid and spans, with or without their text; and for each __rid its `live` and `examples` spans."""
    scanned = ws.write(scan(docs.withColumn("__rid", F.monotonically_increasing_id()), text, carry_text), "spans")
    each = scanned.where(F.size("spans") > 0).select("__rid", F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.explode("spans").alias("s")).select("*", F.col("s.value").alias("value"))
    # a value that is copied everywhere doesn't gather its rows in one task; there are few distinct values
    salted = each.withColumn("salt", F.pmod(F.xxhash64("__rid"), F.lit(SALTS)))
    stats = ownership(each, "repo", "owner").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    known = salted.join(stats, ["value", "salt"], "left")
    shared = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    per_row = known.groupBy("__rid").agg(
        F.array_sort(F.collect_list(F.when(~shared & F.col("s.live"), F.struct("s.start", "s.kind", "s.end")))).alias("live"),
        F.array_sort(F.collect_list(F.when(shared, F.struct("s.start", "s.kind", "s.end")))).alias("examples"),
    )
    return scanned, per_row


def count_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(spark: SparkSession, docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row for each row of `docs`; its columns besides id, text and owner are not read.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.
    A null or empty text has no spans. Null owners count as one owner, null
    repositories as one repository. Repeated rows are reported each. An empty table
    gives no rows.
    """
    ws = Workspace(spark)
    src = docs.select(F.col(repo).alias("doc_id"), F.col(owner).alias("owner"), F.col(text).alias("text"))
    scanned, per_row = judged(ws, src, "text", "doc_id", "owner", example_owners, example_repos, carry_text=False)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    base = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    live, examples = F.coalesce("live", none), F.coalesce("examples", none)
    out = scanned.join(per_row, "__rid", "left")
    added = F.filter(live, lambda s: s["kind"] == 3)
    return ws.close(
        out.select(
            "doc_id",
            *(count_of(k).alias(f"n_{KINDS[k]}") for k in range(3)),
            F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
            listed(F.array_sort(F.concat(base, added))).alias("spans"),
            F.size(live).cast("long").alias("n_live"),
            F.size(examples).cast("long").alias("n_examples"),
        )
    )


def redact(spark: SparkSession, docs: DataFrame, mask: str = "[secret]", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """`docs` (doc_id, text, source) with live credentials in `text` replaced by `mask`; rows without any are as before, and every row stays.

    n_chars follows where it is a column; a null text stays null. Null owners count
    as one, as do null ids. Repeated rows are masked each, and count as one
    repository. An empty table gives no rows.
    """
    ws = Workspace(spark)
    # columns travel under names that can't clash with the spans
    fixed = {"doc_id": "doc_id", "text": "text", "source": "source"}
    aliases = {c: fixed.get(c, f"__{k}") for k, c in enumerate(docs.columns)}
    plain = docs.withColumnsRenamed(aliases)
    scanned, per_row = judged(ws, plain, "text", "doc_id", "source", example_owners, example_repos)
    dirty = scanned.where(F.size("spans") > 0).join(per_row.select("__rid", "live"), "__rid", "left")
    schema, names, count = plain.schema, plain.columns, aliases.get("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, changed = b.column("text").to_pylist(), []
            for i, live in enumerate(b.column("live").to_pylist()):
                if not live:
                    continue
                parts, at = [], 0
                for s in sorted(live, key=lambda s: s["start"]):
                    if s["start"] >= at:
                        parts += [texts[i][at : s["start"]], mask]
                    at = max(at, s["end"])
                texts[i] = "".join(parts) + texts[i][at:]
                changed.append(i)
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, b.schema.field("text").type))
            if count:
                n = b.column(count).to_pylist()
                for i in changed:
                    n[i] = len(texts[i])
                b = b.set_column(b.schema.get_field_index(count), count, pa.array(n, b.schema.field(count).type))
            yield b.select(names)

    clean = scanned.where(F.size("spans") == 0).select(*names)
    out = clean.unionByName(dirty.select(*names, "live").mapInArrow(run, schema))
    # the scanned rows stay until the caller has read them: no second copy is written
    return out.select(*(F.col(v).alias(c) for c, v in aliases.items()))
