"""N-gram Jaccard join with a token-group matrix.

Texts with equal shingle sets form a class. Blocks of documents ask, for each of
their shingles (tokens), in how many classes it occurs; a class of which fewer than
three quarters of the tokens occur elsewhere can have no link, and is done. The
others keep their shared tokens, the rarest first.

Classes that share minimum hashes with a central leader, and are verified to be
similar to it, form groups of similar documents. The token-group matrix holds for
each token the groups whose token union has it, and is dealt by token. A query sends
its rarest tokens there: so many that `need` of them at least lie in any similar set,
and so in the union of that set's group. Summing a query's matches for each group
bounds their overlap; groups below the bound are never opened. In an opened group the
query's overlap with every member is counted through an index of their tokens; as a
group is connected already, one link joins them. Linked classes and groups give
components. Every comparison that decides is made on 64-bit shingle hashes; the
counts of occurrences and the matrix hold shorter ones, which can only let more
through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T
from .common import Workspace, parts, text_bytes
from .components import connected

SHINGLE = 5
#: Similar: TIMES * intersection >= LEAST * union.
LEAST, TIMES = 75, 100
HASHES, SHARED = 12, 5
#: Bytes of text in a block; its shingles take some thirty times as much memory.
BLOCK_BYTES = 4 << 20
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, HASHES, dtype=np.uint64)
#: Classes that ask about one token in one part, roughly: more common tokens are dealt to several parts.
TOKEN_ROWS = 1 << 12
#: Tokens of a batch of the matrix.
MATRIX_TOKENS = 1 << 20
#: Pairs of queries and groups, and groups, in one task, roughly.
QUERY_WORK, GROUP_WORK = 1 << 17, 1 << 12
#: Queries of one leader in one task.
QUERIES = 4096
#: Sets of queries, and of members, that one comparison holds, roughly.
SETS = 1 << 14

_SIGNED = np.int64


def shingle_sets(d: X.Documents, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each document in order: shorter texts are one shingle, texts without words none."""
    w = T.Words(d.buf, d.offs, T.LOWER)
    grams = T.rolling(w.hash, shingle)
    for a, z in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if z - a >= shingle:
            yield np.unique(grams[a : z - shingle + 1])
        elif z > a:
            yield T.rolling(w.hash[a:z], z - a) + T.U(z - a)
        else:
            yield np.zeros(0, T.U)


def class_of(s: np.ndarray) -> int:
    """Key of a set that isn't empty, whatever its order."""
    return int(T.mix(np.cumsum(T.mix(s))[-1:] ^ T.mix(np.array([len(s)], T.U))).view(_SIGNED)[0])


def least_common(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n shares at least with any similar set."""
    return -(-LEAST * n // TIMES)


def probes(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens of a set of n that look for groups: all that a similar set can lack, and some more."""
    return np.minimum(n, n - least_common(n) + np.maximum(1, n // 8))


def need(n: np.ndarray | int) -> np.ndarray | int:
    """How many of these lie in any similar set at least."""
    return probes(n) - (n - least_common(n))


def _classed(shingle: int):
    def run(d: X.Documents, _: pa.Table) -> pa.Table:
        """Size and class of each document's set."""
        sets = list(shingle_sets(d, shingle))
        m = len(sets)
        cls = [class_of(s) if len(s) else None for s in sets]
        return pa.table({"doc_id": d.ids, "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array(cls, pa.int64()), "block": pa.array([d.block] * m, pa.int64()), "idx": pa.array(range(m), pa.int64())})

    return run


_CLASSED = "doc_id long, n long, cls long, block long, idx long"


def _at_home(d: X.Documents, rows: pa.Table, shingle: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Class and set of the classes that are at home in the block; and all their tokens."""
    mine = {i: c for i, c in zip(rows["idx"].to_pylist(), rows["cls"].to_pylist(), strict=True) if i is not None}
    sets = [(mine[k], s) for k, s in enumerate(shingle_sets(d, shingle)) if k in mine] if mine else []
    return sets, np.concatenate([s for _, s in sets]) if sets else np.zeros(0, T.U)


def _range_of(keys: np.ndarray, bits: int, n_parts: int) -> np.ndarray:
    """The part of each key of some bits: equal ranges, so that neighbours lie close."""
    return ((keys >> T.U(bits - 32)) * T.U(n_parts) >> T.U(32)).astype(np.int64)


def _ask_tokens(shingle: int, bits: int, n_parts: int):
    def run(d: X.Documents, home: pa.Table) -> pa.Table:
        """For each part the block's distinct tokens (differences of ascending keys), and of how many of its classes each is one."""
        _, tokens = _at_home(d, home, shingle)
        keys, times = np.unique(tokens >> T.U(64 - bits), return_counts=True)
        part = _range_of(keys, bits, n_parts)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys))
        return X.packed_table([(int(part[a]), d.block, 0, X.pack(np.diff(keys[a:z], prepend=T.U(0)), np.minimum(times[a:z], 255).astype("u1"))) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])

    return run


def _serve_tokens(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """The level of each token asked about: 0 if one class has it, else the logarithm of how many have."""
    got = [X.unpack(b, "u8", "u1") for _, _, b in rows]
    keys, times = np.concatenate([np.cumsum(k) for k, _ in got]), np.concatenate([t for _, t in got])
    order = np.argsort(keys, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    total = np.add.reduceat(times[order].astype(np.int64), head)
    level = np.empty(len(keys), "u1")
    level[order] = np.repeat(np.floor(np.log2(total)).astype("u1"), np.diff(np.append(head, len(order))))
    cuts = np.cumsum([0, *(len(k) for k, _ in got)])
    return [(r[0], 1, X.pack(level[a:z])) for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True)]


_CANDIDATE = "cls long, n long, probes long, hashes array<long>, tokens binary, levels binary"


def _candidates(shingle: int, bits: int):
    def run(d: X.Documents, rows: pa.Table) -> pa.Table:
        """The classes of which enough tokens occur in others: size, how many tokens look for groups, minimum hashes, and the shared tokens with their levels, the rarest first."""
        sets, tokens = _at_home(d, rows, shingle)
        keys = np.unique(tokens >> T.U(64 - bits))
        answers = sorted((p, b) for p, b in zip(rows["part"].to_pylist(), rows["blob"].to_pylist(), strict=True) if b is not None)
        level = np.concatenate([X.unpack(b, "u1")[0] for _, b in answers]) if answers else np.zeros(0, "u1")
        out = []
        for c, s in sets:
            own, n = level[np.searchsorted(keys, s >> T.U(64 - bits))], len(s)
            shared = own > 0
            m = int(shared.sum())
            if TIMES * m < LEAST * n:
                continue
            t, own = s[shared], own[shared]
            order = np.argsort(own, kind="stable")  # sets are in order of hash, so all sets rank tokens alike
            t, own = t[order], own[order]
            # tokens that no other class has would come first
            out.append((c, n, max(0, int(probes(n)) - (n - m)), [int(T.mix(t ^ seed).min().view(_SIGNED)) for seed in _SEEDS], t.tobytes(), own.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        cols = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _CANDIDATE.split(", ")])

    return run


def _array(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), T.U) if x.is_valid else np.zeros(0, T.U)


def _compare(table: pa.Table) -> pa.Table:
    """Links between the queries (role 1) and the members (role 0) of some groups or chunks of them: one at most for each query and group here; groups are connected already.

    Members are indexed by token, so that one pass over a query's tokens counts what
    it shares with all of them. Tokens that only one class has are in no set, but in n.
    """
    sets = [_array(x) for x in table["tokens"]]
    role, cls, g, n = (np.array(table[c].to_pylist()) for c in ("role", "cls", "g", "n"))
    members = np.flatnonzero(role == 0)
    held, sizes = np.array([len(sets[k]) for k in members], np.int64), n[members]
    token = np.concatenate([sets[k] for k in members]) if len(members) else np.zeros(0, T.U)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(members)), held)[order]
    keys, start = np.unique(token[order], return_index=True)
    stop = np.append(start[1:], len(order))
    links: list[tuple[int, int]] = []
    for q in np.flatnonzero(role == 1).tolist() if len(keys) else ():
        at = np.minimum(np.searchsorted(keys, sets[q]), len(keys) - 1)
        at = at[keys[at] == sets[q]]
        size = stop[at] - start[at]
        if not len(at):
            continue
        met = owner[np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        common = np.bincount(met, minlength=len(members))
        near = np.flatnonzero((TIMES * common >= LEAST * (n[q] + sizes - common)) & (cls[members] != cls[q]) & (g[members] != g[q]))
        for k in near[np.unique(g[members[near]], return_index=True)[1]].tolist():
            links.append((int(cls[q]), int(cls[members[k]])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _open(ws: Workspace, sets: DataFrame, tasks: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Links of the tasks' queries (cls, of group g) with the members (g, cls) of the groups that they open (rows without cls). sets: cls, n, tokens."""
    keys = ["lead", "k", "qc", "gc"]
    # a task's queries and members are dealt to chunks by hash, and each chunk of queries meets each of members
    members = ws.write(members, f"{name}-members")
    opened = tasks.where("cls is null").select(*keys, "g").join(members.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "g")
    chunks = opened.groupBy(*keys).agg(F.ceil(F.sum("size") / SETS).alias("m")).join(tasks.groupBy(*keys).agg(F.ceil(F.count("cls") / SETS).alias("q")), keys)
    chunks = ws.write(chunks, f"{name}-chunks")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    asked = tasks.where("cls is not null").join(chunks, keys).select(*keys, F.pmod(F.xxhash64("cls"), F.col("q")).alias("xc"), each("m").alias("mc"), "cls", "g", F.lit(1).alias("role"))
    held = opened.join(members, "g").join(chunks.where("q > 0"), keys).select(*keys, each("q").alias("xc"), F.pmod(F.xxhash64("cls"), F.col("m")).alias("mc"), "cls", "g", F.lit(0).alias("role"))
    rows = ws.write(asked.unionByName(held), f"{name}-rows")
    links = ws.write(rows.join(sets.select("cls", "n", "tokens"), "cls").select(*keys, "xc", "mc", "role", "cls", "g", "n", "tokens").groupBy(*keys, "xc", "mc").applyInArrow(_compare, "a long, b long"), f"{name}-links")
    ws.drop(f"{name}-members", f"{name}-chunks", f"{name}-rows")
    return links


def _with_tokens(head: bytes, tokens: np.ndarray) -> bytes:
    """The packed head after its length, then the tokens as they are: hashes don't compress."""
    return len(head).to_bytes(8, "little") + head + tokens.tobytes()


def _without(blob: bytes, *kinds: str) -> tuple[list[np.ndarray], np.ndarray]:
    end = 8 + int.from_bytes(blob[:8], "little")
    return X.unpack(blob[8:end], *kinds), np.frombuffer(blob, "<u4", -1, end)


def _copies(level: np.ndarray) -> np.ndarray:
    """Over how many parts a token of a level is spread."""
    return np.maximum(1, (np.int64(1) << level.astype(np.int64)) // TOKEN_ROWS)


def _matrix_keys(token: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return T.mix(token + copy.astype(T.U) * T.U(0x9E3779B97F4A7C15))


def _matrix(n_parts: int):
    def packed(kind: int, key: np.ndarray, owner: np.ndarray, *facts: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        """Rows for each part: facts of the owners there, how many tokens each has, and the tokens in order of owner."""
        part = (key % T.U(n_parts)).astype(np.int64)
        order = np.lexsort((owner, part))
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:z]
            own, times = np.unique(owner[at], return_counts=True)
            yield int(part[at[0]]), 0, kind, _with_tokens(X.pack(*(f[own] for f in facts), times.astype("u4")), (key[at] >> T.U(32)).astype("<u4"))

    def rows_of(cls: np.ndarray, gid: np.ndarray, n: np.ndarray, ask: np.ndarray, tokens: list[np.ndarray], levels: list[np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
        size = np.array([len(t) for t in tokens])
        token, level, owner = np.concatenate(tokens), np.concatenate(levels), np.repeat(np.arange(len(cls)), size)
        # queries: each asks one copy of its rarest tokens
        probe = np.flatnonzero(np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size) < ask[owner])
        copies = _copies(level[probe])
        copy = (T.mix(cls[owner[probe]].view(T.U)) % copies.astype(T.U)).astype(np.int64)
        yield from packed(1, _matrix_keys(token[probe], copy), owner[probe], cls, gid, n.astype("i4"))
        # groups: each token of the union once, in all its copies
        groups, g = np.unique(gid, return_inverse=True)
        low, high = np.full(len(groups), np.iinfo("i4").max, "i4"), np.zeros(len(groups), "i4")
        np.minimum.at(low, g, n.astype("i4"))
        np.maximum.at(high, g, n.astype("i4"))
        order = np.lexsort((token, g[owner]))
        t, o, v = token[order], g[owner][order], level[order]
        head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])]))
        t, o, copies = t[head], o[head], _copies(v[head])
        copy = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        yield from packed(0, _matrix_keys(np.repeat(t, copies), copy), np.repeat(o, copies), groups, low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum([len(x) // 8 if x is not None else 0 for x in (y.as_buffer() for y in b.column("tokens"))])
            cut = 0
            while cut < b.num_rows:  # a bounded number of tokens at a time
                z = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + MATRIX_TOKENS, side="right")))
                x = b.slice(cut, z - cut)
                cls, gid, n, ask = (x.column(c).to_numpy() for c in ("cls", "gid", "n", "probes"))
                levels = [np.frombuffer(y.as_buffer(), "u1") for y in x.column("levels")]
                yield from X.packed_table(list(rows_of(cls, gid, n, ask, [_array(y) for y in x.column("tokens")], levels))).to_batches()
                cut = z

    return run


def _pairs_of_part(table: pa.Table, n_parts: int) -> pa.Table:
    """Packed by query: query, own group, group, size, hits. For each query and each other group with a smaller key, how many of the query's tokens in this part are in the group's matrix rows."""
    rows: tuple[list, list] = ([], [])
    for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
        facts, tokens = _without(blob, *(("i8", "i8", "i4", "u4") if kind else ("i8", "i4", "i4", "u4")))
        rows[kind].append((*facts, tokens))
    if not rows[0] or not rows[1]:
        return X.packed_table([])
    gid, low, high, times, token = (np.concatenate(c) for c in zip(*rows[0], strict=True))
    groups, g = np.unique(gid, return_inverse=True)
    g, low, high = (np.repeat(x, times) for x in (g, low, high))
    order = np.lexsort((g, token))
    g, low, high, token = (x[order] for x in (g, low, high, token))
    head = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (g[1:] != g[:-1])]))
    low, high, g, token = np.minimum.reduceat(low, head), np.maximum.reduceat(high, head), g[head], token[head]
    cls, own, size, times, asked = (np.concatenate(c) for c in zip(*rows[1], strict=True))
    owner = np.repeat(np.arange(len(cls)), times)
    first, last = np.searchsorted(token, asked), np.searchsorted(token, asked, side="right")
    # a query's own group has each of its tokens; where no other one has it, nothing is found
    wide = np.flatnonzero(last - first > 1)
    owner, first, width = owner[wide], first[wide], (last - first)[wide]
    rank = np.searchsorted(groups, own)  # smaller keys than a query's own group's
    found: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def fold() -> None:
        if found:
            keys, back = np.unique(np.concatenate(found), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
            found[:], counts[:] = [keys], [total]

    many, pending, cut = len(groups), 0, 0
    ends = np.cumsum(width)
    while cut < len(owner):
        z = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 2_000_000, side="right")))
        w = width[cut:z]
        at = np.repeat(first[cut:z] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        q = np.repeat(owner[cut:z], w)
        n = size[q].astype(np.int64)
        ok = (g[at] < rank[q]) & (TIMES * high[at].astype(np.int64) >= LEAST * n) & (LEAST * low[at].astype(np.int64) <= TIMES * n)
        found.append(q[ok] * np.int64(many) + g[at[ok]])
        counts.append(np.ones(len(found[-1]), np.int64))
        pending, cut = pending + len(found[-1]), z
        if pending > 4_000_000:
            fold()
            pending = 0
    fold()
    keys, hits = (found[0], counts[0]) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    q = keys // many
    return X.packed_table(list(X.deal(0, 4, T.mix(cls[q].view(T.U)), n_parts, cls[q], own[q], groups[keys % many], size[q].astype("i4"), hits.astype("i4"))))


def _qualifying(table: pa.Table) -> pa.Table:
    """Sums each query's matches for each group over all token parts, drops pairs below the bound, and deals the others to tasks, packed.

    Queries with the same smallest group meet in one task, so that sets travel once;
    tasks split, by query and by group, as a query's list grows.
    """
    q, own, g, n, hits = (np.concatenate(c) for c in zip(*(X.unpack(b, "i8", "i8", "i8", "i4", "i4") for b in table["blob"].to_pylist()), strict=True))
    order = np.lexsort((g, q))
    q, own, g, n, hits = (x[order] for x in (q, own, g, n, hits))
    head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (g[1:] != g[:-1])]))
    hits, (q, own, g, n) = np.add.reduceat(hits, head), (x[head] for x in (q, own, g, n))
    ok = hits >= need(n.astype(np.int64))
    q, own, g = q[ok], own[ok], g[ok]
    if not len(q):
        return pa.table({c: pa.array([], t) for c, t in (("lead", pa.int64()), ("k", pa.int64()), ("qc", pa.int64()), ("gc", pa.int64()), ("blob", pa.binary()))})
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    times = np.diff(np.append(first, len(q)))
    lead, k = np.repeat(g[first], times), np.repeat(np.floor(np.log2(times)).astype(np.int64), times)
    qc = (T.mix(q.view(T.U)) % np.maximum(1, 4**k // QUERY_WORK).astype(T.U)).astype(np.int64)
    gc = (T.mix(g.view(T.U)) % np.maximum(1, 2**k // GROUP_WORK).astype(T.U)).astype(np.int64)
    order = np.lexsort((gc, qc, k, lead))
    lead, k, qc, gc, q, own, g = (x[order] for x in (lead, k, qc, gc, q, own, g))
    cut = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (k[1:] != k[:-1]) | (qc[1:] != qc[:-1]) | (gc[1:] != gc[:-1])]))
    blobs = []
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(q)], strict=True):
        asked, at = np.unique(q[a:z], return_index=True)
        opened = np.unique(g[a:z])
        blobs.append(X.squeeze(len(asked).to_bytes(8, "little") + asked.tobytes() + own[a:z][at].tobytes() + opened.tobytes()))
    return pa.table({"lead": lead[cut], "k": k[cut], "qc": qc[cut], "gc": gc[cut], "blob": pa.array(blobs, pa.binary())})


def _listed(table: pa.Table) -> pa.Table:
    """The distinct queries (cls, with their own group g) and groups (g, without cls) of one task."""
    asked: dict[int, int] = {}
    opened: set[int] = set()
    for blob in table["blob"].to_pylist():
        raw = X.unsqueeze(blob)
        m = int.from_bytes(raw[:8], "little")
        x = np.frombuffer(raw, np.int64, -1, 8)
        asked.update(zip(x[:m].tolist(), x[m : 2 * m].tolist(), strict=True))
        opened.update(x[2 * m :].tolist())
    rows = len(asked) + len(opened)
    keys = {c: pa.array([table[c][0].as_py()] * rows, pa.int64()) for c in ("lead", "k", "qc", "gc")}
    return pa.table({**keys, "cls": pa.array([*asked, *[None] * len(opened)], pa.int64()), "g": pa.array([*asked.values(), *opened], pa.int64())})


def _components(ws: Workspace, src: DataFrame, shingle: int, block_bytes: int, carried: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each row of `src` (doc_id, n, cls, block, idx); for each class its root and component (the smallest doc_id of the root's documents); and, where columns are carried, the blocks."""
    size = text_bytes(src)
    n_parts = parts(ws.spark, size)
    #: with some bits more than tokens need, few are taken for shared by chance
    bits = min(64, max(34, size.bit_length() + 6))
    blocks = X.blocked(ws, src, block_bytes, n_parts, carried)
    rows = ws.write(X.per_block(blocks, None, _classed(shingle), _CLASSED), "rows")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.min(F.struct("block", "idx")).alias("home"))
    classes = ws.write(classes.select("cls", "doc", "home.block", "home.idx"), "classes")
    home = classes.select("block", "idx", "cls")
    known = ws.write(X.ask(X.per_block(blocks, home, _ask_tokens(shingle, bits, n_parts), X.PACKED), _serve_tokens), "levels")
    candidates = X.per_block(blocks, known.unionByName(home, allowMissingColumns=True), _candidates(shingle, bits), _CANDIDATE)
    blocks_and_levels = list(ws.tables)
    sets = ws.bucket(candidates.repartition(n_parts, "cls"), "cls", n_parts)
    if not carried:
        ws.release(blocks_and_levels)
    ws.drop("levels")
    # groups: verified stars around the leader of each minimum hash
    each = sets.select("cls", F.posexplode("hashes").alias("k", "hash"))
    # sizes and leaders are written first: a join of tables can split a common hash's rows over tasks, a join with an aggregate can't
    sizes = ws.write(each.groupBy("k", "hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = ws.write(each.join(sizes, ["k", "hash"]).select("cls", "k", "hash", "size"), "shared")
    # the leader of a hash is its most central class: that whose hashes are the most common
    centre = shared.groupBy("cls").agg(F.sum("size").alias("weight"))
    leaders = ws.write(shared.join(centre, "cls").groupBy("k", "hash").agg(F.max_by("cls", F.struct("weight", "cls")).alias("g")), "leaders")
    met = shared.join(leaders, ["k", "hash"]).where("cls <> g").groupBy("cls", "g").agg(F.count(F.lit(1)).alias("times"))
    stars = ws.write(met.where(F.col("times") >= SHARED).select(F.col("cls").alias("q"), "g"), "stars")
    ws.drop("sizes", "shared", "leaders")
    chunks = stars.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
    zero = F.lit(0)
    split = stars.join(chunks, "g").select(F.col("g").alias("lead"), zero.cast("long").alias("k"), F.pmod(F.xxhash64("q"), F.col("chunks")).alias("qc"), zero.cast("long").alias("gc"), "q", "g")
    around = split.select("lead", "k", "qc", "gc", F.col("q").alias("cls"), F.col("q").alias("g")).unionByName(split.select("lead", "k", "qc", "gc", F.lit(None).cast("long").alias("cls"), "g").distinct())
    alone = stars.select("g").distinct().withColumn("cls", F.col("g"))
    roots = connected(ws, _open(ws, sets, around, alone, "stars"), "groups")
    grouped = ws.write(sets.select("cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("gid")), "grouped")

    asked = sets.join(grouped, "cls").select("cls", "gid", "n", "probes", "tokens", "levels").mapInArrow(_matrix(n_parts), X.PACKED)
    found = asked.groupBy("part").applyInArrow(lambda t: _pairs_of_part(t, n_parts), X.PACKED)
    dealt = found.groupBy("part").applyInArrow(_qualifying, "lead long, k long, qc long, gc long, blob binary")
    tasks = ws.write(dealt.groupBy("lead", "k", "qc", "gc").applyInArrow(_listed, "lead long, k long, qc long, gc long, cls long, g long"), "tasks")
    links = _open(ws, sets, tasks, grouped.select(F.col("gid").alias("g"), "cls"), "pairs")
    ws.drop("tasks")
    between = links.join(grouped.toDF("a", "ga"), "a").join(grouped.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    joined = connected(ws, between, "components")
    final = classes.join(grouped, "cls", "left").withColumn("gid", F.coalesce("gid", "cls")).join(joined.withColumnRenamed("node", "gid"), "gid", "left")
    final = ws.write(final.select("cls", "doc", F.coalesce("root", "gid").alias("root")), "final")
    names = final.groupBy("root").agg(F.min("doc").alias("component"))
    return rows, final.join(names, "root").select("cls", "root", "component"), blocks


def join(spark: SparkSession, docs: DataFrame, text: str = "text", shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`; only doc_id and text are read.

    doc_id, n_shingles, class_id (key of its shingle set, null without words) and
    component_id: the smallest doc_id reachable by links, itself included. Words are
    lower-cased (A-Z) and split at ASCII white space. Texts without words, null ones
    among them, link with nothing. Repeated rows are linked with each other. A row
    without doc_id links like others, but gives no component its name; a component
    of such rows alone has a null name. An empty table gives no rows.
    """
    ws = Workspace(spark)
    rows, named, _ = _components(ws, docs.select("doc_id", F.col(text).alias("text")), shingle, block_bytes)
    out = rows.join(named, "cls", "left")
    return ws.close(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")))


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, that with the smallest doc_id.

    Rows without doc_id are compared, but stay, and so do rows without words. Of
    rows that repeat a doc_id, one stays for each component that they name: texts
    that aren't similar are kept both. An empty table gives no rows. Texts stay in
    their blocks, which the places of the chosen rows come to.
    """
    ws = Workspace(spark)
    names = {c: f"__{k}" for k, c in enumerate(docs.columns) if c != "text"}
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("text").isNull().alias("__null"), *(F.col(c).alias(v) for c, v in names.items()))
    rows, named, blocks = _components(ws, src, SHINGLE, BLOCK_BYTES, ["__null", *names.values()])
    first = rows.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "block", "idx")).alias("r"))
    chosen = first.join(named, "cls").groupBy("root").agg(F.min("r").alias("r")).select("r.block", "r.idx")
    places = ws.write(chosen.unionByName(rows.where("cls is null or doc_id is null").select("block", "idx")), "places")
    columns, schema = docs.columns, docs.schema

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        order = np.argsort(block["seq"].to_numpy(), kind="stable")
        block = block.take(pa.array(np.sort(order[wanted["idx"].to_numpy()])))
        text = pc.if_else(block["__null"], pa.scalar(None, pa.string()), block["text"].cast(pa.string()))
        return pa.table({c: text if c == "text" else block[names[c]] for c in columns})

    # the blocks stay until the caller has read the rows
    return blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(run, schema)
