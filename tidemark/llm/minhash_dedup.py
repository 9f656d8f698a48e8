"""MinHash near-duplicates by bottom-k sketches from one hash function.

Texts with equal shingle sets form a class. A class's sketch is its `SKETCH` smallest
shingle hashes, so a set that has no more is its own sketch. Two sketches together hold
the smallest hashes of the union; the share that both have estimates the similarity, and
is exact where both sets are whole. Truncated sketches pass from `ESTIMATE` percent on:
for a pair at the threshold of 80 percent the chance to fall below is under 1e-8 (Chernoff
bound of 64 draws), smaller still above it.

Inverted lists hold for each retained value its classes. A pair that can pass shares `need`
retained values at least; so if a class enters only the lists of all but need - 1 of its values,
the rarest first, any such pair meets in one of them. Lists that thousands of near copies
share aren't expanded to pairs. Each list first names its most central class, against which its
other classes are estimated and verified; then a member of its largest group, picked by hash;
linked classes are one group. What still lies in different groups meets at the end, all of it:
lists of one central class have much the same classes, and form one canopy, whose classes are
counted against each other through an index, chunk by chunk. Every link is confirmed by the Jaccard similarity of the full sets of 64-bit
shingle hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T
from .common import Workspace, parts, text_bytes
from .components import connected
from .jaccard_join import class_of, shingle_sets

SHINGLE = 4
#: Similar: TIMES * intersection >= LEAST * union.
LEAST, TIMES = 80, 100
#: Hashes that a sketch retains, and the percent that truncated sketches must share.
SKETCH, ESTIMATE = 64, 45
#: Bytes of text in a block; its shingles take some thirty times as much memory.
BLOCK_BYTES = 4 << 20
#: Bytes of sets that one comparison holds, roughly.
COMPARED = 16 << 20
#: Bytes of sets in a chunk of a canopy.
CANOPY = 32 << 20

Test = Callable[[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def need(n: Column) -> Column:
    """How many retained values a class of n shingles shares at least with any class that can pass."""
    whole = F.ceil(LEAST * n / TIMES)
    return F.least(whole, F.lit(-(-ESTIMATE * SKETCH // 100))).cast("int")


def _rows(shingle: int):
    def run(d: X.Documents, _: pa.Table) -> pa.Table:
        """Size and class of each document's set; the sketch where the class is met first in the block."""
        seen: set[int] = set()
        ns, classes, sketches = [], [], []
        for s in shingle_sets(d, shingle):
            c = class_of(s) if len(s) else None
            ns.append(len(s))
            classes.append(c)
            sketches.append(None if c is None or c in seen else s[:SKETCH].view(np.int64))
            seen.add(c)
        m = len(ns)
        return pa.table({"doc_id": d.ids, "n": pa.array(ns, pa.int64()), "cls": pa.array(classes, pa.int64()), "block": pa.array([d.block] * m, pa.int64()), "idx": pa.array(range(m), pa.int64()), "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    return run


def _sets(shingle: int):
    def run(d: X.Documents, home: pa.Table) -> pa.Table:
        """The full sets of the classes that are at home in the block."""
        mine = dict(zip(home["idx"].to_pylist(), home["cls"].to_pylist(), strict=True))
        found = [(mine[k], len(s), s.view(np.int64)) for k, s in enumerate(shingle_sets(d, shingle)) if k in mine] if mine else []
        return pa.table({"cls": pa.array([x[0] for x in found], pa.int64()), "n": pa.array([x[1] for x in found], pa.int64()), "hashes": pa.array([x[2] for x in found], pa.list_(pa.int64()))})

    return run


def estimated(own: np.ndarray, n: int, others: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sketches (hashes `others`, of `owner`, from sets of `sizes`) pass against the sketch `own` of a set of n. Both retain all values up to the smaller of their last ones, which make the union's sketch."""
    ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))
    top = np.iinfo(np.uint64).max
    limit = np.minimum(np.where(sizes > SKETCH, others[ends - 1], T.U(top)), own[-1] if n > SKETCH else T.U(top))
    inside = others <= limit[owner]
    both = np.bincount(owner[inside & np.isin(others, own)], minlength=len(sizes))
    union = np.searchsorted(own, limit, side="right") + np.bincount(owner[inside], minlength=len(sizes)) - both
    return 100 * both >= np.where((sizes > SKETCH) | (n > SKETCH), ESTIMATE, LEAST) * union


def verified(own: np.ndarray, n: int, others: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which full sets are similar to `own`."""
    both = np.bincount(owner[np.isin(others, own)], minlength=len(sizes))
    return TIMES * both >= LEAST * (n + sizes - both)


def _passing(ws: Workspace, pairs: DataFrame, sets: DataFrame, test: Test, most: int, name: str) -> DataFrame:
    """Those of the pairs (a, na, b, nb) whose sets pass. A pair's second set travels to the first, in chunks of bounded bytes."""
    cost = F.ceil(F.sum(8 * F.least("nb", F.lit(most))) / COMPARED)
    chunks = ws.write(pairs.groupBy("a").agg(cost.alias("m")), f"{name}-chunks")
    split = ws.write(pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("m")).alias("chunk")), f"{name}-split")
    asked = split.select("a", "chunk", F.col("b").alias("cls"), F.lit(1).alias("role"))
    held = split.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("cls"), F.lit(0).alias("role"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("role").combine_chunks()
        hashes, n, cls = table["hashes"].combine_chunks(), table["n"].to_numpy(), table["cls"].to_numpy()
        if table["role"][0].as_py() or table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.diff(hashes.offsets.to_numpy())
        values = hashes.flatten().to_numpy().view(T.U)
        ok = test(values[: size[0]], int(n[0]), values[size[0] :], np.repeat(np.arange(len(size) - 1), size[1:]), n[1:])
        return pa.table({"a": np.repeat(cls[:1], int(ok.sum())), "b": cls[1:][ok]})

    found = asked.unionByName(held).join(sets, "cls").groupBy("a", "chunk").applyInArrow(run, "a long, b long")
    return ws.write(found, f"{name}-passed")


def _alike(x: str, y: str) -> Column:
    """Sizes that similar sets can have."""
    return (TIMES * F.least(x, y) >= LEAST * F.greatest(x, y)) & (F.col(x) > 0)


def _ragged(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of some sets, the places where each one's owners begin, and the owners."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    keys, start = np.unique(values[order], return_index=True)
    return keys, np.append(start, len(order)), owner[order]


def _shared(index: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray, n: int) -> np.ndarray:
    """How many values of `own` each of the n indexed sets has."""
    keys, start, owner = index
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    at = at[keys[at] == own]
    size = start[at + 1] - start[at]
    return np.bincount(owner[np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())], minlength=n)


def compared(table: pa.Table) -> pa.Table:
    """Links between a chunk's classes (role 1) and those of a chunk (role 0) of the same canopy: estimated by sketches, verified on full sets, one at most from a class to a group."""
    table = table.combine_chunks()
    hashes, role = table["hashes"].combine_chunks(), table["role"].to_numpy()
    ends, values = hashes.offsets.to_numpy(), hashes.flatten().to_numpy().view(T.U)
    n, cls, g = (table[c].to_numpy() for c in ("n", "cls", "g"))
    members = np.flatnonzero(role == 0)
    links: list[tuple[int, int]] = []
    if len(members):
        own = [values[ends[k] - ends[0] : ends[k + 1] - ends[0]] for k in range(len(cls))]
        sets = [own[k] for k in members]
        sizes, of, names = n[members], g[members], cls[members]
        sketches = np.full((len(sets), SKETCH), np.iinfo(np.uint64).max, np.uint64)
        for row, s in zip(sketches, sets, strict=True):
            row[: len(s)] = s[:SKETCH]
        few, full, last = _ragged([s[:SKETCH] for s in sets]), _ragged(sets), sketches[:, -1]
        for q in np.flatnonzero(role == 1).tolist():
            sketch, cut = own[q][:SKETCH], n[q] > SKETCH
            both = _shared(few, sketch, len(sets))
            limit = np.where(sizes > SKETCH, last, np.iinfo(np.uint64).max)
            limit = np.minimum(limit, sketch[-1]) if cut else limit
            held = (sketches <= sketch[-1]).sum(1) if cut else np.minimum(sizes, SKETCH)
            union = np.searchsorted(sketch, limit, side="right") + held - both
            near = (100 * both >= np.where((sizes > SKETCH) | cut, ESTIMATE, LEAST) * union) & (of != g[q]) & (names < cls[q])
            if near.any():
                both = _shared(full, own[q], len(sets))
                near = np.flatnonzero(near & (TIMES * both >= LEAST * (n[q] + sizes - both)))
                links += [(int(cls[q]), int(names[k])) for k in near[np.unique(of[near], return_index=True)[1]]]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


class _Groups:
    """Groups of linked classes, which grow as links come."""

    def __init__(self, ws: Workspace, classes: DataFrame, sketches: DataFrame, sets: DataFrame):
        self.ws, self.sketches, self.sets, self.n = ws, sketches, sets, 0
        self.of = classes.select("cls", F.col("cls").alias("g"))

    def link(self, pairs: DataFrame) -> None:
        """Estimate and verify pairs (a, na, b, nb), and join the groups of those that are similar."""
        ws, name = self.ws, f"round{self.n}"
        pairs = ws.write(pairs.where(_alike("na", "nb")).distinct(), f"{name}-pairs")
        near = _passing(ws, pairs, self.sketches, estimated, SKETCH, f"{name}-sketch")
        near = near.join(pairs, ["a", "b"]).select("a", "na", "b", "nb")
        self.join(_passing(ws, near, self.sets, verified, np.iinfo(np.int32).max, f"{name}-set"))

    def open(self, canopies: DataFrame) -> None:
        """Compare all classes of each canopy (lead, cls, n, g), chunk by chunk, and join the groups of those that are similar."""
        ws, name = self.ws, f"round{self.n}"
        canopies = ws.write(canopies, f"{name}-canopies")
        cost = F.ceil(F.sum(8 * F.col("n")) / CANOPY)
        chunks = ws.write(canopies.groupBy("lead").agg(cost.alias("m"), F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").drop("low", "high"), f"{name}-chunks")
        each = canopies.join(chunks, "lead").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("m")))
        columns = ["lead", "x", "y", "cls", "g"]
        asked = each.withColumn("x", F.col("own")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select(*columns, F.lit(1).alias("role"))
        held = each.withColumn("y", F.col("own")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select(*columns, F.lit(0).alias("role"))
        met = ws.write(asked.unionByName(held), f"{name}-met")
        self.join(ws.write(met.join(self.sets, "cls").groupBy("lead", "x", "y").applyInArrow(compared, "a long, b long"), f"{name}-links"))

    def join(self, links: DataFrame) -> None:
        """Make one group of those that links (a, b) connect."""
        ws, name, of, self.n = self.ws, f"round{self.n}", self.of, self.n + 1
        between = links.join(of.toDF("a", "ga"), "a").join(of.toDF("b", "gb"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
        roots = connected(ws, between, f"{name}-joined").toDF("g", "root")
        self.of = ws.write(of.join(roots, "g", "left").select("cls", F.coalesce("root", "g").alias("g")), f"{name}-groups")

    def lists(self, posts: DataFrame) -> DataFrame:
        """The lists (v, cls, n, g) that more than one group is in."""
        told = self.ws.write(posts.join(self.of, "cls").select("v", "cls", "n", "g"), f"lists{self.n}")
        several = self.ws.write(told.groupBy("v").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("v"), f"several{self.n}")
        return self.ws.write(told.join(several, "v"), f"open{self.n}")


def dedup(spark: SparkSession, docs: DataFrame, text: str = "text", shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`; only doc_id and the text are read.

    doc_id, n_shingles, class_id (key of its shingle set, null without words), component_id
    (the smallest doc_id reachable by links, itself included) and kept (doc_id is the
    component's name). Words are lower-cased (A-Z) and split at ASCII white space; a text
    of fewer words than a shingle is one shingle. Texts without words, null ones among them,
    link with nothing and are kept. Repeated rows are linked with each other, and all that
    bear the component's name are kept. A row without doc_id links like others, but gives no
    component its name; a component of such rows alone has a null name, and all are kept.
    An empty table gives no rows.
    """
    ws = Workspace(spark)
    src = docs.select("doc_id", F.col(text).alias("text"))
    n_parts = parts(spark, text_bytes(src))
    blocks = X.blocked(ws, src, block_bytes, n_parts)
    rows = ws.write(X.per_block(blocks, None, _rows(shingle), "doc_id long, n long, cls long, block long, idx long, sketch array<long>"), "rows")
    classes = ws.write(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.min(F.struct("block", "idx")).alias("home")), "classes")
    sketches = rows.where("sketch is not null").select("cls", "n", F.col("sketch").alias("hashes")).repartition(n_parts, "cls").dropDuplicates(["cls"])
    sketches = ws.bucket(sketches, "cls", n_parts)

    # lists of retained values: those that one class has alone lead nowhere
    each = sketches.select("cls", "n", F.explode("hashes").alias("v"))
    often = ws.write(each.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    shared = each.join(often, "v").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vals"))
    ranked = shared.withColumn("p", F.size("vals") - need(F.col("n")) + 1).where("p > 0")
    weight = F.aggregate("vals", F.lit(0).cast("long"), lambda acc, x: acc + x["f"])
    posts = ranked.select("cls", "n", weight.alias("weight"), F.explode(F.slice("vals", F.lit(1), F.col("p"))).alias("x"))
    posts = ws.write(posts.select("cls", "n", "weight", "x.v"), "posts")
    ws.drop("often")
    met = ws.write(posts.select("cls").distinct(), "met")
    home = classes.join(met, "cls").select("home.block", "home.idx", "cls")
    sets = ws.bucket(X.per_block(blocks, home, _sets(shingle), "cls long, n long, hashes array<long>").repartition(n_parts, "cls"), "cls", n_parts)

    groups = _Groups(ws, met, sketches, sets)
    central = F.max_by(F.struct("cls", "n"), F.struct("weight", "cls")).alias("c")
    leaders = ws.write(posts.groupBy("v").agg(central, F.count(F.lit(1)).alias("size")).where("size > 1").select("v", F.col("c.cls").alias("a"), F.col("c.n").alias("na")), "leaders")
    groups.link(posts.join(leaders, "v").where("cls <> a").select("a", "na", F.col("cls").alias("b"), F.col("n").alias("nb")))

    lists = groups.lists(posts)
    sizes = lists.groupBy("v", "g").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("cls", "n"), F.xxhash64("cls", "v")).alias("c"))
    largest = ws.write(sizes.groupBy("v").agg(F.max_by(F.struct("g", "c"), F.struct("size", "g")).alias("x")).select("v", F.col("x.g").alias("gl"), F.col("x.c.cls").alias("a"), F.col("x.c.n").alias("na")), "largest")
    groups.link(lists.join(largest, "v").where("g <> gl").select("a", "na", F.col("cls").alias("b"), F.col("n").alias("nb")))

    groups.open(groups.lists(posts).join(leaders, "v").select(F.col("a").alias("lead"), "cls", "n", "g").distinct())

    named = ws.write(classes.join(groups.of, "cls", "left").select("cls", "doc", F.coalesce("g", "cls").alias("g")), "named")
    names = named.groupBy("g").agg(F.min("doc").alias("component"))
    out = rows.drop("sketch").join(named.join(names, "g").select("cls", "component"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), component.alias("component_id"))
    return ws.close(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))
