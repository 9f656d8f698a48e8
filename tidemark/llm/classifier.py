"""Quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over standardised
statistics of a text. Partitions sum their normal equations, the driver solves a
ridge regression of fixed size, and isotonic regression over binned held-back
scores turns its output into probabilities. Statistics cover whole texts; the
fit reads labelled rows up to a documented bound, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices
from .stats import text_stats
from .text import packed

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punct", "distinct", "long", "lines", "log_chars")
#: Random Fourier features, and labelled rows that a fit reads at most.
DIMENSIONS, MAX_TRAIN = 256, 200_000
RIDGE, BINS, FIT_PARTITIONS = 1e-3, 256, 16


def statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and x, the FEATURES of each row's whole text; of a null text, those of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = {k: v.astype(float) for k, v in text_stats(*packed(b.column("text"))).items()}
            words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
            x = np.stack(
                [np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_punct"] / chars, s["n_distinct"] / words, s["n_long"] / words, s["n_lines"] / words, np.log1p(s["n_chars"])],
                axis=1,
            )
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "x"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fold(id_col: str, parts: int, salt: str = "") -> Column:
    """A row's fold: crc32 of its id as text (with `salt` before it) modulo `parts`."""
    return F.crc32(F.concat(F.lit(salt), F.col(id_col).cast("string")).cast("binary")) % parts


@dataclass(frozen=True)
class Model:
    """Standardisation, frequencies, weights and the calibration's steps; without labels only a constant."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant before them."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence closest to `value` by weighted squares: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """A model of labelled rows (doc_id, x, y). Three quarters of them, by a hash of their id, fit the ridge; the rest calibrate it."""
    rng = np.random.default_rng(seed)
    d = len(FEATURES)
    n = labelled.count()
    if n > max_train:  # about the bound, whatever the order of rows
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_train / n * (1 << 20)))
    stats = labelled.agg(*(f(F.col("x")[k]).alias(f"{name}{k}") for k in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop))), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    frequency, phase = rng.normal(0, 1 / np.sqrt(d), (d, dimensions)), rng.uniform(0, 2 * np.pi, dimensions)
    if not stats["n"]:
        return Model(np.zeros(d), np.ones(d), frequency, phase, np.zeros(dimensions + 1), np.array([0.0]), np.array([0.5]))
    mean = np.array([stats[f"m{k}"] for k in range(d)])
    scale = np.array([stats[f"s{k}"] or 1.0 for k in range(d)])
    blank = Model(mean, scale, frequency, phase, np.zeros(dimensions + 1), np.array([0.0]), np.array([float(stats["y"])]))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((dimensions + 1, dimensions + 1)), np.zeros(dimensions + 1)
        for b in batches:
            z = blank.lift(_matrix(b))
            a += z.T @ z
            c += z.T @ b.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["a", "c"])

    rows = labelled.withColumn("held", fold("doc_id", 4, "calibrate") == 0).select("x", F.col("y").cast("double").alias("y"), "held").repartition(FIT_PARTITIONS)
    sums = rows.where("not held").select("x", "y").mapInArrow(equations, "a binary, c binary").collect()  # FIT_PARTITIONS rows of fixed size
    a = sum(np.frombuffer(r.a).reshape(dimensions + 1, -1) for r in sums)
    c = sum(np.frombuffer(r.c) for r in sums)
    size = max(a[0, 0], 1.0)
    weights = np.linalg.solve(a + RIDGE * size * np.diag([0.0] + [1.0] * dimensions) + 1e-9 * np.eye(dimensions + 1), c)
    linear = Model(mean, scale, frequency, phase, weights, np.array([0.0]), np.array([float(stats["y"])]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(linear.raw(_matrix(b))), b.column("y")], names=["raw", "y"])

    held = rows.where("held").select("x", "y").mapInArrow(scored, "raw double, y double")
    slot = F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2))
    bins = held.groupBy(slot.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # BINS rows at most
    if len(bins) < 2:
        return linear
    knots, n = np.array([r.raw for r in bins]), np.array([float(r.n) for r in bins])
    return Model(mean, scale, frequency, phase, weights, knots, isotonic(np.array([r.y for r in bins]), n))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """Score each row of `docs` (doc_id, text; others are not read) as `labels` (doc_id, `label`) marks it.

    doc_id, held_out (crc32 of doc_id as text modulo 3 is 1), score, predicted.
    Only labels of rows that are not held out are learnt; null labels and ids teach
    nothing. Without labels every score is 0.5, with one class it is that class.
    Repeated rows are scored each; a null text is scored as an empty one, and a
    null doc_id is never held out.
    """
    ws = Workspace(spark)
    stats = ws.write(statistics(docs), "statistics")
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & (fold("doc_id", 3) != 1))
    model = fit(ws.write(stats.join(known, "doc_id"), "labelled"), max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return ws.close(scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted"))
