"""Contracts that are checked by the job that writes a frame, not by jobs of their own.

Each check is a metric that Spark observes while rows pass: counts of broken rules,
the latest date, the largest number of rows of a key. Keys are counted where their
rows have been brought together for the join that needs them unique, so no check
adds a shuffle to it. A frame is published only once all metrics hold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Checks on the frames that one write reads.

    `domain`, `point_in_time` and `unique` give the frame back with its check
    attached; `settle` raises the ValueError of the first broken one, in the order in
    which they were attached, with the wording of the eager checks of `checks`. A
    frame that Spark left out of the plan (as with a join whose other side is empty)
    is checked by a job of its own. Counts in a message may exceed the number of rows
    where lost executors made Spark read rows twice; whether a contract holds is not
    affected.
    """

    def __init__(self) -> None:
        self._held: list[tuple[Observation, DataFrame, list[Column], Callable[[dict[str, Any]], str | None]]] = []

    def _observe(self, df: DataFrame, metrics: Sequence[Column], broken: Callable[[dict[str, Any]], str | None]) -> DataFrame:
        seen = Observation()
        self._held.append((seen, df, list(metrics), broken))
        return df.observe(seen, *metrics)

    def domain(self, df: DataFrame, rules: Mapping[str, Column], label: str) -> DataFrame:
        """rules: name -> a condition that should hold; null counts as holding."""

        def broken(found: dict[str, Any]) -> str | None:
            bad = {k: found[k] for k in rules if found[k]}
            return f"{label} breaks rules: {bad}" if bad else None

        return self._observe(df, [F.count_if(~rule).alias(name) for name, rule in rules.items()], broken)

    def point_in_time(self, df: DataFrame, day: str, cutoff: str, label: str) -> DataFrame:
        """No date of `day` may lie after the cutoff; an empty frame holds."""
        late = F.col(day).cast("date") > F.lit(cutoff).cast("date")
        return self._observe(df, [F.count_if(late).alias("late")], lambda found: f"dates after {cutoff} in: {label}" if found["late"] else None)

    def unique(self, df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
        """One row for each key, nulls as a key of their own. Rows meet by key, as a join on the keys needs them anyway."""
        rest = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest) if rest else F.lit(True)).alias("__rest"))
        one = self._observe(one, [F.max("__n").alias("most")], lambda found: f"{label} repeats the key {list(keys)}" if (found["most"] or 0) > 1 else None)
        return one.select(*(F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in df.columns))

    def one_to_one(self, left: DataFrame, right: DataFrame, on: list[str], label: str) -> DataFrame:
        """Left join of frames whose keys are both unique."""
        return self.unique(left, on, f"{label}, left").join(self.unique(right, on, f"{label}, right"), on, "left")

    def many_to_one(self, left: DataFrame, right: DataFrame, on: list[str], label: str) -> DataFrame:
        """Left join that can't multiply the rows of `left`: the keys of `right` are unique."""
        return left.join(self.unique(right, on, f"{label}, right"), on, "left")

    def settle(self) -> None:
        """Raise for the first contract that the finished job found broken."""
        for seen, df, metrics, broken in self._held:
            try:
                found = seen.get
            except Py4JJavaError:  # no metrics: Spark left the frame out
                found = df.agg(*metrics).first().asDict()
            message = broken(found)
            if message:
                raise ValueError(message)

    def write(self, df: DataFrame, path: str) -> DataFrame:
        """Write Parquet beside `path`, settle, and only then put it there; what broke a contract is deleted and what lay at `path` stays."""
        spark = df.sparkSession
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        staged, target = fs_path(f"{path}.staged"), fs_path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        df.write.mode("overwrite").parquet(f"{path}.staged")
        try:
            self.settle()
        except ValueError:
            fs.delete(staged, True)
            raise
        fs.delete(target, True)
        if not fs.rename(staged, target):
            raise OSError(f"{path} could not be put in place")
        return spark.read.schema(df.schema).parquet(path)
