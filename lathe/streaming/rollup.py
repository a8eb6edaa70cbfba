"""Stored rollups of streams: every micro-batch adds its partial aggregates to a table once.

A batch's partials go to a folder named after its id, which a replayed batch (the engine repeats one that it did not see
committed) writes anew, so nothing is counted twice, and a restart goes on where the checkpoint stands. Reading adds up the partials,
and takes part-written folders for absent. After `compact_after` batches the partials are merged into one folder that names the
last batch in it; batches up to that one are then ignored and deleted. Late rows count like others: no window is ever closed, and
none depends on a watermark. The work of a batch is one partial aggregate, of a read one aggregate over (keys x batches) rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Rollup:
    """`keys`: name -> expression over rows; `parts`: name -> (aggregate over rows, how partials are merged)."""

    keys: dict[str, Column]
    parts: dict[str, tuple[Column, str]]

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[e.alias(k) for k, e in self.keys.items()]).agg(*[e.alias(n) for n, (e, _) in self.parts.items()])

    def merged(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy(*self.keys).agg(*[MERGE[how](n).alias(n) for n, (_, how) in self.parts.items()])


class Store:
    """The folder of a rollup."""

    def __init__(self, spark: SparkSession, path: str, rollup: Rollup, compact_after: int = 32):
        self.spark, self.path, self.rollup, self.compact_after = spark, path.rstrip("/"), rollup, compact_after

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _folders(self) -> tuple[int, list[int]]:
        """(last batch of the newest whole merge, -1 without one; later whole batches)."""
        fs, at = self._fs()
        whole: dict[str, list[int]] = {"batch": [], "upto": []}
        if fs.exists(at):
            for status in fs.listStatus(at):
                m = re.fullmatch(r"(batch|upto)-(\d+)", status.getPath().getName())
                if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    whole[m[1]].append(int(m[2]))
        upto = max(whole["upto"], default=-1)
        return upto, sorted(b for b in whole["batch"] if b > upto)

    def add(self, batch: DataFrame, number: int) -> None:
        """For `foreachBatch`."""
        upto, later = self._folders()
        if number <= upto:  # merged before the engine saw it committed
            return
        self.rollup.partial(batch).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if len({*later, number}) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        upto, later = self._folders()
        if not later:
            return
        self.rollup.merged(self._partials(upto, later)).write.mode("overwrite").parquet(f"{self.path}/upto-{later[-1]}")
        fs, _ = self._fs()
        for name in [f"batch-{b}" for b in later] + ([f"upto-{upto}"] if upto >= 0 else []):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _partials(self, upto: int, later: list[int]) -> DataFrame:
        return self.spark.read.parquet(*([f"{self.path}/upto-{upto}"] if upto >= 0 else []), *[f"{self.path}/batch-{b}" for b in later])

    def read(self) -> DataFrame | None:
        """The rollup of all batches so far (None before the first)."""
        upto, later = self._folders()
        return self.rollup.merged(self._partials(upto, later)) if upto >= 0 or later else None


def run_rollup(stream: DataFrame, store: Store, checkpoint: str, added: dict[str, str] | None = None) -> DataFrame:
    """Take in everything available, from where `checkpoint` stands, and return the rollup. `added`: columns and types that the store itself adds."""
    query = stream.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = store.read()
    if found is not None:
        return found
    empty = stream.sparkSession.createDataFrame([], stream.schema).withColumns({n: F.lit(None).cast(t) for n, t in (added or {}).items()})
    return store.rollup.merged(store.rollup.partial(empty))
