"""Versions of fitted state in a folder: written aside, then switched to at once (ML13).

A version is a folder of its own, `v-<number>`. Only when all of it is written does a pointer file `current-<number>` come into
being, by a rename, which file systems do at once; readers follow the highest pointer. A refit that fails, or a driver that is
lost, leaves a folder without a pointer, which nobody reads, and the version before stays the current one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.recommend import Model
from .training import DowntimeClassifier, TreeRegressor, load, save


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        fs, at = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for m in (re.fullmatch(kind + r"-(\d+)", n) for n in names) if m)

    def whole(self) -> list[int]:
        """Numbers of the versions that can be read."""
        return self._numbers("current")

    def current(self) -> str | None:
        """Folder of the newest whole version."""
        found = self.whole()
        return f"{self.root}/v-{found[-1]}" if found else None

    def publish(self, build: Callable[[str], None]) -> int:
        """`build(folder)` writes a new version; its number, once it is the current one. One writer at a time may win a number."""
        number = max([*self._numbers("v"), *self.whole(), 0]) + 1
        fs = self._fs()
        if not fs.mkdirs(self._path(f"v-{number}")):
            raise RuntimeError(f"cannot make version {number} in {self.root}")
        build(f"{self.root}/v-{number}")
        aside = self._path(f"v-{number}/pointer")
        fs.create(aside, True).close()
        if not fs.rename(aside, self._path(f"current-{number}")):
            raise RuntimeError(f"cannot switch to version {number} in {self.root}")
        return number


@dataclass
class Fitted:
    """All that the services score with, of one version."""

    efficiency: TreeRegressor
    downtime: DowntimeClassifier
    profiles: Model


def retrain(versions: Versions, jobs: DataFrame, fit_efficiency: Callable[[], TreeRegressor], fit_downtime: Callable[[], DowntimeClassifier], min_rows: int = 100) -> dict:
    """ML13: fit both models and the recommender's profiles on the derived job log and publish them as one version. Below `min_rows` jobs
    nothing is fitted. An error in any part leaves the current version as it is and is raised."""
    rows = jobs.count()
    if rows < min_rows:
        return {"status": "skipped", "reason": "insufficient_data", "rows": rows}

    def build(path: str) -> None:
        save(fit_efficiency(), f"{path}/efficiency")
        save(fit_downtime(), f"{path}/downtime")
        Model(jobs).store(lambda name, table: _written(table, f"{path}/profiles/{name}"))
        versions.spark.createDataFrame([(json.dumps({"rows": rows}),)], "told string").coalesce(1).write.text(f"{path}/about")

    return {"status": "success", "rows": rows, "version": versions.publish(build)}


def _written(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


def current(versions: Versions) -> Fitted | None:
    """The newest whole version (None before the first)."""
    path = versions.current()
    if path is None:
        return None
    return Fitted(load(f"{path}/efficiency"), load(f"{path}/downtime"), Model.stored(lambda name: versions.spark.read.parquet(f"{path}/profiles/{name}")))
