"""Endpoint metrics that reset themselves: the first request more than `window_s` seconds after a reset begins the next period.

Every micro-batch is one Spark job over its rows (`reset_windows`), not a state machine for each endpoint, so a busy
endpoint is spread over time buckets. What a batch needs to know is the open period of each endpoint: the latest one in the
partial sums of the batches before it, which are stored once a batch (`rollup.Store`). A replayed batch reads the same
earlier batches and writes the same folder. Rows that come late, older than their endpoint's open period, count in the
period that was open before their batch, as in a counter that sees requests as they come; inside a batch rows are taken in time order. Nothing waits for a watermark: periods that are
still open when the input ends are in the table too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.greedy import reset_windows
from .rollup import Rollup, Store

RESET_S = 300


def period_rollup() -> Rollup:
    """Partial sums by endpoint and period (rows with `_us`, `window_us`)."""
    failed = (F.col("event_type") == "error").cast("int")
    return Rollup({"endpoint": F.col("event_type"), "window_us": F.col("window_us")},
                  {"count": (F.count(F.lit(1)), "sum"), "timed": (F.count("value"), "sum"), "total_time": (F.sum("value"), "sum"), "low": (F.min("value"), "min"),
                   "high": (F.max("value"), "max"), "errors": (F.sum(failed), "sum"), "last_us": (F.max("_us"), "max")})


def periods(rollup: DataFrame) -> DataFrame:
    """Metrics by endpoint and period. `min_time` and `max_time` are not reset: they run from the endpoint's first request on."""
    so_far = Window.partitionBy("endpoint").orderBy("window_us").rowsBetween(Window.unboundedPreceding, 0)  # one row a period
    return rollup.select("endpoint", F.col("window_us").alias("reset_us"), "last_us", "count", "total_time", (F.col("total_time") / F.col("timed")).alias("avg_time"),
                         F.min("low").over(so_far).alias("min_time"), F.max("high").over(so_far).alias("max_time"), "errors", (F.col("errors") / F.col("count")).alias("error_rate"))


class ResetStore(Store):
    """A stored rollup whose periods go on from one batch to the next."""

    def __init__(self, spark: SparkSession, path: str, window_s: int = RESET_S, compact_after: int = 32):
        super().__init__(spark, path, period_rollup(), compact_after)
        self.window_s = window_s

    def add(self, batch: DataFrame, number: int) -> None:
        upto, later = self._folders()
        if number <= upto:
            return
        earlier = [b for b in later if b < number]
        carried = None
        if upto >= 0 or earlier:
            carried = self._partials(upto, earlier).groupBy(F.col("endpoint").alias("event_type")).agg(F.max("window_us").alias("window_us"))
        super().add(reset_windows(batch, "event_type", "_us", self.window_s, carried), number)
