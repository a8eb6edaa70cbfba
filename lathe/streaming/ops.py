"""Structured Streaming operators over request events and the job log (STR1-STR3).

Events map onto API requests: client = user_id, endpoint = event_type,
processing time = value, error = (event_type = 'error').
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exprs import hour_bucket
from ..session import ensure_checkpoint_dir, shared_path
from ..operators.greedy import accept_within_limit, reset_windows
from .resets import RESET_S, ResetStore, period_rollup, periods
from .rollup import Rollup, Store, run_rollup

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a file stream (only the events file of the folder)."""
    return (spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))


def micros(ts) -> object:
    """Zone-free microseconds since 1970-01-01 of a timestamp_ntz."""
    t = F.col(ts) if isinstance(ts, str) else ts
    day_us = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    sod = (F.hour(t) * 3600 + F.minute(t) * 60).cast("bigint") * 1_000_000
    return day_us + sod + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def event_time(ts):
    """A TIMESTAMP event-time column from a timestamp_ntz: the wall clock taken as UTC."""
    return F.timestamp_micros(micros(ts))


# ----------------------------------------------------------------------------------- STR2

def endpoint_metrics(events: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """STR2: per endpoint and tumbling window: count, total/avg/min/max time, errors, error rate.
    Works on a stream (watermarked, append mode) and on a batch frame alike."""
    err = (F.col("event_type") == "error").cast("int")
    ev, t = events, "ts"
    if events.isStreaming:  # watermarks need a TIMESTAMP: the wall clock read as UTC, zone free
        ev, t = events.withColumn("_et", event_time("ts")).withWatermark("_et", watermark), "_et"
    g = ev.groupBy(F.window(t, window).alias("w"), F.col("event_type").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("total_time"), F.avg("value").alias("avg_time"),
        F.min("value").alias("min_time"), F.max("value").alias("max_time"), F.sum(err).alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint", "count",
                    "total_time", "avg_time", "min_time", "max_time", "errors",
                    (F.col("errors") / F.col("count")).alias("error_rate"))


def metrics_summary(events: DataFrame) -> DataFrame:
    """STR2 overall summary: requests, mean time, errors and error rate over all endpoints."""
    err = (F.col("event_type") == "error").cast("int")
    return events.agg(F.count(F.lit(1)).alias("total_requests"), F.avg("value").alias("avg_time"),
                      F.sum(err).alias("total_errors")).withColumn(
        "error_rate", F.col("total_errors") / F.col("total_requests"))


# ----------------------------------------------------------------------------------- STR1 (all attempts)

def rate_limit_all(events: DataFrame, limit: int = 100, window_s: int = 60) -> DataFrame:
    """STR1, all-attempts variant: requests by the same client in (ts - window, ts);
    rejected when that count reaches `limit`; retry after window - (ts - oldest).

    Sliding counts run per (client, hour bucket); every request is also copied, as a
    halo, into each later bucket that its window reaches, so the result is exact for
    windows of any length and a busy client is spread over its buckets instead of one task."""
    w_us = window_s * 1_000_000
    hour_us = 3_600_000_000
    d = events.withColumns({"_us": micros("ts"), "_own": hour_bucket("ts")})
    last = F.expr(f"(_us + {w_us - 1}) div {hour_us}")  # bucket of the latest moment that still counts this request
    u = d.withColumn("_b", F.explode(F.sequence("_own", F.greatest("_own", last)))).withColumn("_halo", F.col("_b") != F.col("_own"))
    w = Window.partitionBy("user_id", "_b").orderBy("_us").rangeBetween(-(w_us - 1), -1)
    out = u.select("*", F.count(F.lit(1)).over(w).alias("prior_requests"), F.min("_us").over(w).alias("_oldest"))
    out = out.where(~F.col("_halo"))
    rejected = F.col("prior_requests") >= limit
    retry = F.greatest(F.lit(float(window_s)) - (F.col("_us") - F.col("_oldest")) / 1e6, F.lit(1.0))
    return out.select("event_id", "ts", F.col("user_id").alias("client_id"), "prior_requests",
                      (~rejected).alias("allowed"), F.when(rejected, retry).otherwise(F.lit(0.0)).alias("retry_after"))


# ----------------------------------------------------------------------------------- STR1 (accepted only)

ACCEPT_SCHEMA = "event_id long, ts timestamp_ntz, client_id long, allowed boolean, retry_after double"
ACCEPT_STATE = "accepted array<long>"


def _accept_fn(limit: int, window_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        out = []
        # a client's rows of one micro-batch (bounded by its trigger) come in several Arrow batches: order them together
        got = list(pdfs)
        for pdf in [pd.concat(got).sort_values(["_us", "event_id"])] if got else []:
            for eid, ts, us in zip(pdf["event_id"], pdf["ts"], pdf["_us"]):
                cutoff = us - window_us
                while accepted and accepted[0] < cutoff:
                    accepted.pop(0)
                if len(accepted) >= limit:
                    retry = max(window_us / 1e6 - (us - accepted[0]) / 1e6, 1.0)
                    out.append((eid, ts, key[0], False, retry))
                else:
                    accepted.append(int(us))
                    out.append((eid, ts, key[0], True, 0.0))
        state.update((accepted,))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "ts", "client_id", "allowed", "retry_after"])
    return fn


def rate_limit_accepted(events: DataFrame, limit: int = 100, window_s: int = 60) -> DataFrame:
    """STR1, in-process variant: only accepted requests count toward the limit.

    A sequential decision per client, kept in bounded state (at most `limit`
    timestamps) by `applyInPandasWithState`; clients are processed in parallel."""
    d = events.withColumn("_us", micros("ts")).select("event_id", "ts", "user_id", "_us")
    return d.groupBy("user_id").applyInPandasWithState(
        _accept_fn(limit, window_s * 1_000_000), ACCEPT_SCHEMA, ACCEPT_STATE, "append", GroupStateTimeout.NoTimeout)


def rate_limit_accepted_batch(events: DataFrame, limit: int = 100, window_s: int = 60) -> DataFrame:
    """STR1, accepted-only variant over a table: chains of time buckets instead of a task per client."""
    d = accept_within_limit(events.select("event_id", "user_id", micros("ts").alias("_us")), "user_id", "_us", "event_id", limit, window_s)
    at = events.select(F.col("event_id").alias("_e"), F.col("user_id").alias("_c"), "ts")
    return d.join(at, (F.col("event_id") == F.col("_e")) & F.col("user_id").eqNullSafe(F.col("_c"))).select("event_id", "ts", F.col("user_id").alias("client_id"), "allowed", "retry_after")


# ----------------------------------------------------------------------------------- STR2 (periods that reset themselves)

def endpoint_periods(events: DataFrame, window_s: int = RESET_S) -> DataFrame:
    """STR2 with its lazy reset, over a table: one row per endpoint and period."""
    return periods(period_rollup().partial(reset_windows(events.withColumn("_us", micros("ts")), "event_type", "_us", window_s)))


def endpoint_periods_stream(stream: DataFrame, window_s: int = RESET_S) -> DataFrame:
    """The same from a replayed stream: all rows come from its stored partial sums."""
    import uuid
    spark, run = stream.sparkSession, f"endpoint_periods_{uuid.uuid4().hex[:8]}"
    ensure_checkpoint_dir(spark)
    store = ResetStore(spark, shared_path(spark, f"stream_rollup/{run}"), window_s)
    return periods(run_rollup(stream.withColumn("_us", micros("ts")), store, shared_path(spark, f"stream_ckpt/{run}"), {"window_us": "long"}))


# ----------------------------------------------------------------------------------- STR3

def joblog_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def daily_rollup(jobs: DataFrame, watermark: str = "1 day") -> DataFrame:
    """STR3: per day: jobs, mean efficiency, total downtime (incremental with a watermark)."""
    j, t = jobs, "StartTime"
    if jobs.isStreaming:
        j, t = jobs.withColumn("_et", event_time("StartTime")).withWatermark("_et", watermark), "_et"
    g = j.groupBy(F.window(t, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("jobs"), F.avg("efficiency").alias("avg_efficiency"),
        F.sum("total_downtime").alias("total_downtime"))
    return g.select(F.col("w.start").alias("day"), "jobs", "avg_efficiency", "total_downtime")


# ----------------------------------------------------------------------------------- stored rollups

def endpoint_rollup(window: str = "5 minutes") -> Rollup:
    """STR2 as partial sums by tumbling window and endpoint."""
    w = F.window("ts", window)
    return Rollup({"window_start": w["start"], "window_end": w["end"], "endpoint": F.col("event_type")},
                  {"count": (F.count(F.lit(1)), "sum"), "timed": (F.count("value"), "sum"), "total_time": (F.sum("value"), "sum"), "min_time": (F.min("value"), "min"),
                   "max_time": (F.max("value"), "max"), "errors": (F.sum((F.col("event_type") == "error").cast("int")), "sum")})


def endpoint_metrics_of(rollup: DataFrame) -> DataFrame:
    """The columns of `endpoint_metrics` from its stored rollup."""
    return rollup.select("window_start", "window_end", "endpoint", "count", "total_time", (F.col("total_time") / F.col("timed")).alias("avg_time"), "min_time", "max_time", "errors",
                         (F.col("errors") / F.col("count")).alias("error_rate"))


def daily_partials() -> Rollup:
    """STR3 as partial sums by day."""
    return Rollup({"day": F.window("StartTime", "1 day")["start"]},
                  {"jobs": (F.count(F.lit(1)), "sum"), "rated": (F.count("efficiency"), "sum"), "efficiency": (F.sum("efficiency"), "sum"), "total_downtime": (F.sum("total_downtime"), "sum")})


def daily_rollup_of(rollup: DataFrame) -> DataFrame:
    return rollup.select("day", "jobs", (F.col("efficiency") / F.col("rated")).alias("avg_efficiency"), "total_downtime")


# ----------------------------------------------------------------------------------- running

def run_available(stream: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available (trigger availableNow) into a
    parquet sink under the shared checkpoint folder, then read the result back."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    import uuid
    run = f"{name}_{uuid.uuid4().hex[:8]}"
    out, ckpt = shared_path(spark, f"stream_out/{run}"), shared_path(spark, f"stream_ckpt/{run}")
    q = (stream.writeStream.format("parquet").outputMode(output_mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


def run_stored(stream: DataFrame, name: str, rollup: Rollup) -> DataFrame:
    """Replay everything available into a new stored rollup under the shared checkpoint folder and read it."""
    import uuid
    spark, run = stream.sparkSession, f"{name}_{uuid.uuid4().hex[:8]}"
    ensure_checkpoint_dir(spark)
    return run_rollup(stream, Store(spark, shared_path(spark, f"stream_rollup/{run}"), rollup), shared_path(spark, f"stream_ckpt/{run}"))
