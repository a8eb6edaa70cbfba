"""Greedy choices along each key's time line, without one task per key.

* `reset_windows`: a window opens at a key's first row and the first row later than `window_s` seconds after the opening opens the
  next one (a counter that resets itself when it is next used). Where a window opens depends on all openings before it. Time is
  cut into buckets of `bucket_s`; a bucket is the function from the last opening before it to the last opening in it. That
  function has one step for each different time in the bucket's first `window_s`, found by doubling jump pointers (each
  time's next opening). Functions of FAN buckets in a row compose into one, level by level, until a key has a single one; going
  down again, every bucket learns the last opening before it. Each step works on one bucket or FAN functions.
* `accept_within_limit`: a row is accepted if fewer than `limit` accepted rows lie in the `window_s` seconds up to it. Its state,
  the last `limit` accepted times, has no such small table, so buckets are joined into chains wherever the key pauses for
  less than a window (after a longer pause the state is empty), and a chain is streamed in order through one task that holds
  one bucket and the state. Inside a full window the stream jumps over the rejected rows, so its steps are at most
  `limit` a window, whatever the traffic. A key without pauses is one chain.

A bucket's different times (for `accept_within_limit` its rows) are one array: choose `bucket_s` for the busiest key.
Null keys are a key of their own; rows without a time get no window, and are neither accepted nor counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN = 32
NEVER = -(1 << 62)  # no opening yet


def _stored(df: DataFrame, what: str) -> DataFrame:
    return cut_lineage(df, f"greedy_{what}_{uuid.uuid4().hex[:8]}")


def _bucket(us: str | Column, size: int) -> Column:
    t = F.col(us) if isinstance(us, str) else us
    return ((t - F.pmod(t, F.lit(size))) / size).cast("long")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of each row's list."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (flat[a:b] for a, b in zip(at[:-1], at[1:]))


def _as_lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _with_lists(batch: pa.RecordBatch, keep: list[str], lists: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    arrays = [batch.column(c) for c in keep] + [_as_lists(rows, pa.int64()) for rows in lists.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *lists])


# ------------------------------------------------------------------------------ windows that reset themselves

def _steps(window: int, size: int) -> Callable:
    """Buckets' functions: `entry` ascending and `exit`: an opening later than `entry[i - 1]` but not later than `entry[i]` leads to
    `exit[i]`; beyond the last entry nothing opens."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, leave = [], []
            for b, times in zip(batch.column("b").to_pylist(), _lists(batch.column("times"))):
                last = np.searchsorted(times, times + window, "right")
                last = np.where(last < len(times), last, np.arange(len(times)))  # a last opening points to itself
                while True:
                    further = last[last]
                    if np.array_equal(further, last):
                        break
                    last = further
                n = min(int(np.searchsorted(times, b * size + window, "right")) + 1, len(times))
                entry.append(times[:n])
                leave.append(times[last[:n]])
            yield _with_lists(batch, ["key", "b"], {"entry": entry, "exit": leave})
    return fn


def _children(batch: pa.RecordBatch) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """(bucket, entry, exit) of each row's children, in order."""
    at, flat = batch.column("children").offsets.to_numpy(), batch.column("children").values
    buckets, entry, leave = flat.field("b").to_pylist(), list(_lists(flat.field("entry"))), list(_lists(flat.field("exit")))
    return ([(buckets[i], entry[i], leave[i]) for i in range(a, b)] for a, b in zip(at[:-1], at[1:]))


def _through(opened: np.ndarray, entry: np.ndarray, leave: np.ndarray, window: int) -> np.ndarray:
    """Last openings after a bucket, from the last ones before it."""
    at = np.searchsorted(entry, opened + window, "right")
    return np.where(at < len(entry), leave[np.minimum(at, len(entry) - 1)], opened)


def _compose(window: int) -> Callable:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, leave = [], []
            for children in _children(batch):
                # an opening before these buckets ends before the second one begins, so only its first time can follow
                (_, begins, opened), rest = children[0], children[1:]
                if rest:
                    begins, opened = np.append(begins, rest[0][1][0]), np.append(opened, rest[0][2][0])
                for i, (_, e, x) in enumerate(rest):
                    opened = np.append(_through(opened[:-1], e, x, window), opened[-1]) if i == 0 else _through(opened, e, x, window)
                entry.append(begins)
                leave.append(opened)
            yield _with_lists(batch, ["key", "b"], {"entry": entry, "exit": leave})
    return fn


def _descend(window: int) -> Callable:
    """The last opening before each child (`before`)."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, before = [], []
            for opened, children in zip(batch.column("before").to_pylist(), _children(batch)):
                told, now = [], np.array([opened])
                for _, entry, leave in children:
                    told.append(int(now[0]))
                    now = _through(now, entry, leave, window)
                buckets.append(np.array([b for b, _, _ in children]))
                before.append(np.array(told))
            yield _with_lists(batch, ["key"], {"b": buckets, "before": before})
    return fn


def _openings(window: int) -> Callable:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = []
            for before, times in zip(batch.column("before").to_pylist(), _lists(batch.column("times"))):
                found, at = [], int(np.searchsorted(times, before + window, "right"))
                while at < len(times):  # at most bucket / window + 1 steps
                    found.append(times[at])
                    at = int(np.searchsorted(times, times[at] + window, "right"))
                opened.append(np.array(found, dtype=np.int64))
            yield _with_lists(batch, ["key", "b", "before"], {"opened": opened})
    return fn


def reset_windows(df: DataFrame, key: str, us: str, window_s: int, carried: DataFrame | None = None, bucket_s: int = 900) -> DataFrame:
    """Add `window_us`, the time (microseconds, column `us`) at which the row's window opened.

    `carried` (key, window_us) names windows already open; rows earlier than their opening belong to them too. A row without a time
    has no window (null)."""
    if window_s < 1:
        raise ValueError("a window lasts a second or more")
    window, size = window_s * 1_000_000, max(window_s, bucket_s) * 1_000_000
    kind = df.schema[key].dataType.simpleString()
    out = [*df.columns]
    if carried is None:
        df = df.withColumn("_held", F.lit(None).cast("long"))
    else:  # one row for each key
        df = df.join(carried.select(F.col(key).alias("_c"), F.col("window_us").alias("_held")), F.col(key).eqNullSafe(F.col("_c")), "left").drop("_c")
    free = F.col("_held").isNull() | (F.col(us) > F.col("_held") + window)  # rows of an open window open none
    named = df.where(F.col(us).isNotNull() & free).select(F.col(key).alias("key"), F.col(us).alias("_t"), _bucket(us, size).alias("b"))
    times = _stored(named.groupBy("key", "b").agg(F.sort_array(F.collect_set("_t")).alias("times")), "times")
    ends = times.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends and ends["lo"] is not None else (0, 0)
    function = f"key {kind}, b long, entry array<long>, exit array<long>"
    levels, width = [], 1
    now = _stored(times.mapInArrow(_steps(window, size), function), "steps")
    while True:
        width *= FAN
        up = F.expr(f"(b - {lo}L) div {width}L * {width}L + {lo}L")
        grouped = now.groupBy("key", up.alias("_g")).agg(F.sort_array(F.collect_list(F.struct("b", "entry", "exit"))).alias("children")).withColumnRenamed("_g", "b")
        levels.append(_stored(grouped, "level"))
        if hi - lo < width:
            break
        now = levels[-1].mapInArrow(_compose(window), function)
    before = levels[-1].select("key", "b", F.lit(NEVER).alias("before"))
    for level in reversed(levels):
        known = before.select(F.col("key").alias("_k"), F.col("b").alias("_b"), "before")
        inside = level.join(known, F.col("key").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b"))).select("key", "before", "children")
        told = inside.mapInArrow(_descend(window), f"key {kind}, b array<long>, before array<long>")
        before = told.select("key", F.explode(F.arrays_zip("b", "before")).alias("z")).select("key", "z.b", "z.before")
    known = before.select(F.col("key").alias("_k"), F.col("b").alias("_b"), "before")
    inside = times.join(known, F.col("key").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b"))).select("key", "b", "before", "times")
    opened = _stored(inside.mapInArrow(_openings(window), f"key {kind}, b long, before long, opened array<long>"), "opened").select(
        F.col("key").alias("_k"), F.col("b").alias("_b"), F.col("before").alias("_before"), F.col("opened").alias("_opened"))
    # a bucket has few openings; a row takes the latest one up to it, else the last one before the bucket
    rows = df.join(opened, F.col(key).eqNullSafe(F.col("_k")) & (_bucket(us, size) == F.col("_b")), "left")
    latest = F.array_max(F.filter("_opened", lambda t: t <= F.col(us)))
    window_us = F.when(F.col(us).isNotNull(), F.coalesce(latest, F.when(F.col("_before") > NEVER, F.col("_before")), "_held"))
    return rows.select(*out, window_us.alias("window_us"))


# ------------------------------------------------------------------------------ at most `limit` accepted in a window

def admitted(times: np.ndarray, state: list[int], limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(accepted?, for rejected rows the oldest accepted time that counts) for ascending times; `state` (the accepted times that
    may still count) is carried on in place."""
    ok, oldest = np.zeros(len(times), dtype=bool), np.zeros(len(times), dtype=np.int64)
    at = 0
    while at < len(times):
        now = int(times[at])
        while state and state[0] < now - window:
            state.pop(0)
        if len(state) < limit:
            ok[at] = True
            state.append(now)
            at += 1
        else:  # full until the oldest one goes: all rows up to then are rejected
            after = max(int(np.searchsorted(times, state[0] + window, "right")), at + 1)
            oldest[at:after] = state[0]
            at = after
    return ok, oldest


def _admit(limit: int, window: int) -> Callable:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, state = None, []
        for batch in batches:
            ok, oldest = [], []
            rows = batch.column("rows")
            at, flat = rows.offsets.to_numpy(), rows.values.field("us").to_numpy(zero_copy_only=False)
            for own, a, b in zip(zip(batch.column("key").to_pylist(), batch.column("chain").to_pylist()), at[:-1], at[1:]):
                if own != chain:
                    chain, state = own, []
                accepted, old = admitted(flat[a:b], state, limit, window)
                ok.append(accepted)
                oldest.append(old)
            yield pa.RecordBatch.from_arrays([batch.column("key"), rows, _as_lists(ok, pa.bool_()), _as_lists(oldest, pa.int64())], names=["key", "rows", "ok", "oldest"])
    return fn


def accept_within_limit(df: DataFrame, key: str, us: str, tie: str, limit: int, window_s: int, bucket_s: int = 900) -> DataFrame:
    """(key, `tie`, `us`, allowed, retry_after) of each row with a time; rows of one time come in the order of `tie`."""
    if limit < 1:
        raise ValueError("the limit is at least 1")
    window, size = window_s * 1_000_000, bucket_s * 1_000_000
    kind, tied = (df.schema[c].dataType.simpleString() for c in (key, tie))
    named = df.where(F.col(us).isNotNull()).select(F.col(key).alias("key"), _bucket(us, size).alias("b"), F.struct(F.col(us).alias("us"), F.col(tie).alias("tie")).alias("r"))
    buckets = _stored(named.groupBy("key", "b").agg(F.min("r.us").alias("lo"), F.max("r.us").alias("hi"), F.sort_array(F.collect_list("r")).alias("rows")), "rows")
    w = Window.partitionBy("key").orderBy("b")  # one short row for each bucket of a key
    pause = buckets.select(F.col("key").alias("_k"), F.col("b").alias("_b"), (F.coalesce(F.col("lo") - F.lag("hi").over(w) > window, F.lit(True))).cast("int").alias("_cut"))
    chains = pause.withColumn("chain", F.sum("_cut").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    linked = buckets.join(chains, F.col("key").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b"))).select("key", "chain", "b", "rows")
    ordered = linked.repartition("key", "chain").sortWithinPartitions("key", "chain", "b")
    rows = f"array<struct<us:bigint,tie:{tied}>>"
    done = ordered.mapInArrow(_admit(limit, window), f"key {kind}, rows {rows}, ok array<boolean>, oldest array<long>")
    each = done.select("key", F.explode(F.arrays_zip("rows", "ok", "oldest")).alias("z"))
    retry = F.greatest(F.lit(float(window_s)) - (F.col("z.rows.us") - F.col("z.oldest")) / 1e6, F.lit(1.0))
    return each.select(F.col("key").alias(key), F.col("z.rows.tie").alias(tie), F.col("z.rows.us").alias(us), F.col("z.ok").alias("allowed"),
                       F.when(F.col("z.ok"), F.lit(0.0)).otherwise(retry).alias("retry_after"))
