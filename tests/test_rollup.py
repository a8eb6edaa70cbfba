"""Stored rollups: replayed batches, restarts, part-written folders and merges; the exact stratified split."""

import collections
import os
import random

from pyspark.sql import functions as F

from lathe.models.metrics import stratified_split_flag
from lathe.streaming import ops
from lathe.streaming.rollup import Rollup, Store, run_rollup

def sums():
    return Rollup({"k": F.col("k")}, {"n": (F.count(F.lit(1)), "sum"), "s": (F.sum("v"), "sum"), "lo": (F.min("v"), "min"), "hi": (F.max("v"), "max")})


def want(rows):
    groups = collections.defaultdict(list)
    for k, v in rows:
        groups[k].append(v)
    return {(k, len(v), sum(v), min(v), max(v)) for k, v in groups.items()}


def test_replays_count_once(spark, tmp_path):
    store, every = Store(spark, str(tmp_path / "r"), sums(), compact_after=3), []
    assert store.read() is None
    rng = random.Random(1)
    for number in range(8):
        rows = [(rng.choice("ab"), rng.randint(0, 99)) for _ in range(20)]
        every += rows
        frame = spark.createDataFrame(rows, "k string, v long")
        store.add(frame, number)
        store.add(frame, number)  # not seen committed: once more
        assert set(map(tuple, store.read().collect())) == want(every)
    names = sorted(os.listdir(tmp_path / "r"))
    assert len(names) <= 3 and any(n.startswith("upto-") for n in names)
    store.add(spark.createDataFrame([("z", 1)], "k string, v long"), 2)  # merged long ago
    os.makedirs(tmp_path / "r" / "batch-99")  # a batch whose writer was lost
    assert set(map(tuple, store.read().collect())) == want(every)


def test_stream_restarts_where_it_stood(spark, tmp_path):
    def add(name, rows):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    stream = lambda: spark.readStream.schema("k string, v long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, checkpoint = Store(spark, str(tmp_path / "r"), sums(), compact_after=2), str(tmp_path / "c")
    add("a", [("a", 1), ("b", 2)])
    add("b", [("a", 5)])
    assert set(map(tuple, run_rollup(stream(), store, checkpoint).collect())) == {("a", 2, 6, 1, 5), ("b", 1, 2, 2, 2)}
    assert set(map(tuple, run_rollup(stream(), store, checkpoint).collect())) == {("a", 2, 6, 1, 5), ("b", 1, 2, 2, 2)}
    add("late", [("a", -7)])
    assert set(map(tuple, run_rollup(stream(), store, checkpoint).collect())) == {("a", 3, -1, -7, 5), ("b", 1, 2, 2, 2)}
    # the engine loses its last commit: the batch is repeated
    commits = tmp_path / "c" / "commits"
    for f in sorted((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))[-1:]:
        f.rename(tmp_path / "uncommitted")
        crc = commits / f".{f.name}.crc"
        if crc.exists():
            crc.rename(tmp_path / "uncommitted.crc")
    assert set(map(tuple, run_rollup(stream(), store, checkpoint).collect())) == {("a", 3, -1, -7, 5), ("b", 1, 2, 2, 2)}


def test_late_and_out_of_order_events_all_count(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00", 1, rng.choice(["view", "error"]), rng.random(), "") for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    stream = spark.readStream.schema(ops.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    got = ops.endpoint_metrics_of(ops.run_stored(stream, "late", ops.endpoint_rollup()))
    plain = ops.endpoint_metrics(frame)
    rounded = lambda df: {(str(r.window_start), r.endpoint, r["count"], round(r.total_time, 9), round(r.avg_time, 9), r.min_time, r.max_time, r.errors, r.error_rate) for r in df.collect()}
    assert rounded(got) == rounded(plain)


def test_stratified_split_is_exact(spark):
    sizes = {"hot": 700, "b": 101, "c": 9, "one": 1, None: 33}
    rows = [(f"{k}-{i}", k, 1.0) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "key string, label string, _x double")
    flagged = stratified_split_flag(df.repartition(7), "key", "label")
    assert flagged.columns == ["key", "label", "_x", "is_train"]
    got = {r.label: r.n for r in flagged.where("is_train").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[k] - 0.8 * n) < 1 for k, n in sizes.items()) and flagged.count() == len(rows)
    again = {r.key for r in stratified_split_flag(df.coalesce(1), "key", "label").where("is_train").collect()}
    assert again == {r.key for r in flagged.where("is_train").collect()}
    assert stratified_split_flag(df.where("key = ''"), "key", "label").count() == 0
