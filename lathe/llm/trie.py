"""Conversation prefix trie by time-forward processing.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. Counts, children,
leaves and the code points that sharing the prefix saves are computed for each node and its subtree.

1. Turns are digested (128 bits of role and text) and dealt by ranges of (base, conversation, turn), so a conversation of any
   length is spread; the few conversations and bases that cross a border get their counts from a table of at most two rows a part.
   Conversations may take their first turns from another one (`base`, `head`). A prefix's key is the sum over its turns of a hash
   of depth and digest: such sums run within a part and are completed by what earlier parts carry over.
2. A conversation's prefixes are stored as paths of at most `height` levels. A node is heavy if more than `load` steps of paths lie
   in its subtree; `load` is such that at most HEAVY nodes of a slab of levels are. The subtrees below heavy nodes are the shards.
3. Nodes are aggregated, sorted externally by shard in reverse level order, and streamed: each node takes the totals sent to it
   from a priority queue, adds its own, and sends the sum to its parent, one level up. The queue holds sorted runs, the larger
   of which are spilled to the task's scratch folder, so a task's memory does not depend on a shard's size.
4. The totals of shard roots are added up by parent and passed on in the same way through the heavy nodes, level by level to the
   root; slabs of `height` levels are processed from the deepest up. So every node is read once, however deep the trie.

The digest of a node's member ids is of one long string: it is joined in parts by range of ids and hashed as a stream, since
SHA-256 knows no other way; nodes with few members are hashed where they are grouped.

Defined results: null roles and texts are empty ones; turns are ordered null first, rows of one turn by digest, repeated rows count
each; rows without conversation id belong to no conversation; a turnless conversation is a member of the root alone; an empty
table has no root; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, written

PART = 200_000  # turns of a range
HEIGHT = 1024  # levels of a path
LOAD = 1 << 10  # steps of paths in a shard, at least
HEAVY = 1 << 17  # heavy nodes of a slab, at most
QUEUE = 1 << 20  # messages that a queue holds in memory
ENDS = 4096  # member ids hashed in one group, at least
LOW = 0xFFFFFFFF


def _digests(conversations: DataFrame, names: tuple[str, ...], base: Column | None) -> DataFrame:
    conv, turn, role, text = (F.col(f"`{n}`") for n in names)
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(conv.cast("long").alias("conv"), turn.alias("turn"), *[F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(n) for at, n in ((1, "m1"), (17, "m2"))],
                                F.length(text).cast("long").alias("len")).where("conv is not null")
    return rows.withColumn("block", F.col("conv") if base is None else base.cast("long"))


def _paths(turns: DataFrame, head: Column, limit: int, height: int) -> DataFrame:
    """(conv, depth, slab, top1, top2, path of (d, k1, k2, len)) from dealt turns."""
    row = F.struct("block", "conv")
    edges = turns.groupBy("part").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    edges = written(edges.select("part", F.explode(F.array("lo", "hi")).alias("e")).select("part", "e.block", "e.conv").distinct(), "edges")

    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.join(F.broadcast(edges.select("part", "conv")), ["part", "conv"], "left_semi").groupBy("part", "conv").agg(F.count("*").alias("n"))
    spans = counts.select("part", "conv", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("conv")).alias("total"),
                          F.count("*").over(Window.partitionBy("conv")).alias("parts")).where("parts > 1").drop("parts")
    spans = written(spans, "spans")
    order = [F.asc_nulls_first("turn"), "m1", "m2"]
    first = F.struct("i", "m1", "m2", "len")
    split = edges.groupBy("block").agg(F.countDistinct("part").alias("parts")).where("parts > 1").select("block")
    bases = turns.where("conv = block").join(F.broadcast(split), "block", "left_semi")
    bases = bases.withColumn("i", F.row_number().over(Window.partitionBy("conv").orderBy(*order))).where(F.col("i") <= limit)
    bases = split.join(bases.groupBy("block").agg(F.sort_array(F.collect_list(first)).alias("found")), "block", "left") \
        .select("block", F.lit(True).alias("split"), "found")

    own = Window.partitionBy("part", "block", "conv")
    rows = turns.repartition("part", "block").join(F.broadcast(spans), ["part", "conv"], "left").join(F.broadcast(written(bases, "bases")), "block", "left")
    rows = rows.withColumn("i", (F.row_number().over(own.orderBy(*order)) + F.coalesce("offset", F.lit(0))).cast("int"))
    rows = rows.withColumn("n", F.coalesce("total", F.count("*").over(own)))
    here = F.collect_list(F.when((F.col("conv") == F.col("block")) & (F.col("i") <= limit), first)).over(Window.partitionBy("part", "block"))
    rows = rows.withColumn("begin", F.sort_array(here))
    rows = rows.withColumn("begin", F.coalesce("found", F.when(F.col("split"), F.filter("begin", lambda x: F.lit(False))).otherwise(F.col("begin"))))
    rows = rows.withColumn("h", F.when(F.col("conv") == F.col("block"), 0).otherwise(head).cast("int")).withColumn("m", F.least("h", F.size("begin")))
    mine = F.when(F.col("i") > F.col("h"), F.array(F.struct((F.col("i") - F.col("h") + F.col("m")).alias("i"), "m1", "m2", "len"))).otherwise(F.filter("begin", lambda x: F.lit(False)))
    steps = F.when(F.col("i") == 1, F.concat(F.slice("begin", 1, F.col("m")), mine)).otherwise(mine)
    rows = rows.select("part", "block", "conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"), "i", steps.alias("steps")) \
        .where((F.col("i") == 1) | (F.size("steps") > 0)).select("part", "block", "conv", "depth", F.explode_outer("steps").alias("step"))
    d = F.col("step.i")
    one, two = F.xxhash64(d, "step.m1", "step.m2"), F.xxhash64("step.m2", d, "step.m1")
    pieces = [F.shiftrightunsigned(one, 32), one.bitwiseAND(LOW), F.shiftrightunsigned(two, 32), two.bitwiseAND(LOW)]
    running = own.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("part", "block", "conv", "depth", d.alias("d"), F.col("step.len").alias("len"), *[F.when(d.isNotNull(), p).alias(f"f{j}") for j, p in enumerate(pieces)])
    rows = rows.select("*", *[F.sum(f"f{j}").over(running).alias(f"s{j}") for j in range(4)])
    grouped = rows.groupBy("part", "block", "conv", "depth", F.coalesce(F.floor((F.col("d") - 1) / height), F.lit(0)).cast("int").alias("slab")).agg(
        F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "s0", "s1", "s2", "s3", "len")))).alias("path"),
        *[F.min_by(F.col(f"s{j}") - F.col(f"f{j}"), "d").alias(f"t{j}") for j in range(4)])
    stored = written(grouped.drop("block"), "paths")

    # what earlier parts carry over, and one path for each slab of a conversation that crosses a border
    last = stored.join(F.broadcast(spans.select("part", "conv")), ["part", "conv"], "left_semi").where("size(path) > 0") \
        .groupBy("part", "conv").agg(F.max_by(F.try_element_at("path", F.lit(-1)), "slab").alias("e"))
    carried = written(last.select("part", "conv", *[F.coalesce(F.sum(f"e.s{j}").over(before), F.lit(0)).alias(f"c{j}") for j in range(4)]), "carried")
    whole = stored.join(F.broadcast(carried), ["part", "conv"], "left").join(F.broadcast(spans.select("conv").distinct().withColumn("crosses", F.lit(True))), "conv", "left")
    key = lambda x, y: F.shiftleft(x, 32).bitwiseOR(y.bitwiseAND(LOW))
    c = [F.coalesce(f"c{j}", F.lit(0)) for j in range(4)]
    path = F.transform("path", lambda x: F.struct(x["d"].alias("d"), key(x["s0"] + c[0], x["s1"] + c[1]).alias("k1"), key(x["s2"] + c[2], x["s3"] + c[3]).alias("k2"), x["len"].alias("len")))
    top = [F.coalesce(key(F.col(f"t{j}") + c[j], F.col(f"t{j + 1}") + c[j + 1]), F.lit(0)).alias(n) for j, n in ((0, "top1"), (2, "top2"))]
    whole = whole.select("conv", "depth", "slab", "crosses", *top, path.alias("path"))
    joined = whole.where("crosses").groupBy("conv", "depth", "slab").agg(F.min_by("top1", F.coalesce(F.try_element_at("path", F.lit(1))["d"], F.lit(0))).alias("top1"),
                                                                       F.min_by("top2", F.coalesce(F.try_element_at("path", F.lit(1))["d"], F.lit(0))).alias("top2"), F.sort_array(F.flatten(F.collect_list("path"))).alias("path"))
    joined = joined.where("size(path) > 0 or depth = 0")
    return whole.where("crosses is null").drop("crosses").unionByName(joined)


class Heavy:
    """Sorted keys of heavy nodes."""

    def __init__(self, keys: np.ndarray):
        keys = keys.reshape(-1, 2)
        self.k1, self.k2 = keys[np.lexsort((keys[:, 1], keys[:, 0]))].T.copy()

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        return _find(self.k1, self.k2, k1, k2) >= 0


def _find(in1: np.ndarray, in2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Places of keys among sorted ones (-1: not there)."""
    if not len(in1):
        return np.full(len(k1), -1)
    at = np.searchsorted(in1, k1)
    end = len(in1)
    while True:
        here = np.minimum(at, end - 1)
        step = (at < end) & (in1[here] == k1) & (in2[here] < k2)
        if not step.any():
            return np.where((at < end) & (in1[here] == k1) & (in2[here] == k2), at, -1)
        at = at + step


STEPS = ("slab int, light boolean, r1 long, r2 long, d int, k1 long, k2 long, p1 long, p2 long, under boolean, conv long, len long, ends boolean")


def _steps(keys):
    """paths -> a row for each step: its shard root's key (light), its parent's key, and whether the parent is heavy (under)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = Heavy(keys.value)
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = table["path"]
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            flat = lists.flatten()
            d, k1, k2, length = (np.asarray(flat.field(n)).astype(np.int64) for n in ("d", "k1", "k2", "len"))
            ends = np.cumsum(sizes)
            starts, some = (ends - sizes)[sizes > 0], np.flatnonzero(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            slab, depth, conv, top1, top2 = (np.asarray(table[n]).astype(np.int64) for n in ("slab", "depth", "conv", "top1", "top2"))
            marked = heavy.has(k1, k2)
            count = np.zeros(len(sizes), dtype=np.int64)
            if len(some):
                count[some] = np.add.reduceat(marked.astype(np.int64), starts)
            root = np.minimum((ends - sizes + count)[owner], len(d) - 1)
            p1, p2 = np.concatenate([[0], k1[:-1]])[:len(k1)], np.concatenate([[0], k2[:-1]])[:len(k2)]
            p1[starts], p2[starts] = top1[some], top2[some]
            under = np.concatenate([[False], marked[:-1]])[:len(marked)]
            under[starts] = slab[some] == 0
            light = ~marked
            yield pa.RecordBatch.from_arrays(
                [pa.array(slab[owner], pa.int32()), pa.array(light), pa.array(np.where(light, k1[root], 0)), pa.array(np.where(light, k2[root], 0)), pa.array(d, pa.int32()), pa.array(k1), pa.array(k2),
                 pa.array(p1), pa.array(p2), pa.array(under), pa.array(conv[owner]), pa.array(length), pa.array(d == depth[owner])],
                names=["slab", "light", "r1", "r2", "d", "k1", "k2", "p1", "p2", "under", "conv", "len", "ends"])
    return run


class Queue:
    """Messages (key, children, leaves, saved) to nodes of one level, taken in ascending order of keys.

    Up to `limit` are held; beyond that, sorted runs with the messages to one node added up go to files."""

    def __init__(self, limit: int, scratch: str):
        self.limit, self.scratch = limit, scratch
        self.held: list[np.ndarray] = []
        self.size = 0
        self.runs: list[np.ndarray] = []
        self.at: list[int] = []
        self.files: list[str] = []

    def send(self, messages: np.ndarray) -> None:
        """5 x n integers: two of the key, three totals."""
        self.held.append(messages)
        self.size += messages.shape[1]
        if self.size >= self.limit:
            run = self._sorted()
            name = os.path.join(self.scratch, f"{id(self)}-{len(self.files)}.npy")
            np.save(name, run)
            self.files.append(name)
            self._keep(np.load(name, mmap_mode="r"))

    def _sorted(self) -> np.ndarray:
        every = np.concatenate(self.held, axis=1) if self.held else np.zeros((5, 0), np.int64)
        self.held, self.size = [], 0
        return added(every)

    def _keep(self, run: np.ndarray) -> None:
        self.runs.append(run)
        self.at.append(0)

    def close(self) -> None:
        """No more messages come."""
        self._keep(self._sorted())

    def take(self, k1: int, k2: int) -> np.ndarray:
        """The messages to keys up to (k1, k2), added up."""
        found = []
        for i, run in enumerate(self.runs):
            a = self.at[i]
            b = a + int(np.searchsorted(run[0, a:], k1, "right"))
            while b > a and run[0, b - 1] == k1 and run[1, b - 1] > k2:
                b -= 1
            found.append(np.asarray(run[:, a:b]))
            self.at[i] = b
        return added(np.concatenate(found, axis=1)) if found else np.zeros((5, 0), np.int64)

    def drop(self) -> None:
        if any(a < run.shape[1] for a, run in zip(self.at, self.runs)):
            raise RuntimeError("totals for a node that is not in the shard")
        self.runs = []
        for name in self.files:
            os.remove(name)


def added(messages: np.ndarray) -> np.ndarray:
    """Messages sorted by key, those to one key added up."""
    if messages.shape[1] < 2:
        return messages
    messages = messages[:, np.lexsort((messages[1], messages[0]))]
    new = np.flatnonzero(np.concatenate([[True], (messages[0, 1:] != messages[0, :-1]) | (messages[1, 1:] != messages[1, :-1])]))
    return np.concatenate([messages[:2, new], np.add.reduceat(messages[2:], new, axis=1)])


def _forward(limit: int):
    """Nodes in reverse level order -> the same rows with totals in children, leaves and saved, which come in as what was sent from outside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="trie-") as scratch:
            level, now, then = None, Queue(limit, scratch), Queue(limit, scratch)
            for batch in batches:
                d = np.asarray(batch.column(batch.schema.get_field_index("d")))
                cuts = np.flatnonzero(np.diff(d)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
                    if a == b:
                        continue
                    if level is None or d[a] != level:
                        now.drop()
                        now, then = then, Queue(limit, scratch)
                        now.close()
                        level = d[a]
                    part = batch.slice(a, b - a)
                    get = {n: np.asarray(part.column(i)) for i, n in enumerate(part.schema.names) if n in ("k1", "k2", "p1", "p2", "n_convs", "len", "children", "leaves", "saved", "top")}
                    got = now.take(int(get["k1"][-1]), int(get["k2"][-1]))
                    at = _find(get["k1"], get["k2"], got[0], got[1])
                    if (at < 0).any():
                        raise RuntimeError("totals for a node that is not in the shard")
                    totals = np.stack([get["children"], get["leaves"], get["saved"]]).astype(np.int64)
                    totals[:, at] += got[2:]
                    totals[1] = np.where(totals[0] == 0, 1, totals[1])
                    totals[2] += (get["n_convs"] - 1) * get["len"]
                    up = ~get["top"].astype(bool)
                    then.send(np.stack([get["p1"][up], get["p2"][up], np.ones(int(up.sum()), np.int64), totals[1, up], totals[2, up]]).astype(np.int64))
                    columns = [pa.array(totals[("children", "leaves", "saved").index(n)]) if n in ("children", "leaves", "saved") else part.column(i) for i, n in enumerate(part.schema.names)]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
            now.drop()
    return run


def _totals(nodes: DataFrame, sent: DataFrame | None, keys: list[str], queue: int) -> DataFrame:
    """Time-forward processing of the nodes of each shard (`keys`; none: all in one), with totals sent to them from outside."""
    zero = [F.lit(0).cast("long").alias(n) for n in ("children", "leaves", "saved")]
    if sent is None:
        ready = nodes.select("*", *zero)
    else:
        given = sent.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "children", "leaves", "saved")
        ready = nodes.join(given, ["k1", "k2"], "left").fillna(0, ["children", "leaves", "saved"]).select(*nodes.columns, "children", "leaves", "saved")
    dealt = ready.repartition(*keys) if keys else ready.repartition(1)
    return dealt.sortWithinPartitions(F.desc("d"), "k1", "k2").mapInArrow(_forward(queue), ready.schema)


def _sent(tops: DataFrame) -> DataFrame:
    return tops.groupBy("p1", "p2").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _member_digests(ended: DataFrame, busy: DataFrame) -> DataFrame:
    """(k1, k2, digest) from (k1, k2, conv); `busy` has the keys with many members."""
    few = ended.join(F.broadcast(busy), ["k1", "k2"], "left_anti").groupBy("k1", "k2") \
        .agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ","), 256).alias("digest"))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, conv = (np.asarray(batch.column(i)) for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(k1) else np.zeros(0, np.int64)
            parts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(conv)])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(conv[starts]), pa.array(parts, pa.string())], names=["k1", "k2", "first", "ids"])

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["k1", "k2", "digest"])

        for batch in batches:
            for k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (k1, k2):
                    if key is not None:
                        yield done()
                    key, state = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield done()

    many = ended.join(F.broadcast(busy), ["k1", "k2"], "left_semi").repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    many = many.mapInArrow(join_ids, "k1 long, k2 long, first long, ids string").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return few.unionByName(many.mapInArrow(hash_ids, "k1 long, k2 long, digest string"))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", base: Column | None = None, head: Column | None = None,
                head_limit: int = 0, part: int = PART, height: int = HEIGHT, load: int = LOAD, queue: int = QUEUE, ends: int = ENDS) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `base` (of the long column `conv`) names the conversation whose first `head` turns, at most `head_limit`, stand for a conversation's own;
    a base's base is itself. Without it, conversations are taken as they are."""
    spark = conversations.sparkSession
    if (base is None) != (head is None) or head_limit < 0:
        raise ValueError("base and head go together")
    digests = _digests(conversations, (conv_id, turn, role, text), base)
    parts = conversations.count() // part + 1
    turns = written(digests.repartitionByRange(parts, "block", "conv", F.asc_nulls_first("turn"), "m1", "m2").withColumn("part", F.spark_partition_id()), "turns")
    paths = written(_paths(turns, F.lit(0) if head is None else F.least(head, F.lit(head_limit)), head_limit, height), "whole")

    size = paths.agg(F.sum(F.size("path")).alias("steps"), F.max(F.size("path")).alias("levels"), F.max("slab").alias("slab"), F.countDistinct("slab")).first()
    if size.slab is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    load = max(load, -(-(size.steps or 0) * (size.levels or 0) // HEAVY))
    step = paths.select("slab", F.size("path").alias("n"), F.posexplode("path").alias("at", "e")).select("slab", "e.k1", "e.k2", (F.col("n") - F.col("at")).alias("left"))
    heavy = step.groupBy("slab", "k1", "k2").agg(F.sum("left").alias("load")).where(F.col("load") > load).select("k1", "k2").collect()
    keys = spark.sparkContext.broadcast(np.array([tuple(r) for r in heavy], dtype=np.int64).reshape(-1, 2))

    nodes = paths.select("slab", "depth", "conv", "top1", "top2", "path").mapInArrow(_steps(keys), STEPS).groupBy("slab", "light", "r1", "r2", "d", "k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("len"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("under").alias("under"), F.count_if("ends").alias("n_ends"))
    nodes = written(nodes, "nodes")
    root = paths.where("slab = 0").agg(F.min("conv").alias("conv_id"), F.countDistinct("conv").alias("n_convs"), F.count_if(F.col("depth") == 0).alias("n_ends")).select(
        F.lit(0).alias("slab"), F.lit(False).alias("light"), F.lit(0).cast("long").alias("r1"), F.lit(0).cast("long").alias("r2"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("k1"),
        F.lit(0).cast("long").alias("k2"), "conv_id", "n_convs", F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.lit(False).alias("under"), "n_ends")

    done, crowns, below = [], [], None
    for slab in range(size.slab, -1, -1):
        here = nodes.where(F.col("slab") == slab)
        shards = here.where("light").withColumn("top", (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")))
        shards = written(_totals(shards, below, ["r1", "r2"], queue), "shards")
        crown = here.where("not light").withColumn("top", F.col("d") == slab * height + 1 if slab else F.lit(False))
        if slab == 0:
            crown = crown.unionByName(root.withColumn("top", F.lit(True)))
        sent = _sent(shards.where("top and under"))
        crown = written(_totals(crown, sent if below is None else _both(sent, below), [], queue), "crown")
        below = written(_sent(shards.where("top and not under").unionByName(crown.where("top"))), "sent") if slab else None
        done += [shards, crown]
        crowns.append(crown)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)

    parent = lambda df: df.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = crowns[0]
    for more in crowns[1:]:
        top = top.unionByName(more)
    with_parent = every.where("d > 0 and under").join(F.broadcast(parent(top)), ["p1", "p2"], "left").unionByName(
        every.where("d > 0 and not under").join(parent(every), ["p1", "p2"], "left")).unionByName(every.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))

    last = F.try_element_at("path", F.lit(-1))
    ended = paths.where((F.size("path") == 0) | (last["d"] == F.col("depth"))).select(F.coalesce(last["k1"], F.lit(0)).alias("k1"), F.coalesce(last["k2"], F.lit(0)).alias("k2"), "conv")
    convs = every.where("d = 0").first().n_convs
    busy = every.where(F.col("n_ends") > max(ends, convs // HEAVY)).select("k1", "k2")
    return with_parent.join(_member_digests(ended, busy), ["k1", "k2"], "left").select(
        "conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("p1", "p2").agg(*[F.sum(n).alias(n) for n in ("children", "leaves", "saved")])
