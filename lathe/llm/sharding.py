"""Sharding by a minimax contiguous partition: the smallest shard capacity that ordered, atomic groups allow.

A group is all rows of one text and stays in one shard. Groups that are larger than an equal share of what is left come first,
largest first, each in a shard of its own (no partition could do better); the others follow in the order of their key, the first
60 bits of the text's MD5, and are cut into the shards left. Their capacity is the smallest for which filling shards greedily, in
order, places all groups; the cuts are those of that filling.

The search does not sort or collect the groups. Spark adds them up by key prefix; from these segments the driver bounds each
greedy cut from both sides (a cut inside a segment lies less than the segment's largest group before the point wanted),
which brackets the capacity by two binary searches. Only segments that a cut within the bracket may fall into are added up again
by longer prefixes, until those are single groups and the bracket is one number. The driver holds at most SEGMENTS new segments a
round. A row's shard follows from its key and the cuts alone; its slot is its rank by a hash of id and text, counted by
ranges of that hash, so that a shard's rows are spread over many tasks.

Defined results: a null text is an empty one (size `overhead`); null and repeated ids are rows like others; rows equal in all
kept columns share a count until their slots are dealt, so however often a row repeats, it travels once; an empty table gives
no rows; with fewer groups than shards, some shards stay empty. Kept columns named like a result give way to it; they must be of
types that can be grouped. The sizes of shards are at most the capacity; one group may hold any part of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

BITS = 60  # of a key
SEGMENTS = 1 << 16  # prefixes added up in a round of the search
SLOTS = 50_000  # rows of a slot range
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


class Segments:
    """Key ranges in order: sums, largest groups, and which are single groups."""

    def __init__(self, prefix: np.ndarray, bits: np.ndarray, total: np.ndarray, largest: np.ndarray, groups: np.ndarray):
        order = np.argsort(prefix << (BITS - bits), kind="stable")
        self.prefix, self.bits, self.total, self.largest, self.groups = (a[order] for a in (prefix, bits, total, largest, groups))
        self.ends = np.cumsum(self.total)
        self.whole = int(self.ends[-1]) if len(self.ends) else 0

    def cuts(self, capacity: int, shards: int, lower: bool) -> list[int]:
        """Bounds, from below or above, of where greedy filling ends each shard."""
        at, out = 0, []
        for _ in range(shards):
            at = self._cut(at + capacity, lower)
            out.append(at)
        return out

    def _cut(self, point: int, lower: bool) -> int:
        if point >= self.whole:
            return self.whole
        s = int(np.searchsorted(self.ends, point, "right"))
        begin = int(self.ends[s] - self.total[s])
        if self.groups[s] == 1:
            return begin
        return max(begin, point - int(self.largest[s]) + 1) if lower else point

    def least(self, shards: int, lower: bool, low: int) -> int:
        """The smallest capacity from `low` on that surely (lower) or possibly places all."""
        high = max(self.whole, low)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, lower)[-1] >= self.whole:
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, shards: int, least: int, most: int) -> np.ndarray:
        """Segments of several groups that a cut may fall into."""
        wanted = np.zeros(len(self.total), dtype=bool)
        first, last = 0, 0
        for low, high in zip(self.cuts(least, shards, True), self.cuts(most, shards, False)):
            if first + least < self.whole:
                a, b = np.searchsorted(self.ends, [first + least, min(last + most, self.whole - 1)], "right")
                wanted[a:b + 1] = True
            first, last = low, high
        return np.flatnonzero(wanted & (self.groups > 1))


def minimax(sums: Callable[[np.ndarray | None, int, int], tuple], shards: int, segments: int = SEGMENTS) -> tuple[int, list[int]]:
    """(capacity, first key of each later shard). `sums(prefixes, bits, more)` adds up the groups of those prefixes (None: all) by
    `bits + more` bits and returns (prefixes, sums, largest groups, numbers of groups)."""
    step = max(1, min(12, segments.bit_length() - 1))
    prefix, total, largest, groups = sums(None, 0, step)
    now = Segments(prefix, np.full(len(prefix), step), total, largest, groups)
    floor = max(int(largest.max(initial=0)), -(-now.whole // shards))
    while True:
        least, most = now.least(shards, False, floor), now.least(shards, True, floor)
        wanted = now.open(shards, least, most)
        if not len(wanted):
            break
        bits = int(now.bits[wanted].min())  # of one length, as brackets only narrow; else the coarser ones first
        wanted = wanted[now.bits[wanted] == bits]
        more = min(BITS - bits, max(1, (segments // len(wanted)).bit_length() - 1))
        prefix, total, largest, groups = sums(now.prefix[wanted], bits, more)
        rest = np.setdiff1d(np.arange(len(now.total)), wanted)
        now = Segments(*[np.concatenate([old[rest], new]) for old, new in (
            (now.prefix, prefix), (now.bits, np.full(len(prefix), bits + more)), (now.total, total), (now.largest, largest), (now.groups, groups))])
    firsts = []
    for end in now.cuts(least, shards, True)[:-1]:
        s = int(np.searchsorted(now.ends, end, "right"))
        firsts.append(int(now.prefix[s]) << (BITS - int(now.bits[s])) if s < len(now.ends) else 1 << BITS)
    return least, firsts


def dominant(sizes: list[int], whole: int, shards: int) -> int:
    """How many of the largest groups exceed an equal share of what is left."""
    found = 0
    while found < min(len(sizes), shards - 1) and sizes[found] * (shards - found) > whole:
        whole -= sizes[found]
        found += 1
    return found


def _key(digest) -> F.Column:
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def shard_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
                    overhead: int = 8, segments: int = SEGMENTS, slots: int = SLOTS) -> DataFrame:
    """`keep` columns (default: all) with size, text_crc32, law, shard, slot and grown_shard of each row."""
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.md5(body)
    plain = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
        (F.octet_length(body) + F.lit(overhead).cast("long")).alias("size"), F.crc32(body).alias("crc"), _key(digest).alias("key"),
        _key(F.md5(F.concat_ws(":", digest, F.col(f"`{doc_id}`").cast("string")))).alias("place"))
    columns = [f"c{i}" for i in range(len(kept))]
    rows = written(plain.groupBy(*columns, "size", "crc", "key", "place").agg(F.count("*").alias("copies")), "rows")
    groups = written(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "groups")

    whole = groups.agg(F.sum("bytes")).first()[0] or 0
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect() if shards > 1 else []
    alone = [r.key for r in largest[:dominant([r.bytes for r in largest], whole, shards)]]
    others = groups.where(~F.col("key").isin(alone)) if alone else groups

    def sums(prefixes: np.ndarray | None, bits: int, more: int) -> tuple:
        part = others
        if prefixes is not None:
            wanted = spark.createDataFrame([(int(p),) for p in prefixes], "wanted long")
            part = others.join(F.broadcast(wanted), F.shiftright("key", BITS - bits) == F.col("wanted"), "left_semi")
        found = part.groupBy(F.shiftright("key", BITS - bits - more).alias("prefix")).agg(
            F.sum("bytes").alias("total"), F.max("bytes").alias("largest"), F.count("*").alias("groups")).collect()
        return tuple(np.array([r[i] for r in found], dtype=np.int64) for i in range(4))

    _, firsts = minimax(sums, shards - len(alone), segments)
    place = F.lit(len(alone))
    if firsts:
        cuts = F.array(*[F.lit(k).cast("long") for k in firsts])
        place = place + F.size(F.filter(cuts, lambda k: k <= F.col("key")))
    for i, key in enumerate(alone):
        place = F.when(F.col("key") == key, i).otherwise(place)
    placed = rows.withColumn("shard", place.cast("int"))
    return _slots(placed, kept, slots)


def _slots(rows: DataFrame, kept: list[str], slots: int) -> DataFrame:
    """Gapless places in each shard, by ranges of `place` that hold about `slots` different rows."""
    bits = max(0, (rows.count() // slots).bit_length())
    rows = rows.withColumn("range", F.shiftright("place", BITS - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy("shard", "range").agg(F.sum("copies").alias("n"))
    before = counts.select("shard", "range", F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    ordered = Window.partitionBy("shard", "range").orderBy("place", *[c for c in rows.columns if c[0] == "c" and c[1:].isdigit()])
    ranked = rows.join(before, ["shard", "range"]).withColumn(
        "start", F.coalesce("before", F.lit(0)) + F.sum("copies").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    return ranked.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence("start", F.col("start") + F.col("copies") - 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(placed: DataFrame, path: str, rows_a_file: int = 1_000_000) -> None:
    """Files by shard (`shard=N/`), in order of slots, of at most `rows_a_file` rows."""
    file = F.floor(F.col("slot") / rows_a_file)
    placed.withColumn("file", file).repartition("shard", "file").sortWithinPartitions("shard", "slot").drop("file") \
        .write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
