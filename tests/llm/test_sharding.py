"""Minimax sharding: the search against brute force, and small frames with nulls, copies, hot texts and clashing names."""

import collections
import zlib

import numpy as np
import pytest

from lathe.llm.sharding import BITS, dominant, minimax, shard_documents, write_shards
from lathe.llm.store import folder

SCHEMA = "id long, body string, shard string, slot int, c0 int"


def shards_needed(sizes, capacity):
    n, load = 1, 0
    for s in sizes:
        n, load = (n + 1, s) if load + s > capacity else (n, load + s)
    return n


def least_capacity(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if shards_needed(sizes, c) <= shards)


@pytest.mark.parametrize("segments", [2, 8, 64, 1 << 16])
def test_search_finds_the_least_capacity(segments):
    rng = np.random.default_rng(segments)
    for trial in range(60):
        keys = np.unique(rng.integers(0, 1 << (BITS if trial % 3 else 20), int(rng.integers(1, 200))))
        sizes = (rng.pareto(1.2, len(keys)) * 20 + 1).astype(np.int64)
        shards = int(rng.integers(1, 30))
        asked = []

        def sums(prefixes, bits, more):
            some = np.ones(len(keys), bool) if prefixes is None else np.isin(keys >> (BITS - bits), prefixes)
            kinds, at = np.unique(keys[some] >> (BITS - bits - more), return_inverse=True)
            asked.append(len(kinds))
            largest = np.zeros(len(kinds), np.int64)
            np.maximum.at(largest, at, sizes[some])
            return kinds, np.bincount(at, sizes[some], len(kinds)).astype(np.int64), largest, np.bincount(at, minlength=len(kinds))

        capacity, firsts = minimax(sums, shards, segments)
        assert capacity == least_capacity(sizes.tolist(), shards)
        assert np.bincount(np.searchsorted(firsts, keys, "right"), sizes).max() <= capacity
        assert len(firsts) == shards - 1


def test_dominant_groups():
    assert dominant([50, 30, 5, 5], 100, 3) == 2
    assert dominant([10, 10, 10], 30, 3) == 0
    assert dominant([100], 100, 1) == 0
    assert dominant([], 0, 4) == 0


def check(rows, shards):
    """Rules that hold for any placing: whole groups, gapless slots, sizes, checksums."""
    homes, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        body = (r.body or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "bytes", None)
        homes[body].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)


@pytest.mark.parametrize("slots", [1, 5, 50_000])
def test_small_frames(spark, slots):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, None), (3, None), (4, ""), (5, "é" * 500), (6, "x" * 90_000), *[(7, "hot text")] * 70, *[(i, "hot text") for i in range(100, 150)],
            *[(i, f"text {i}") for i in range(200, 260)]]
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)
    found = shard_documents(docs, 6, "body", "id", slots=slots, segments=4)
    assert found.columns == ["id", "body", "c0", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = found.collect()
    assert collections.Counter((r.id, r.body) for r in got) == collections.Counter(rows)
    check(got, 6)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert sizes[0] == 90_008 and sizes[1] == 120 * 16  # groups above an equal share stand alone, largest first
    rest = collections.Counter()
    for _, t in rows:
        rest[t or ""] += len((t or "").encode()) + 8
    assert max(v for k, v in sizes.items() if k > 2) <= sum(rest.values()) - 90_008 - 1920 - sizes[2]


def test_empty_and_one_shard(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert shard_documents(none, 24, "body", "id").collect() == []
    few = spark.createDataFrame([(1, "a", "s", 1, 2), (2, "b", "s", 1, 2)], SCHEMA)
    check(shard_documents(few, 1, "body", "id").collect(), 1)
    check(shard_documents(few, 24, "body", "id").collect(), 24)
    with pytest.raises(ValueError):
        shard_documents(few, 0, "body", "id")


def test_files_follow_the_slots(spark):
    docs = spark.createDataFrame([(i, f"t{i % 40}", "s", 1, 2) for i in range(100)], SCHEMA)
    path = folder(spark, "shards")
    placed = shard_documents(docs, 3, "body", "id")
    write_shards(placed, path, rows_a_file=10)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(*placed.columns).collect())) == sorted(map(tuple, placed.collect()))
