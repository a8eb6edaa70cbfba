"""The prefix trie against brute force: hot prefixes, long conversations, borders of parts and slabs, spilled queues, odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm.trie import Queue, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, path string"


def brute(rows, graft=True):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        built[c] = (turns.get(c - (abs(c) % 100 if c > 0 else -(abs(c) % 100)), [])[:h] if graft else []) + own[h:]
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += kids[node] == 0
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1])
            kids[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return collections.Counter(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest()) for node, m in members.items())


@pytest.fixture(scope="module")
def rows():
    random.seed(1)
    out = [(c, random.choice([None, *range(8)]) if c % 9 == 0 else t, random.choice(["user", "assistant", None]) if t > 2 else "user", random.choice(["a", "b", "c é", None, ""]) if t else "same")
           for c in [*range(60), 100, 101, 102, 205, 206, -5, -100, -7, 300, 301] for t in range(random.choice([1, 2, 3, 5, 9]))]
    out += [(700, t, "user", f"t{t % 3}") for t in range(90)]  # a long conversation
    out += [(800 + i, t, "user", f"t{t % 3}") for t in range(4) for i in range(60)]  # many copies
    seen = set()
    out = [r for r in out if r[:2] not in seen and not seen.add(r[:2])]
    return out + [(None, 0, "user", "no conversation"), (901, 0, "user", "again"), (901, 0, "user", "again"), (902, 0, "user", "long " * 30_000), (903, 0, "user", "long " * 30_000)]


@pytest.mark.parametrize("limits", [{}, {"part": 60, "height": 40, "load": 5, "queue": 3, "ends": 2}, {"part": 13, "load": 1, "queue": 1, "ends": 1}])
def test_equals_brute_force(spark, rows, limits):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    found = prefix_trie(frame, base=conv - conv % 100, head=head, head_limit=5, **limits)
    assert collections.Counter(map(tuple, found.collect())) == brute(rows)


def test_plain_conversations_and_empty_table(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    assert collections.Counter(map(tuple, prefix_trie(frame, load=10).collect())) == brute(rows, graft=False)
    none = prefix_trie(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == prefix_trie(frame).columns


def test_queue_spills_and_adds_up(tmp_path):
    rng = np.random.default_rng(1)
    queue, want = Queue(50, str(tmp_path)), collections.Counter()
    for _ in range(40):
        m = rng.integers(-9, 9, (5, 20))
        m[2:] = abs(m[2:])
        for k1, k2, a, b, c in m.T.tolist():
            want[k1, k2] += a * 10_000 + b * 100 + c
        queue.send(m)
    queue.close()
    assert len(queue.files) > 5
    got = {}
    for limit in ((-4, 2), (0, -9), (8, 9)):
        for k1, k2, a, b, c in queue.take(*limit).T.tolist():
            assert (k1, k2) not in got and (k1, k2) <= limit
            got[k1, k2] = a * 10_000 + b * 100 + c
    assert got == dict(want)
    queue.drop()
    assert not list(tmp_path.iterdir())
