"""Phrase mining: filters round trip, counts and reports against brute force, hot phrases, borders of chunks and shards, odd rows."""

import collections
import re
import tracemalloc

import numpy as np
import pytest

from lathe.llm import phrases
from lathe.llm.text import _U

SCHEMA = "body string, language string, lang string, w1 long, f long, text string"


@pytest.mark.parametrize("half", [2, 9, 30, 32, 50, 64])
def test_permutation_is_invertible(half):
    rng = np.random.default_rng(half)
    a, b = (rng.integers(0, 1 << min(half, 63), 500, dtype=np.uint64) for _ in range(2))
    x, y = phrases.permute(a, b, half)
    assert int(max(x.max(), y.max())) < 1 << half
    c, d = phrases.restore(x, y, half)
    assert (a == c).all() and (b == d).all()


@pytest.mark.parametrize("half,known", [(2, 0), (9, 0), (9, 3), (30, 5), (50, 6), (9, 9)])
def test_filters_hold_counts_exactly(half, known):
    rng = np.random.default_rng(half + known)
    prefix = int(rng.integers(0, 1 << known)) if known else 0
    for n in (0, 1, 2, 300):
        a = rng.integers(0, 1 << (half - known), n, dtype=np.uint64) | _U(prefix << (half - known))
        b = rng.integers(0, 1 << half, n, dtype=np.uint64)
        a, b, counts = phrases.counted(a, b, rng.integers(1, 1000, n) ** 2, half)
        out = phrases.open_filter(phrases.pack_filter(a, b, counts, known, half), prefix, known, half)
        assert all((x == y).all() for x, y in zip(out, (a, b, counts)))


def brute(rows, least=30, percent=80, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang, tuple(words[i:i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(longer[lang, p[i:i + k]], a)
    found = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * longer[lang, p] < percent * a:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, every in found.items() for i, (s, a, p, l, r) in enumerate(sorted(every)[:top])}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = [f"W{i}" for i in range(12)] + ["é", "中文", "x y", "a|b"]
    texts = [" ".join(rng.choice(words, 40)).replace("w3 ", "w3, ") for _ in range(60)]
    rows = [(t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rows += [("Hot phrase here again.  hot\tphrase here", "en")] * 90 + [("one two\nthree four five", "fr")] * 31 + [("rare pair", "fr")] * 29
    return rows + [(None, "en"), ("", "de"), (" \t.,;", None), ("alone", "xx"), ("deep blue sea " * 9000, "en"), ("hot phrase here", "")]


@pytest.mark.parametrize("limits", [{}, {"chunk": 50, "shard": 100, "radix": 2, "fan": 2}])
def test_equals_brute_force(spark, rows, limits):
    frame = spark.createDataFrame([(t, lang, "zz", 1, 2, "other") for t, lang in rows], SCHEMA)
    found = phrases.mine_phrases(frame, "body", "language", **limits)
    got = [tuple(r) for r in found.collect()]
    assert len(set(got)) == len(got) and set(got) == brute(rows)
    few = [tuple(r) for r in phrases.mine_phrases(frame, "body", "language", least=4, percent=50, top=5, **limits).collect()]
    assert max(r[1] for r in few) == 5 and set(few) == brute(rows, 4, 50, 5)


def test_empty_tables(spark):
    for data in ([], [("too few words", "en", "", 1, 2, "")]):
        found = phrases.mine_phrases(spark.createDataFrame(data, SCHEMA), "body", "language")
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.collect() == []


@pytest.mark.parametrize("half", [30, 40])
def test_a_chunk_is_counted_in_little_memory(half):
    """Six workers share an executor of 3000 MB with its JVM."""
    rng = np.random.default_rng(half)
    tracemalloc.start()
    chunk = phrases.Chunk(half)
    while chunk.size < phrases.CHUNK:
        chunk.add(*(rng.integers(0, 1 << half, 50_000, dtype=np.uint64) for _ in range(2)))
    phrases._dealt(*chunk.counted(), 0, phrases.RADIX, half, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20, peak


def test_merging_rounds_count_exactly(spark):
    """More bits than one round deals, so filters are merged by prefix and group of chunks."""
    frame = spark.createDataFrame([("a b c d e f g h", "en")] * 40 + [("b c x", "en")] * 7, "text string, lang string")
    _, _, found = phrases.count_phrases(frame, 5, chunk=10, shard=5, radix=1, fan=2)
    assert found.where("w3 = 0").selectExpr("sum(f)").first()[0] == 40 * 7 + 7 * 2
    assert found.where("w3 > 0 and w4 = 0").selectExpr("sum(f)").first()[0] == 40 * 6 + 7
