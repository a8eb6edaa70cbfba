"""Self-resetting windows and the accepted-only limit against plain loops, over many buckets, levels and ties."""

import random

import pytest

from lathe.operators.greedy import accept_within_limit, reset_windows


def _rows(seed, keys=("a", "b", None), n=600, span=9000, hot=None):
    r = random.Random(seed)
    rows = [(r.choice(keys), r.randrange(-50, span) * 1_000_000 + r.choice([0, 0, 1, 999_999])) for _ in range(n)]
    rows += [("hot", t * 1_000_000) for t in range(0, hot or 0, 7)]
    return [(i, k, t) for i, (k, t) in enumerate(rows)]


def _windows(rows, window, opened=None):
    opened, out = dict(opened or {}), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in opened or t > opened[k] + window:
            opened[k] = t
        out[i] = opened[k]
    return out


@pytest.mark.parametrize("window, bucket, carried", [(60, 60, None), (300, 100, None), (37, 90, {"a": 1_000_000_000, "hot": -10**12}),
                                                     (37, 900, {"hot": 1_400_000_000, "b": 5_500_000, "new": 3})])
def test_windows_reset_as_in_a_loop(spark, window, bucket, carried):
    """Buckets of a minute give more than FAN * FAN of them, so two levels compose."""
    rows = _rows(window, span=80_000, hot=70_000) + [(10**6, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    held = spark.createDataFrame(list(carried.items()), "k string, window_us long") if carried else None
    got = {r.id: r.window_us for r in reset_windows(df, "k", "t", window, held, bucket_s=bucket).collect()}
    assert got.pop(10**6) is None
    assert got == _windows(rows[:-1], window * 1_000_000, carried)


def test_windows_of_an_empty_table(spark):
    assert reset_windows(spark.createDataFrame([], "k string, t long"), "k", "t", 60).collect() == []


@pytest.mark.parametrize("limit, window, bucket", [(1, 60, 100), (3, 60, 30), (5, 600, 100)])
def test_limit_counts_accepted_rows_only(spark, limit, window, bucket):
    rows = _rows(limit, hot=9000)
    rows += [(10**5 + i, "a", rows[0][2]) for i in range(9)]  # ties
    want, taken = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        kept = [a for a in taken.get(k, []) if a >= t - window * 1_000_000]
        want[i] = (len(kept) < limit, 0.0 if len(kept) < limit else max(window - (t - kept[0]) / 1e6, 1.0))
        taken[k] = kept + [t] if len(kept) < limit else kept
    df = spark.createDataFrame([*rows, (10**6, "a", None)], "id long, k string, t long")
    got = accept_within_limit(df, "k", "t", "id", limit, window, bucket_s=bucket).collect()
    assert {r.id: (r.allowed, round(r.retry_after, 6)) for r in got} == {i: (a, round(b, 6)) for i, (a, b) in want.items()}
    assert len(got) == len(rows)
    assert accept_within_limit(df.limit(0), "k", "t", "id", limit, window).collect() == []


def test_periods_go_on_over_batches_late_rows_and_replays(spark, tmp_path):
    """Rows in time order give the batch form's periods however they are cut into micro-batches; late rows count in the period open before their batch."""
    from lathe.streaming.resets import ResetStore, periods

    rows = [(i, k, t, float(i % 7)) for i, k, t in sorted(_rows(3, keys=("x", "error"), span=20_000, hot=20_000), key=lambda r: r[2])]
    late = [(10**6, "x", 5, 1.0), (10**6 + 1, None, 5, 1.0)]
    cuts = [rows[:200], rows[200:1500], [], rows[1500:] + late]
    store = ResetStore(spark, str(tmp_path / "store"), window_s=60, compact_after=3)
    for number, part in enumerate(cuts):
        batch = spark.createDataFrame(part, "id long, event_type string, _us long, value double")
        store.add(batch, number)
        store.add(batch, number)  # replayed
    got = {(r.endpoint, r.reset_us): r["count"] for r in periods(store.read()).collect()}
    opened = _windows([r[:3] for r in rows], 60_000_000)
    want = {}
    for i, k, *_ in rows:
        want[k, opened[i]] = want.get((k, opened[i]), 0) + 1
    open_x = max(opened[i] for i, k, *_ in rows[:1500] if k == "x")
    want["x", open_x] += 1
    want[None, 5] = 1
    assert got == want
