"""Exact quantiles against the built-in percentile."""

import math
import random

import pytest

from pyspark.sql import functions as F

from lathe.functions.quantiles import exact_quantiles, grouped_quantiles
from lathe.operators.features import impute, modes


def test_equals_percentile(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, float("nan"), rng.gauss(0, 1), float(rng.randint(0, 3))]), float(i % 7), None, 5.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = exact_quantiles(df, {c: ps for c in "abcd"})
    clean = df.withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    for c in "abcd":
        want = clean.agg(F.percentile(c, ps)).first()[0]
        if want is None:
            assert got[c] == [None] * len(ps)
        else:
            assert all(abs(x - y) < 1e-12 for x, y in zip(got[c], want))


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "a double"), {"a": [0.5]}) == {"a": [None]}


@pytest.mark.parametrize("small,buckets", [(4096, 1024), (3, 4), (1, 2)])
def test_groups_equal_percentile_with_a_hot_one(spark, small, buckets):
    rng = random.Random(2)
    draw = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 5)), lambda: 10.0 ** rng.randint(-300, 300), lambda: None, lambda: float("nan"), lambda: -1e308 * rng.random(), lambda: 1e308 * rng.random(), lambda: 5e-324 * rng.randint(0, 3)]
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), i % 2, rng.choice(draw)()) for i in range(900)] + [("none", 0, None), ("one", 1, 7.0), ("same", 1, 2.0), ("same", 1, 2.0)]
    df = spark.createDataFrame(rows, "who string, side int, v double")
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.who, r.side): list(r)[2:] for r in grouped_quantiles(df, ["who", "side"], "v", ps, [f"q{i}" for i in range(5)], small, buckets).collect()}
    assert set(got) == {r[:2] for r in rows}
    for key, found in got.items():
        values = sorted(v for *k, v in rows if tuple(k) == key and v is not None and v == v)
        for p, x in zip(ps, found):
            at = p * (len(values) - 1)
            want = values[math.floor(at)] + (values[math.ceil(at)] - values[math.floor(at)]) * (at - math.floor(at)) if values else None
            assert x == want or x == pytest.approx(want, rel=1e-12)


def test_groups_of_an_empty_table(spark):
    assert grouped_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5], ["m"]).collect() == []


def test_modes_and_fills(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, "b", None, 1), (inf, "a", None, 1), (float("nan"), "a", None, 2), (None, "b", None, None), (5.0, None, None, 2)], "x double, s string, t string, i int")
    assert modes(df, ["s", "t", "i"]) == {"s": "a", "t": None, "i": "1"}
    got = impute(df, ["x"], ["s", "t", "i"]).collect()
    assert [r.x for r in got] == [1.0, 3.0, 3.0, 3.0, 5.0] and [r.s for r in got] == ["b", "a", "a", "b", "a"] and [r.i for r in got] == [1, 1, 2, 1, 2]
    assert all(r.t is None for r in got) and impute(df.where("x > 9 and x < 9"), ["x"], ["s"]).collect() == []
