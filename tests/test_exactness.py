"""Brute-force checks for the helpers that replace pairwise or per-key work."""

import random

from pyspark.sql import functions as F

from lathe.operators.recommend import _missing_ranks
from lathe.streaming.ops import rate_limit_all


def test_missing_ranks_match_brute_force(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for key in range(30):
        cands = sorted(rng.sample(range(1, 15), rng.randint(1, 10)))
        rows += [(key, r) for r in cands]
        missing = [r for r in range(1, 40) if r not in cands][:4]
        expected[key] = missing
    df = spark.createDataFrame(rows, "k int, r int")
    got = {}
    for row in _missing_ranks(df, ["k"], "r", 4).collect():
        got.setdefault(row["k"], []).append((row["_k"], row["_rank"]))
    assert {k: [r for _, r in sorted(v)] for k, v in got.items()} == expected


def test_rate_limit_halo_across_hour_buckets(spark):
    # bursts straddle hour borders, where the 60 s look-back crosses into the previous bucket
    rng = random.Random(3)
    rows, i = [], 0
    for user in (1, 2):
        for hour in range(3):
            for s in sorted(rng.sample(range(3540, 3660), 25)):
                t = hour * 3600 + s
                rows.append((i, f"2024-01-01 {t // 3600:02d}:{(t % 3600) // 60:02d}:{t % 60:02d}", user))
                i += 1
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).withColumn("event_type", F.lit("view")).withColumn("value", F.lit(1.0))
    got = {r["event_id"]: r["prior_requests"] for r in rate_limit_all(df, limit=5).collect()}
    secs = {e: (int(ts[11:13]) * 3600 + int(ts[14:16]) * 60 + int(ts[17:19]), u) for e, ts, u in rows}
    for e, (t, u) in secs.items():
        exp = sum(1 for e2, (t2, u2) in secs.items() if u2 == u and t - 60 < t2 < t)
        assert got[e] == exp


def test_cross_training_potential_brute_force(spark):
    from lathe.operators.operator_analysis import cross_training_potential
    rng = random.Random(11)
    machines = [f"M{i}" for i in range(8)]
    rows = []
    for op in range(6):
        for m in rng.sample(machines, rng.randint(1, 6)):
            for _ in range(rng.randint(1, 3)):
                rows.append((f"OP{op}", m, float(rng.randint(100, 5000))))
    df = spark.createDataFrame(rows, "OperatorName string, machine string, SetupTime double")
    got = {(r["OperatorName"], r["rank"]): (r["machine"], round(r["similarity"], 9), round(r["versatility_potential"], 9))
           for r in cross_training_potential(df).collect()}

    def mean(xs):
        return sum(xs) / len(xs)
    all_m = sorted({m for _, m, _ in rows})
    m_setup = {m: mean([s for _, m2, s in rows if m2 == m]) for m in all_m}
    exp = {}
    for op in sorted({o for o, _, _ in rows}):
        seen = sorted({m for o, m, _ in rows if o == op})
        cur = mean([mean([s for o, m2, s in rows if o == op and m2 == m]) for m in seen])
        cand = sorted(((1 / (1 + abs(cur - m_setup[m]) / 1000), m) for m in all_m if m not in seen),
                      key=lambda t: (-t[0], t[1]))[:3]
        for i, (sim, m) in enumerate(cand, 1):
            exp[(op, i)] = (m, round(sim, 9), round((len(all_m) - len(seen)) / len(all_m), 9))
    assert got == exp


def test_cross_training_brute_force(spark):
    from lathe.operators.matrices import cross_training
    rng = random.Random(5)
    rows = []
    for op in range(7):
        for m in rng.sample([f"M{i}" for i in range(9)], 5):
            rows.append((f"OP{op}", m, rng.choice([0.5, 0.85, 0.9, 0.95]), rng.randint(1, 6), float(rng.randint(100, 900))))
    om = spark.createDataFrame(rows, "OperatorName string, machine string, performance_score double, "
                                     "job_count int, avg_setup_time double")
    got = [(r["operator"], r["recommended_machine"], round(r["similarity_score"], 9), r["rank"])
           for r in cross_training(om).orderBy("rank").collect()]

    def mean(xs):
        return sum(xs) / len(xs)
    all_m = sorted({m for _, m, *_ in rows})
    m_setup = {m: mean([s for _, m2, _, _, s in rows if m2 == m]) for m in all_m}
    cands = []
    for op in sorted({r[0] for r in rows}):
        strong = [r for r in rows if r[0] == op and r[2] > 0.8 and r[3] >= 3]
        if not strong:
            continue
        cur = mean([r[4] for r in strong])
        sm = {r[1] for r in strong}
        per = sorted(((1 / (1 + abs(cur - m_setup[m]) / 100), m) for m in all_m if m not in sm),
                     key=lambda t: (-t[0], t[1]))[:3]
        cands += [(op, m, sim) for sim, m in per]
    cands.sort(key=lambda t: (-t[2], t[0], t[1]))
    exp = [(op, m, round(sim, 9), i) for i, (op, m, sim) in enumerate(cands[:10], 1)]
    assert got == exp
