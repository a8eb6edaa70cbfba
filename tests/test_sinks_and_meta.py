"""Sinks, schema info and the feature transformer (meta operators without a SQL oracle)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lathe.operators import features as FE
from lathe.operators import summaries as S
from lathe.plans.tables import F as derived
from lathe.plans.tables import J
from lathe.sources import joblog as SR
from lathe.sources import sinks as SK


def test_save_tables_and_export(spark, sf_dir):
    f = derived(spark, sf_dir)
    out = tempfile.mkdtemp(prefix="lathe-sink-")
    paths = SK.save_tables({"machine_performance": S.machine_summary(f)}, out)
    assert spark.read.parquet(paths["machine_performance"]).count() == 10
    j = SR.apply_filters(J(spark, sf_dir), {"machine": ["M1", "M2"]})
    n = j.count()
    for fmt in ("csv", "json", "parquet"):
        res = SK.export(j, os.path.join(out, f"export_{fmt}"), fmt)
        assert res["rows"] == n and res["format"] == fmt
    with pytest.raises(ValueError):
        SK.export(j, os.path.join(out, "x"), "xml")


def test_table_info(spark, sf_dir):
    info = {r["column"]: r["type"] for r in SR.table_info(J(spark, sf_dir)).collect()}
    assert info["StartTime"] == "timestamp_ntz" and info["JobDuration"] == "double"


def test_feature_report(spark, sf_dir):
    rep = SK.feature_report(derived(spark, sf_dir), {"time": ["hour", "day_of_week"], "ratio": ["efficiency"]})
    r = rep.first()
    assert r["feature_count"] == 3 and r["time_features"] == 2 and r["rows"] > 0


def test_feature_transformer(spark, sf_dir):
    f = derived(spark, sf_dir)
    t = FE.FeatureTransformer().fit(f, target="efficiency")
    out = t.transform(f)
    assert out.columns == t.columns
    assert "machine_encoded" in out.columns
    # min-max scaled ratio columns stay in [0, 1]
    r = out.agg(F.min("SetupTime_ratio").alias("lo"), F.max("SetupTime_ratio").alias("hi")).first()
    assert r["lo"] >= 0 and r["hi"] <= 1


def test_scalers_match_sklearn_conventions(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (3.0, 5.0, 6.0)], "RunningTime double, setup_ratio double, JobDuration double")
    cols = ["RunningTime", "setup_ratio", "JobDuration"]
    got = FE.apply_scalers(df, FE.fit_scalers(df, cols), cols).orderBy("RunningTime").collect()
    assert [r["RunningTime"] for r in got] == [-1.0, 1.0]  # population std
    assert [r["setup_ratio"] for r in got] == [0.0, 0.0]   # constant column -> 0
    # the name JobDuration contains "ratio", so the name rule min-max scales it
    assert [r["JobDuration"] for r in got] == [0.0, 1.0]
