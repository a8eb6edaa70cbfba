"""Queries over several key sets shuffle the jobs once, whatever the number of key sets, and the jobs' other columns not at all."""

import os

import pytest

from lathe.operators import features
from lathe.plans import q_ml, registry

ONE_SHUFFLE = [
    "drv12_derived_table",
    "win13_efficiency_history",
    "win9_sequence_counters",
    "ano10_anomaly_feature_table",
    "win5_downtime_history",
    "win15_time_gaps",
    "win18_notebook_rolling",
    "win12_duration_rolling",
]


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_jobs_are_shuffled_once(spark, sf_dir, name):
    registry.load_all()
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


FEATURES = {
    "efficiency_features": (q_ml._JOB, q_ml.EFFICIENCY_FEATURES),
    "duration_features": (q_ml.DURATION_INPUTS, q_ml.DURATION_FEATURES),
    "downtime_features": (q_ml.DOWNTIME_INPUTS, [*features.DOWNTIME_FEATURES, "next_downtime"]),
}


@pytest.mark.parametrize("name", FEATURES)
def test_feature_steps_shuffle_jobs_once(spark, sf_dir, name):
    inputs, columns = FEATURES[name]
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    made = getattr(features, name)(q_ml._inputs(spark, sf_dir, inputs)).select(*columns)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    left = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before
    assert len([x for x in left if x.startswith("stage_")]) == 1, left  # the copies: no whole rows are stored between steps
