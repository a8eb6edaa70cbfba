"""Operator clustering (ML14): k-means over six per-operator features, k chosen by silhouette."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import sdiv
from ..session import stored_statistics

FEATURES = ["efficiency_mean", "consistency_score", "SetupTime_mean", "parts_per_hour", "versatility_score",
            "total_downtime_mean"]


def operator_features(F_: DataFrame) -> DataFrame:
    """Per-operator features, median-filled and standardised with the population std
    (the scaling sklearn uses). One row per operator: a small table."""
    f = F_.groupBy("OperatorName").agg(
        F.avg("efficiency").alias("efficiency_mean"), F.stddev_samp("efficiency").alias("efficiency_std"),
        F.avg("SetupTime").alias("SetupTime_mean"), F.avg("total_downtime").alias("total_downtime_mean"),
        F.avg("PartsProduced").alias("_parts"), F.avg("JobDuration").alias("_dur"),
        F.countDistinct("machine").alias("_m"), F.countDistinct("PartNumber").alias("_p"))
    f = f.withColumns({
        "parts_per_hour": sdiv(F.col("_parts") * 3600, F.col("_dur")),
        "consistency_score": 1 / (1 + F.col("efficiency_std")),
        "versatility_score": (F.col("_m") * F.col("_p")).cast("double"),
    })
    med = f.agg(*[F.median(c).alias(f"{c}__m") for c in FEATURES])
    f = f.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(c, f"{c}__m") for c in FEATURES})
    st = f.agg(*[F.avg(c).alias(f"{c}__a") for c in FEATURES], *[F.stddev_pop(c).alias(f"{c}__s") for c in FEATURES])
    f = f.crossJoin(F.broadcast(st)).withColumns({
        f"{c}_z": (F.col(c) - F.col(f"{c}__a")) / F.when(F.col(f"{c}__s") == 0, 1.0).otherwise(F.col(f"{c}__s"))
        for c in FEATURES})
    return f.select("OperatorName", *FEATURES, *[f"{c}_z" for c in FEATURES])


def label_expr() -> Column:
    """Rule-based cluster names from the cluster's mean characteristics.

    Fixed values: thresholds 0.8 efficiency and consistency, versatility 5 with
    efficiency 0.7, setup under 300 s, productivity over 10 parts per hour."""
    e, c, v, s, p = (F.col(x) for x in ("c_eff", "c_cons", "c_vers", "c_setup", "c_pph"))
    return (F.when((e > 0.8) & (c > 0.8), "High Performers")
            .when((v > 5) & (e > 0.7), "Versatile Operators")
            .when(c > 0.8, "Consistent Workers")
            .when(s < 300, "Setup Specialists")
            .when(p > 10, "High Productivity")
            .otherwise("Developing Operators"))


SEEDS = tuple(range(42, 52))  # fixed value: ten restarts


def best_restart(vec: DataFrame, k: int, seeds) -> KMeansModel:
    """The k-means model of the least squared distances of the restarts; each runs until its centres rest."""
    fitted = [KMeans(k=k, seed=seed, maxIter=300, featuresCol="features", predictionCol="cluster").fit(vec) for seed in seeds]
    return min(fitted, key=lambda m: m.summary.trainingCost)


def cluster_operators(F_: DataFrame, max_k: int = 8, seeds=SEEDS, default_k: int = 3) -> DataFrame:
    """ML14: k in 2 .. min(8, n // 2) - 1 by best silhouette, each k by the best of its restarts;
    returns OperatorName, cluster, cluster_label, silhouette, k."""
    f = stored_statistics(operator_features(F_))
    vec = VectorAssembler(inputCols=[f"{c}_z" for c in FEATURES], outputCol="features").transform(f).cache()
    n = vec.count()
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
    best = None
    for k in range(2, min(max_k, n // 2)):
        pred = best_restart(vec, k, seeds).transform(vec)
        s = ev.evaluate(pred)
        if best is None or s > best[0]:
            best = (s, k, pred)
    if best is None:
        k = max(1, min(default_k, n))
        best = (None, k, best_restart(vec, k, seeds).transform(vec))
    s, k, pred = best
    per = pred.groupBy("cluster").agg(
        F.avg("efficiency_mean").alias("c_eff"), F.avg("consistency_score").alias("c_cons"),
        F.avg("versatility_score").alias("c_vers"), F.avg("SetupTime_mean").alias("c_setup"),
        F.avg("parts_per_hour").alias("c_pph"), F.count(F.lit(1)).alias("cluster_size"))
    lab = per.select("cluster", "cluster_size", label_expr().alias("cluster_label"))
    return pred.join(lab, "cluster").select("OperatorName", "cluster", "cluster_label", "cluster_size",
                                            F.lit(s).cast("double").alias("silhouette"), F.lit(k).alias("k"))
