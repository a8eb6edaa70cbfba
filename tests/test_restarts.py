"""Clusters are the best of ten restarts for each k, and predictions are made once for all metrics."""

from pyspark.sql import functions as F

from lathe.models import clustering, metrics
from lathe.plans.tables import F as derived


def test_ten_restarts_for_each_k(spark, sf_dir, monkeypatch):
    real, fits = clustering.KMeans, []

    class Recorded(real):
        def fit(self, *a, **kw):
            model = super().fit(*a, **kw)
            fits.append((self.getK(), self.getSeed(), model.summary.trainingCost))
            return model
    monkeypatch.setattr(clustering, "KMeans", Recorded)
    f = derived(spark, sf_dir)
    out = clustering.cluster_operators(f).collect()
    n = f.select("OperatorName").distinct().count()
    for k in range(2, min(8, n // 2)):
        assert len({seed for at, seed, _ in fits if at == k}) == 10
    monkeypatch.undo()
    k = out[0]["k"]
    costs = [cost for at, _, cost in fits if at == k]
    vec = clustering.VectorAssembler(inputCols=[f"{c}_z" for c in clustering.FEATURES], outputCol="features").transform(clustering.operator_features(f))
    rows = [(r["features"].toArray(), {o["OperatorName"]: o["cluster"] for o in out}[r["OperatorName"]]) for r in vec.collect()]
    centres = {c: sum(x for x, at in rows if at == c) / sum(at == c for _, at in rows) for c in {at for _, at in rows}}
    assert abs(sum(((x - centres[at]) ** 2).sum() for x, at in rows) - min(costs)) < 1e-6 * max(costs)


def test_rows_are_predicted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return f"c{x % 3}"
    pred = spark.range(60).select(F.concat(F.lit("c"), F.col("id") % 2).alias("label"), F.udf(one)("id").alias("prediction"))
    out = metrics.classification_metrics(pred).collect()
    assert seen.value == 60 and {r["class"] for r in out} == {"c0", "c1", "c2"}
