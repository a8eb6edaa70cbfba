"""Sinks (SNK1-SNK6): summary tables, CTAS, exports, feature dumps, reports, model storage.

All writes are distributed DataFrame writes (no driver collect); paths are
normally under shared storage.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json")


def save_tables(tables: dict[str, DataFrame], base_path: str, fmt: str = "parquet") -> dict[str, str]:
    """SNK1: write every table as `<name>_summary`, replacing earlier versions."""
    out = {}
    for name, df in tables.items():
        path = f"{base_path.rstrip('/')}/{name}_summary"
        df.write.mode("overwrite").format(fmt).save(path)
        out[name] = path
    return out


def create_summary_tables(spark: SparkSession, joblog: DataFrame, location: str) -> list[str]:
    """SNK2: CREATE TABLE IF NOT EXISTS ... USING parquet AS SELECT for the two SQL summaries."""
    from ..operators.summaries import sql_machine_summary, sql_operator_summary
    made = []
    for name, df in (("machine_performance_summary", sql_machine_summary(joblog)),
                     ("operator_performance_summary", sql_operator_summary(joblog))):
        if not spark.catalog.tableExists(name):
            df.write.format("parquet").option("path", f"{location.rstrip('/')}/{name}").saveAsTable(name)
            made.append(name)
    return made


def export(df: DataFrame, path: str, fmt: str = "parquet") -> dict:
    """SNK3: export a (filtered) job log; returns rows written, format and path."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; use one of {FORMATS}")
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    n = df.sparkSession.read.format(fmt).option("header", True).load(path).count()
    return {"rows": n, "format": fmt, "path": path}


def dump_features(df: DataFrame, path: str) -> None:
    """SNK4: features as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def feature_report(df: DataFrame, feature_groups: dict[str, list[str]], path: str | None = None) -> DataFrame:
    """SNK5: one-row report: feature count, per-group counts, shape and efficiency statistics
    (written as JSON when a path is given)."""
    cols = [c for cols in feature_groups.values() for c in cols]
    rep = df.agg(F.count(F.lit(1)).alias("rows"), F.avg("efficiency").alias("efficiency_mean"),
                 F.stddev_samp("efficiency").alias("efficiency_std"), F.min("efficiency").alias("efficiency_min"),
                 F.max("efficiency").alias("efficiency_max"))
    rep = rep.withColumns({"feature_count": F.lit(len(cols)), "columns": F.lit(len(df.columns)),
                           **{f"{g}_features": F.lit(len(c)) for g, c in feature_groups.items()}})
    if path:
        rep.coalesce(1).write.mode("overwrite").json(path)
    return rep


def save_model(model, path: str) -> str:
    """SNK6: persist a fitted model. A classifier or regressor of `models.training` is stored whole (preparation with medians and
    feature order, learner, flags); a bare pipeline as it is."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return path
    from ..models.training import save

    return save(model, path)


def load_model(path: str):
    """The model that `save_model` stored under `path`."""
    from ..models.training import SETTINGS, load

    spark = SparkSession.getActiveSession()
    told = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{SETTINGS}")
    whole = told.getFileSystem(spark._jsc.hadoopConfiguration()).exists(told)
    return load(path) if whole else PipelineModel.load(path)
