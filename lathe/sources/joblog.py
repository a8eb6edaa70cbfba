"""Job-log scans (SRC1-SRC8) over any DataFrame source (parquet, JDBC, Delta, ...).

Every scan is a lazy predicate/projection so filters and column lists reach
the file scan (`PushedFilters`, `ReadSchema`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import clean_strict


def read_joblog(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a stored job log (parquet by default; any `spark.read` format)."""
    return spark.read.format(fmt).options(**options).load(path)


def read_joblog_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Read the job log from a JDBC database (partitioned reads via the standard options)."""
    return spark.read.jdbc(url, table, properties=options)


def all_data(df: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC1: full scan, optional deterministic row limit (StartTime, JobNumber order)."""
    if limit is None:
        return df
    return df.orderBy("StartTime", "JobNumber").limit(limit)


def date_range(df: DataFrame, start: str, end: str, columns=None) -> DataFrame:
    """SRC2: StartTime BETWEEN start AND end (inclusive) and year > 1970, sorted by StartTime."""
    ts = F.col("StartTime")
    out = df.where(ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
                   & (F.year(ts) > 1970))
    if columns:
        out = out.select(*columns)
    return out.orderBy("StartTime")


def machine_data(df: DataFrame, name: str) -> DataFrame:
    """SRC3."""
    return df.where(F.col("machine") == name)


def operator_data(df: DataFrame, name: str) -> DataFrame:
    """SRC4."""
    return df.where(F.col("OperatorName") == name)


def run_sql(spark: SparkSession, query: str, params: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SRC5: ad-hoc SQL with named parameters over the given frames ({name} in the text)."""
    return spark.sql(query, args=params or {}, **frames)


def table_info(df: DataFrame) -> DataFrame:
    """SRC6: column, type and nullability of a frame's schema."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("type", T.StringType()),
                           T.StructField("nullable", T.BooleanType())])
    return df.sparkSession.createDataFrame(rows, schema)


def clean_data(df: DataFrame, apply_filters: bool = True) -> DataFrame:
    """SRC7: the strict clean scan."""
    return clean_strict(df) if apply_filters else df


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """SRC8: list values -> IN, scalars -> equality; unknown columns are ignored."""
    preds = []
    for k, v in (filters or {}).items():
        if k not in df.columns:
            continue
        preds.append(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v))
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df
