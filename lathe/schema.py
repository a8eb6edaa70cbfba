"""Job-log schema, fixed category lists and configuration constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The eleven downtime categories of a job, in this order.
# The order matters: arg-max ties resolve to the first category listed.
DOWNTIME = [
    "SetupTime",
    "WaitingSetupTime",
    "NotFeedingTime",
    "AdjustmentTime",
    "DressingTime",
    "ToolingTime",
    "EngineeringTime",
    "MaintenanceTime",
    "BuyInTime",
    "BreakShiftChangeTime",
    "IdleTime",
]

# Duration columns that are cleaned together (seconds).
DURATIONS = ["JobDuration", "RunningTime"] + DOWNTIME

UNKNOWN = "Unknown"

JOBLOG_SCHEMA = T.StructType(
    [
        T.StructField("JobNumber", T.StringType(), False),
        T.StructField("machine", T.StringType(), True),
        T.StructField("OperatorName", T.StringType(), True),
        T.StructField("PartNumber", T.StringType(), True),
        T.StructField("EmpID", T.StringType(), True),
        T.StructField("State", T.StringType(), True),
        T.StructField("OpNumber", T.IntegerType(), True),
        T.StructField("StartTime", T.TimestampNTZType(), True),
        T.StructField("EndTime", T.TimestampNTZType(), True),
        T.StructField("JobDuration", T.DoubleType(), True),
        T.StructField("RunningTime", T.DoubleType(), True),
        T.StructField("PartsProduced", T.DoubleType(), True),
    ]
    + [T.StructField(c, T.DoubleType(), True) for c in DOWNTIME]
)


@dataclass(frozen=True)
class Config:
    """Model and feature constants (fixed values of the analysed application)."""

    min_job_duration: float = 60.0
    max_job_duration: float = 86400.0
    max_category_seconds: float = 86400.0
    max_idle_seconds: float = 604800.0
    max_parts_per_job: float = 10000.0
    efficiency_threshold: float = 0.8
    test_size: float = 0.2
    random_state: int = 42
    # Sequence windows: hour buckets to number rows, rows per window chunk, and rows per segment of the time line.
    bucket_unit: str = "hour"
    chunk_rows: int = 20_000
    segment_rows: int = 100_000


DEFAULT = Config()
