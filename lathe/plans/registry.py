"""Registry of named queries: a Spark builder and (where SQL can express it) a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.publish import publish

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `name`; outputs are published
    (doubles rounded to 6 places, integers widened) for exact comparison."""

    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: publish(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_agg, q_ano, q_clean, q_fea, q_mat, q_misc, q_ml, q_ops, q_rec, q_stream, q_win  # noqa: F401
