"""Registered queries: each runs a library operator over whole given tables.

A query is a function ``(spark, sf_dir) -> DataFrame`` registered with its DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its oracle where SQL can express it."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all() -> None:
    """Import the query modules so that they register themselves."""
    from evalspark.queries import (  # noqa: F401
        q_adapt, q_checks, q_dialogue, q_efficiency, q_facts, q_jobs, q_metrics, q_provenance, q_replies, q_retrieval, q_selection,
        q_sources, q_streaming,
        q_text)
