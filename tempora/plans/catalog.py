"""Query registry shared by ``__spark_entry__``, the benchmark and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is the
    DuckDB oracle (omitted for randomised or model-fitting jobs)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# tables whose rows carry heavy per-row work (texts, JSON, vectors)
CPU_HEAVY = {"documents", "events", "pages", "embeddings", "conversations"}
# of these, tables whose rows are so short that a split of bytes holds millions of them
ROWS_PER_TASK = {"events": 50_000}


def table(spark: SparkSession, sf_dir: str, name: str, whole_splits: bool = False) -> DataFrame:
    """A table; heavy ones are spread over the cluster unless ``whole_splits`` (the caller
    deals their rows itself)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, ROWS_PER_TASK.get(name)) if name in CPU_HEAVY and not whole_splits else df
