"""Registry of named queries: ``name -> (spark builder, oracle SQL)``.

Every builder takes ``(spark, sf_dir)`` and reads the driver tables (or
data Spark derives from them); every oracle is DuckDB SQL over the same
tables, with identical column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package
            ship_package(spark)      # executors need the package for Python steps
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


_STAGES: dict = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a stage once per (session, sf_dir) and keep it as a table.

    The result is written as parquet under ``spark.checkpoint.dir`` (a
    written table in the shared folder: lineage is cut, lost executors do
    not recompute the chain) and read back, so later queries of the run
    scan it with column pruning and filter pushdown instead of re-running
    the chain that produced it.
    """
    import uuid

    from ..session import scratch_path
    key = (id(spark), sf_dir, name)
    if key not in _STAGES:
        path = scratch_path(spark, f"stage-{name}-{uuid.uuid4().hex[:8]}")
        build().write.mode("overwrite").parquet(path)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (q_clean, q_balance, q_evaluate, q_tokens, q_pages,  # noqa
                   q_llm, q_runs, q_stream, q_score)
