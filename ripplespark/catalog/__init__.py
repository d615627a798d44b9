"""Registered queries over the driver's tables, with DuckDB SQL for their results.

The tables stand in for a repository: parts, suppliers and places are source files, orders
are tests, what a line item names is imported, and so on. Every query runs an operator on
such roles over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as shuffles have, before texts are made of them: a table may be one block, which one task would read."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


from . import code, evidence, impact, lexed, ranking, reranking, second_look, texts  # noqa: E402, F401
