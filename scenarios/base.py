"""Shared helpers of the scenario queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.positions import read_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a scenario query and, where SQL can say it, its check."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positioned(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", columns)


def round2_sql(x: str) -> str:
    """SQL twin of ``round2``: the exact product by 100, half to even."""
    hi = f"(({x}) * 100.0::DOUBLE)"
    split = f"(({x}) * 134217729.0::DOUBLE)"
    upper = f"({split} - ({split} - ({x})))"
    err = f"(({upper} * 100.0::DOUBLE - {hi}) + (({x}) - {upper}) * 100.0::DOUBLE)"
    part = f"({hi} - floor({hi}))"
    up = (
        f"({part} > 0.5 OR ({part} = 0.5 AND {err} > 0) "
        f"OR ({part} = 0.5 AND {err} = 0 AND floor({hi})::BIGINT % 2 = 1))"
    )
    return f"((floor({hi}) + CASE WHEN {up} THEN 1 ELSE 0 END) / 100.0::DOUBLE)"
