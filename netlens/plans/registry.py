"""Catalogue of queries: one key per operator of the survey, with its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(key: str, query: Query, oracle: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"duplicate query {key}")
    QUERIES[key] = query
    if oracle is not None:
        ORACLES[key] = oracle


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order cannot show."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(F.round(c, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else c)
    return df.select(*cols)
