"""All queries, collected from the catalogue modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netlens.plans import q_actions, q_dataset, q_detect, q_episodes, q_features, q_learn, q_prep, q_quality, q_rules, q_scan, q_sources, q_streaming  # noqa: F401
from netlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_features.flagship(spark, sf_dir)
