"""Every query by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.plans import graph_plans, quality_plans, source_plans, text_plans  # noqa: F401
from quarrystone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module coupling: one scan and three joins, two distinct aggregations."""
    return QUERIES["module_coupling"](spark, sf_dir)
