"""Every registered query. Importing the plan modules fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditloom.plans import audit_plans, evaluate_plans, features_plans, monitor_plans, pii_plans, policy_plans  # noqa: F401
from creditloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """How does this book route?"""
    return QUERIES["route_book"](spark, folder)
