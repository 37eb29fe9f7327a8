"""Spark-native reconciliation of two tables: compare, explain, and predict a migration."""

from twinledger.plans.spec import (
    ColumnPair,
    CompareOptions,
    CompareSpec,
    ExpansionRule,
    SourceSpec,
    TransformRule,
)
from twinledger.plans.run import CompareResult, run_compare

__all__ = [
    "ColumnPair",
    "CompareOptions",
    "CompareResult",
    "CompareSpec",
    "ExpansionRule",
    "SourceSpec",
    "TransformRule",
    "run_compare",
]
