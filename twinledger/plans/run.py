"""One compare from spec to result: load, pick the mode, classify, store, report."""

from __future__ import annotations

import dataclasses
import functools
from dataclasses import dataclass
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession

from twinledger.operators import report
from twinledger.operators.comparison import Comparison
from twinledger.operators.expansion import compare_expanded
from twinledger.operators.keyed import compare_keyed
from twinledger.operators.one_to_many import compare_one_to_many
from twinledger.operators.roworder import compare_row_order
from twinledger.plans.spec import (
    CompareSpec,
    ExpansionRule,
    SourceSpec,
    TransformRule,
    active_expansion_rule,
)
from twinledger.session import materialise
from twinledger.sources import sinks
from twinledger.sources.load import load_numbered
from twinledger.sources.store import ResultStore

ROW_NUMBER = "_source_row"


@dataclass(frozen=True)
class CompareResult:
    """A comparison with its report set. ``results`` is lazy until stored or collected."""

    comparison: Comparison
    left_rows: int | None = None
    right_rows: int | None = None

    @functools.cached_property
    def results(self) -> DataFrame:
        return self.comparison.results()

    def summary(self) -> dict[str, Any]:
        """The counts per status as a plain dict; one row reaches the driver."""
        counts = report.summary_counts(self.comparison.frame).first().asDict()
        return counts | {"_left_rows": self.left_rows, "_right_rows": self.right_rows}

    def summary_report(self) -> DataFrame:
        return report.summary_report(report.summary_counts(self.comparison.frame))

    def percentages(self) -> DataFrame:
        return report.summary_percentages(report.summary_counts(self.comparison.frame))

    def mismatch_breakdown(self, top: int = 15) -> DataFrame:
        return report.mismatch_breakdown(self.comparison, top)

    def duplicate_breakdown(self) -> DataFrame:
        return report.duplicate_breakdown(self.comparison.frame)

    def detail(self) -> DataFrame:
        return report.detail_wide(self.comparison)

    def page(self, page: int = 1, size: int = 100, **filters) -> DataFrame:
        return report.result_page(self.results, page, size, **filters)

    def stored(self, path: str) -> DataFrame:
        """Write the result once and hand back the stored table for all further reading."""
        sinks.save_results(self.results, path)
        return sinks.load_results(self.comparison.frame.sparkSession, path)

    def kept(self, path: str) -> ResultStore:
        """Write the result as a new version of the store at ``path``, for pages that open few files."""
        store = ResultStore(self.comparison.frame.sparkSession, path)
        store.replace(self.results)
        return store

    def landed(self) -> "CompareResult":
        """The same comparison read back from a written table, so reports do not redo it."""
        frame = materialise(self.comparison.frame, "comparison")
        return dataclasses.replace(
            self, comparison=dataclasses.replace(self.comparison, frame=frame)
        )


def compare(
    left: DataFrame,
    right: DataFrame,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    expansions: Iterable[ExpansionRule] = (),
    mapping: DataFrame | None = None,
    one_to_many: bool = False,
    **details: Any,
) -> Comparison:
    """Pick the mode as the spec asks: row order first, then group expansion, then keyed."""
    applied = list(rules) if spec.options.apply_global_transforms else []
    if spec.use_row_order:
        return compare_row_order(left, right, spec, applied, **details)
    if one_to_many:
        return compare_one_to_many(left, right, spec, applied, **details)
    offered = list(expansions) if spec.options.apply_group_expansion else []
    rule = active_expansion_rule(spec, offered)
    if rule is not None:
        return compare_expanded(left, right, spec, rule, mapping, applied, **details)
    return compare_keyed(left, right, spec, applied, **details)


def _land(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """A source with row numbers. All but plain parquet is read once, written and numbered there."""
    return load_numbered(spark, source, ROW_NUMBER)


def run_compare(
    spark: SparkSession,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    expansions: Iterable[ExpansionRule] = (),
    mapping: DataFrame | None = None,
    one_to_many: bool = False,
) -> CompareResult:
    """Load both sources, number their rows in scan order and compare them.

    A stored spec (``CompareSpec.from_json``) re-runs the same comparison.
    """
    left, right = _land(spark, spec.left_source), _land(spark, spec.right_source)
    numbers = {"left_row_id": ROW_NUMBER, "right_row_id": ROW_NUMBER}
    comparison = compare(left, right, spec, rules, expansions, mapping, one_to_many, **numbers)
    return CompareResult(comparison, left.count(), right.count()).landed()
