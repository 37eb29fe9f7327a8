"""Compare by position: row N of the left against row N of the right."""

from __future__ import annotations

import dataclasses
from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.operators.align import ROW_ID, align
from twinledger.operators.comparison import Comparison, pair_status
from twinledger.operators.rownum import number_by, number_in_scan_order
from twinledger.plans.spec import (
    BOTH,
    LEFT,
    MISSING_LEFT,
    MISSING_RIGHT,
    RIGHT,
    CompareSpec,
    TransformRule,
)

POSITION = "_rownum"


def _numbered(df: DataFrame, order_by: list[str] | None, row_id: str | None) -> DataFrame:
    if row_id:
        return df.withColumnRenamed(row_id, POSITION)
    return number_by(df, order_by, POSITION) if order_by else number_in_scan_order(df, POSITION)


def compare_row_order(
    left: DataFrame,
    right: DataFrame,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    order_by_left: list[str] | None = None,
    order_by_right: list[str] | None = None,
    left_row_id: str | None = None,
    right_row_id: str | None = None,
) -> Comparison:
    """Row numbers are unique on both sides, so one full outer join settles every row.

    Numbers come from an existing 1..n column, from the given order, or from scan order.
    There are no duplicates here and group expansion does not apply.
    """
    rules = list(rules)
    unkeyed = dataclasses.replace(spec, key_columns=(), use_row_order=True)
    unkeyed.validate(left.schema, right.schema)
    a = align(_numbered(left, order_by_left, left_row_id), unkeyed, LEFT, rules, row_id=POSITION)
    b = align(
        _numbered(right, order_by_right, right_row_id), unkeyed, RIGHT, rules, row_id=POSITION
    )
    pairs = tuple((p.left_col, p.right_col) for p in spec.compare_columns)
    joined = a.frame.select(ROW_ID, a.payload().alias(LEFT)).join(
        b.frame.select(ROW_ID, b.payload().alias(RIGHT)), ROW_ID, "full_outer"
    )
    only_left, only_right = F.col(RIGHT).isNull(), F.col(LEFT).isNull()
    frame = joined.select(
        ROW_ID,
        F.when(only_left, F.lit(MISSING_RIGHT))
        .when(only_right, F.lit(MISSING_LEFT))
        .otherwise(pair_status(pairs))
        .alias("status"),
        F.when(only_left, F.lit(LEFT)).when(only_right, F.lit(RIGHT)).otherwise(F.lit(BOTH))
        .alias("side"),
        F.col(ROW_ID).cast("string").alias("key_row"),
        LEFT,
        RIGHT,
    )
    return Comparison(frame, ("key_row",), a.values, b.values, pairs)
