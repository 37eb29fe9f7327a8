"""Opt-in 1:N compare: every right row of a key is held against the key's single left row."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.operators.align import ROW_ID, named
from twinledger.operators.comparison import Comparison, absent, pair_status
from twinledger.operators.keyed import keyed_views
from twinledger.operators.skew import is_large, lookup
from twinledger.plans.spec import (
    BOTH,
    DUPLICATE_KEY,
    LEFT,
    MISSING_LEFT,
    MISSING_RIGHT,
    RIGHT,
    CompareSpec,
    TransformRule,
)


def compare_one_to_many(
    left: DataFrame,
    right: DataFrame,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    left_row_id: str | None = None,
    right_row_id: str | None = None,
    min_bytes: int | None = None,
) -> Comparison:
    """Only a key repeated on the left is ambiguous; ``row_id`` of a pair is the right row's."""
    a, b = keyed_views(left, right, spec, rules, left_row_id, right_row_id)
    keys = a.join_keys
    pairs = tuple((p.left_col, p.right_col) for p in spec.compare_columns)
    packed_left, packed_right = a.packed(), b.packed()
    left_by_key = (
        packed_left.where("_spread = 0")
        .groupBy(*map(named, keys))
        .agg(
            F.count(F.lit(1)).alias("n_left"),
            F.min_by(LEFT, ROW_ID).alias(LEFT),
        )
    )
    large = is_large(b.frame, keys, min_bytes)
    right_rows = lookup(packed_right, left_by_key, keys, "left", large)
    single = F.col("n_left") == 1
    from_right = right_rows.select(
        ROW_ID,
        F.when(F.col("n_left").isNull(), F.lit(MISSING_LEFT))
        .when(~single, F.lit(DUPLICATE_KEY))
        .otherwise(pair_status(pairs))
        .alias("status"),
        F.when(single, F.lit(BOTH)).otherwise(F.lit(RIGHT)).alias("side"),
        *map(named, a.keys),
        F.when(single, F.col(LEFT)).alias(LEFT),
        RIGHT,
    )
    counts = left_by_key.select(*map(named, keys), "n_left")
    right_keys = b.keyed.select(*map(named, keys)).distinct()
    state = counts.join(right_keys.withColumn("_met", F.lit(True)), keys, "left")
    large = is_large(a.frame, keys, min_bytes)
    left_rows = lookup(packed_left, state, keys, "left", large)
    from_left = left_rows.where("n_left IS NULL OR n_left > 1 OR _met IS NULL").select(
        ROW_ID,
        F.when(F.col("n_left") > 1, F.lit(DUPLICATE_KEY)).otherwise(F.lit(MISSING_RIGHT))
        .alias("status"),
        F.lit(LEFT).alias("side"),
        *map(named, a.keys),
        LEFT,
        absent(packed_right, RIGHT).alias(RIGHT),
    )
    return Comparison(from_right.union(from_left), a.keys, a.values, b.values, pairs)
