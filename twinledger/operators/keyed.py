"""Keyed 1:1 compare.

``window``: both sides are stacked and shuffled once by key; counts per side and the partner
row come out of one window. ``join``: the same answer from key counts and joins.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.operators.align import ROW_ID, SPREAD, View, align, named, scattered
from twinledger.operators.comparison import Comparison, absent, pair_status
from twinledger.operators.skew import HEAVY, flag_heavy, heavy_keys, is_large, lookup
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
from twinledger.session import materialise


def keyed_views(
    left: DataFrame,
    right: DataFrame,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    left_row_id: str | None = None,
    right_row_id: str | None = None,
) -> tuple[View, View]:
    spec.validate(left.schema, right.schema)
    rules = list(rules)
    return (
        align(left, spec, LEFT, rules, row_id=left_row_id),
        align(right, spec, RIGHT, rules, row_id=right_row_id),
    )


def stacked_keys(left: View, right: View) -> DataFrame:
    """Join keys of both sides with a side marker; no value columns."""
    return left.frame.select(*map(named, left.join_keys), F.lit(LEFT).alias("side")).union(
        right.frame.select(*map(named, right.join_keys), F.lit(RIGHT).alias("side"))
    )


def _side_count(side: str) -> Column:
    return F.count(F.when(F.col("side") == side, F.lit(1)))


def key_counts(left: View, right: View) -> DataFrame:
    """Rows per usable key on each side; combined before the shuffle, so a hot key is cheap."""
    return (
        stacked_keys(left, right)
        .where(F.col(SPREAD) == 0)
        .groupBy(*map(named, left.join_keys))
        .agg(_side_count(LEFT).alias("n_left"), _side_count(RIGHT).alias("n_right"))
    )


def _repeated() -> Column:
    return (F.col("n_left") > 1) | (F.col("n_right") > 1)


def ambiguous_keys(left: View, right: View) -> DataFrame:
    """Keys held by more than one row on either side. A key with a NULL is never ambiguous,
    but one that repeats on a side is listed, as the grouping itself treats NULLs as equal."""
    return (
        stacked_keys(left, right)
        .groupBy(*map(named, left.keys))
        .agg(_side_count(LEFT).alias("n_left"), _side_count(RIGHT).alias("n_right"))
        .where(_repeated())
        .select(*map(named, left.keys))
    )


def _stack(left: View, right: View) -> DataFrame:
    """Both sides in one layout; the struct of the other side is NULL and tells them apart."""
    a, b = left.packed(), right.packed()
    shared = [ROW_ID, *map(named, left.join_keys)]
    return a.select(*shared, LEFT, absent(b, RIGHT).alias(RIGHT)).union(
        b.select(*shared, absent(a, LEFT).alias(LEFT), RIGHT)
    )


def _diff_pairs(spec: CompareSpec) -> tuple[tuple[str, str], ...]:
    return tuple((p.left_col, p.right_col) for p in spec.compare_columns)


def _compare_window(
    left: View, right: View, diff_pairs, min_bytes: int | None
) -> DataFrame:
    keys = left.join_keys
    stack = _stack(left, right)
    from_left = F.col(LEFT).isNotNull()
    usable_keys = stack.where(F.col(SPREAD) == 0)
    heavy = heavy_keys(usable_keys, keys) if is_large(usable_keys, keys, min_bytes) else None
    if heavy is not None:
        # a heavy key has three rows at least, so it is ambiguous and its rows need no company
        own = F.when(from_left, scattered(LEFT)).otherwise(scattered(RIGHT))
        stack = flag_heavy(stack, heavy, keys).withColumn(
            SPREAD, F.when(F.col(HEAVY), own).otherwise(F.col(SPREAD))
        ).drop(HEAVY)
    group = Window.partitionBy(*map(named, keys))
    counted = stack.select(
        "*",
        F.count(LEFT).over(group).alias("n_left"),
        F.count(RIGHT).over(group).alias("n_right"),
        F.first(RIGHT, ignorenulls=True).over(group).alias("_partner"),
    )
    usable = F.lit(True)
    for key in left.keys:
        usable = usable & named(key).isNotNull()
    proven = usable & (F.col(SPREAD) != 0)
    paired = usable & (F.col("n_left") == 1) & (F.col("n_right") == 1)
    rows = counted.where(~paired | from_left).select(
        ROW_ID,
        F.when(proven | (usable & _repeated()), F.lit(DUPLICATE_KEY))
        .when(paired, F.lit(None))
        .when(from_left, F.lit(MISSING_RIGHT))
        .otherwise(F.lit(MISSING_LEFT))
        .alias("_status"),
        F.when(paired, F.lit(BOTH))
        .when(from_left, F.lit(LEFT))
        .otherwise(F.lit(RIGHT))
        .alias("side"),
        *map(named, left.keys),
        LEFT,
        F.when(paired, F.col("_partner")).otherwise(F.col(RIGHT)).alias(RIGHT),
    )
    status = F.coalesce(F.col("_status"), pair_status(diff_pairs)).alias("status")
    return rows.select(ROW_ID, status, "side", *map(named, left.keys), LEFT, RIGHT)


def _one_sided(view: View, other: View, rows: DataFrame, status: str | Column) -> DataFrame:
    empty = absent(other.packed(), other.side)
    sides = {view.side: F.col(view.side), other.side: empty.alias(other.side)}
    return rows.select(
        ROW_ID,
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        F.lit(view.side).alias("side"),
        *map(named, view.keys),
        sides[LEFT],
        sides[RIGHT],
    )


def _matched(view: View, dim: DataFrame, how: str, min_bytes: int | None) -> DataFrame:
    keys = view.join_keys
    return lookup(view.packed(), dim, keys, how, is_large(view.frame, keys, min_bytes))


def duplicate_rows(left: View, right: View, min_bytes: int | None = None) -> DataFrame:
    """Every row of both sides whose key is ambiguous."""
    repeated = key_counts(left, right).where(_repeated()).drop("n_left", "n_right")
    branches = [
        _one_sided(
            view,
            other,
            _matched(view, repeated, "left_semi", min_bytes),
            DUPLICATE_KEY,
        )
        for view, other in ((left, right), (right, left))
    ]
    return branches[0].union(branches[1])


def missing_right_rows(left: View, right: View, min_bytes: int | None = None) -> DataFrame:
    """Left rows without a right key; one anti join also drops the ambiguous left keys."""
    blocked = key_counts(left, right).where("n_right > 0 OR n_left > 1")
    dim = blocked.drop("n_left", "n_right")
    rows = _matched(left, dim, "left_anti", min_bytes)
    return _one_sided(left, right, rows, MISSING_RIGHT)


def missing_left_rows(left: View, right: View, min_bytes: int | None = None) -> DataFrame:
    blocked = key_counts(left, right).where("n_left > 0 OR n_right > 1")
    dim = blocked.drop("n_left", "n_right")
    rows = _matched(right, dim, "left_anti", min_bytes)
    return _one_sided(right, left, rows, MISSING_LEFT)


def paired_rows(
    left: View, right: View, diff_pairs, min_bytes: int | None = None
) -> DataFrame:
    """Left and right rows sharing a key that is unique on both sides."""
    unique = key_counts(left, right).where("n_left = 1 AND n_right = 1")
    unique = unique.drop("n_left", "n_right")
    kept = _matched(left, unique, "left_semi", min_bytes)
    partners = _matched(right, unique, "left_semi", min_bytes)
    joined = kept.join(partners.drop(ROW_ID), left.join_keys)
    return joined.select(
        ROW_ID,
        pair_status(diff_pairs).alias("status"),
        F.lit(BOTH).alias("side"),
        *map(named, left.keys),
        LEFT,
        RIGHT,
    )


def _compare_join(left: View, right: View, diff_pairs, min_bytes: int | None) -> DataFrame:
    """Key counts once, landed; one classifying lookup per side; one join of the unique keys."""
    counts = materialise(key_counts(left, right), "key-counts")
    sides = {}
    for view in (left, right):
        sides[view.side] = _matched(view, counts, "left", min_bytes)
    unique = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    alone = ~F.coalesce(unique, F.lit(False))
    branches = []
    for view, other, missing in ((left, right, MISSING_RIGHT), (right, left, MISSING_LEFT)):
        rows = sides[view.side].where(alone)
        status = F.when(F.coalesce(_repeated(), F.lit(False)), DUPLICATE_KEY).otherwise(missing)
        branches.append(_one_sided(view, other, rows, status))
    partners = sides[RIGHT].where(unique).select(*map(named, right.join_keys), RIGHT)
    paired = sides[LEFT].where(unique).join(partners, left.join_keys).select(
        ROW_ID,
        pair_status(diff_pairs).alias("status"),
        F.lit(BOTH).alias("side"),
        *map(named, left.keys),
        LEFT,
        RIGHT,
    )
    return paired.union(branches[0]).union(branches[1])


def compare_keyed(
    left: DataFrame,
    right: DataFrame,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    left_row_id: str | None = None,
    right_row_id: str | None = None,
    strategy: str = "window",
    min_bytes: int | None = None,
) -> Comparison:
    """Classify every row of both sides by its key.

    Keys unique on both sides give one match or mismatch; a key repeated on either side
    makes all its rows ``duplicate_key``; the rest is missing on the other side. A key with
    a NULL never equals another.
    """
    if not spec.key_columns:
        raise ValueError("a keyed compare needs at least one key column")
    a, b = keyed_views(left, right, spec, rules, left_row_id, right_row_id)
    pairs = _diff_pairs(spec)
    if strategy == "window":
        frame = _compare_window(a, b, pairs, min_bytes)
    elif strategy == "join":
        frame = _compare_join(a, b, pairs, min_bytes)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return Comparison(frame, a.keys, a.values, b.values, pairs)
