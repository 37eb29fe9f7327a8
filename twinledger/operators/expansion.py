"""Group expansion: a left value stands for several right rows named in a mapping table.

A mapped left row matches when any of its mapped right tuples exists under its key. Unmapped
left rows fall back to a plain key join with the right rows outside the mapping.
"""

from __future__ import annotations

import dataclasses
from typing import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.normalise import normalise_mapping_value
from twinledger.operators.align import ROW_ID, SPREAD, View, align, named
from twinledger.operators.comparison import Comparison, absent, pair_status
from twinledger.operators.skew import flag_members, is_large, lookup
from twinledger.plans.spec import (
    BOTH,
    LEFT,
    MATCH,
    MISSING_LEFT,
    MISSING_RIGHT,
    RIGHT,
    CompareSpec,
    ExpansionRule,
    TransformRule,
)
from twinledger.session import broadcast_if_small, fits_broadcast, materialise

OWNER = "_owner"
MAPPED = "_mapped"


def mapping_frame(spark, rule: ExpansionRule) -> DataFrame:
    """The rule's own mapping as rows (left_val, rc_0 …), short rows padded with ''.

    Made through Arrow, so it is a local relation of known size that a size check can pass.
    """
    names = ["left_val", *[f"rc_{i}" for i in range(len(rule.right_cols))]]
    rows = rule.mapping_rows()
    columns = {n: pa.array([r[i] for r in rows], type=pa.string()) for i, n in enumerate(names)}
    return spark.createDataFrame(pa.table(columns))


@dataclasses.dataclass(frozen=True)
class _Parts:
    left: DataFrame
    right: DataFrame
    mapping: DataFrame
    left_view: View
    right_view: View
    keys: list[str]
    cells: list[str]
    small_mapping: bool
    large_left: bool
    large_right: bool


def _prepare(left, right, spec, rule, mapping, rules, left_row_id, right_row_id,
             min_bytes) -> _Parts:
    a = align(left, spec, LEFT, rules, [rule.left_col], left_row_id)
    b = align(right, spec, RIGHT, rules, rule.right_cols, right_row_id)
    by_lower = {v.lower(): v for v in (*a.values, *b.values)}
    cells = [f"rc_{i}" for i in range(len(rule.right_cols))]
    clean = materialise(mapping.select(
        normalise_mapping_value("left_val", spec.options).alias(OWNER),
        *[normalise_mapping_value(c, spec.options).alias(c) for c in cells],
    ).distinct(), "mapping")
    small = fits_broadcast(mapping)
    large_left = is_large(a.frame, a.join_keys, min_bytes)
    large_right = is_large(b.frame, b.join_keys, min_bytes)
    owner = named(by_lower[f"{LEFT}_{rule.left_col}".lower()])
    left_rows = a.frame.select(
        ROW_ID, *map(named, a.join_keys), owner.alias(OWNER), a.payload().alias(LEFT)
    )
    owners = materialise(clean.where(F.col(OWNER).isNotNull()).select(OWNER).distinct(), "mapping-owners")
    left_rows = flag_members(left_rows, owners, [OWNER], MAPPED, small, large_left)
    right_cells = [
        named(by_lower[f"{RIGHT}_{c}".lower()]).alias(cell)
        for c, cell in zip(rule.right_cols, cells)
    ]
    right_rows = b.frame.select(
        ROW_ID, *map(named, b.join_keys), *right_cells, b.payload().alias(RIGHT)
    )
    whole = clean.where(" AND ".join(f"{c} IS NOT NULL" for c in cells))
    tuples = materialise(whole.select(*cells).distinct(), "mapping-tuples")
    right_rows = flag_members(right_rows, tuples, cells, MAPPED, small, large_right)
    return _Parts(
        left_rows, right_rows, whole, a, b, a.join_keys, cells, small, large_left, large_right
    )


def _offers(parts: _Parts) -> DataFrame:
    """What the right side offers per key: the first right row of each mapped left value,
    and whether any row is free for the fallback. One scan and one aggregate, combined before
    its shuffle."""
    usable = parts.right.drop(MAPPED).where(F.col(SPREAD) == 0)
    owned = flag_members(
        usable, parts.mapping, parts.cells, MAPPED, parts.small_mapping, parts.large_right
    )
    mapped = F.col(MAPPED)
    return (
        owned.select(
            *map(named, parts.keys),
            MAPPED,
            F.when(mapped, F.col(OWNER)).otherwise(F.lit("")).alias(OWNER),
            ROW_ID,
            F.when(mapped, F.col(RIGHT)).alias(RIGHT),
        )
        .groupBy(*map(named, parts.keys), MAPPED, OWNER)
        .agg(F.min_by(RIGHT, ROW_ID).alias(RIGHT))
        .withColumn("_offered", F.lit(True))
    )


def _left_outcome(parts: _Parts) -> DataFrame:
    """Each left row with its offer, if any: one shuffle of the left side."""
    asking = parts.left.withColumn(
        OWNER, F.when(F.col(MAPPED), F.col(OWNER)).otherwise(F.lit(""))
    )
    on = [*parts.keys, MAPPED, OWNER]
    return lookup(asking, _offers(parts), on, "left", parts.large_left)


def answered_left(parts: _Parts, outcome: DataFrame) -> DataFrame:
    """Mapped rows with an offer match; rows of either kind without one are missing."""
    offered = F.col("_offered").isNotNull()
    return outcome.where(F.col(MAPPED) | ~offered).select(
        ROW_ID,
        F.when(offered, F.lit(MATCH)).otherwise(F.lit(MISSING_RIGHT)).alias("status"),
        F.when(offered, F.lit(BOTH)).otherwise(F.lit(LEFT)).alias("side"),
        *map(named, parts.left_view.keys),
        LEFT,
        RIGHT,
    )


def fallback_pairs(parts: _Parts, diff_pairs) -> DataFrame:
    """Unmapped left rows with the unmapped right rows of their key; all pairs are reported.

    A plain equi join of two shuffled inputs, so AQE may split a skewed key on either side.
    """
    a = parts.left.where(~F.col(MAPPED) & (F.col(SPREAD) == 0))
    b = parts.right.where(~F.col(MAPPED) & (F.col(SPREAD) == 0)).drop(ROW_ID)
    joined = a.select(ROW_ID, *map(named, parts.keys), LEFT).join(
        b.select(*map(named, parts.keys), RIGHT), parts.keys
    )
    return joined.select(
        ROW_ID,
        pair_status(diff_pairs).alias("status"),
        F.lit(BOTH).alias("side"),
        *map(named, parts.left_view.keys),
        LEFT,
        RIGHT,
    )


def uncovered_right(parts: _Parts) -> DataFrame:
    """Right rows nothing on the left asks for: one anti join against the distinct wants."""
    keys = [named(k) for k in parts.keys]
    usable = parts.left.where(F.col(SPREAD) == 0).select(ROW_ID, *keys, MAPPED, OWNER)
    asked = flag_members(
        usable, parts.mapping, [OWNER], "_asked", parts.small_mapping, parts.large_left
    )
    wants = asked.select(
        *keys,
        MAPPED,
        *[F.when(F.col(MAPPED), F.col(c)).otherwise(F.lit("")).alias(c) for c in parts.cells],
    ).distinct()
    cells = [
        F.when(F.col(MAPPED), F.col(c)).otherwise(F.lit("")).alias(c) for c in parts.cells
    ]
    rows = parts.right.select(ROW_ID, *keys, MAPPED, *cells, RIGHT)
    on = [*parts.keys, MAPPED, *parts.cells]
    left_over = lookup(rows, wants, on, "left_anti", parts.large_right)
    return left_over.select(
        ROW_ID,
        F.lit(MISSING_LEFT).alias("status"),
        F.lit(RIGHT).alias("side"),
        *map(named, parts.right_view.keys),
        absent(parts.left, LEFT).alias(LEFT),
        RIGHT,
    )


def unmapped_values(left: DataFrame, spec: CompareSpec, rule: ExpansionRule,
                    mapping: DataFrame, rules: Iterable[TransformRule] = ()) -> DataFrame:
    """Distinct left values the mapping does not know, NULL included."""
    view = align(left, spec, LEFT, list(rules), [rule.left_col])
    column = next(v for v in view.values if v.lower() == f"{LEFT}_{rule.left_col}".lower())
    known = mapping.select(
        normalise_mapping_value("left_val", spec.options).alias("value")
    ).distinct()
    found = view.frame.select(named(column).alias("value")).distinct()
    return found.join(broadcast_if_small(known), "value", "left_anti")


def compare_expanded(
    left: DataFrame,
    right: DataFrame,
    spec: CompareSpec,
    rule: ExpansionRule,
    mapping: DataFrame | None = None,
    rules: Iterable[TransformRule] = (),
    left_row_id: str | None = None,
    right_row_id: str | None = None,
    min_bytes: int | None = None,
) -> Comparison:
    """Classify with a mapping table (left_val, rc_0 …); without one the rule's own is used.

    No row is a duplicate here. The columns the rule names are left out of the fallback
    difference check but stay in the row payloads.
    """
    if not spec.key_columns:
        raise ValueError("group expansion needs at least one key column")
    spec.validate(left.schema, right.schema)
    if mapping is None:
        mapping = mapping_frame(left.sparkSession, rule)
    parts = _prepare(
        left, right, spec, rule, mapping, list(rules), left_row_id, right_row_id, min_bytes
    )
    by_rule = {rule.left_col.lower()}, {c.lower() for c in rule.right_cols}
    diff_pairs = tuple(
        (p.left_col, p.right_col)
        for p in spec.compare_columns
        if p.left_col.lower() not in by_rule[0] and p.right_col.lower() not in by_rule[1]
    )
    outcome = _left_outcome(parts)
    frame = (
        answered_left(parts, outcome)
        .union(fallback_pairs(parts, diff_pairs))
        .union(uncovered_right(parts))
    )
    a, b = parts.left_view, parts.right_view
    return Comparison(frame, a.keys, a.values, b.values, diff_pairs)
