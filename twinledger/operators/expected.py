"""Expected migration: the rows the target should hold, built from the left source alone."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.functions.normalise import normalise_mapping_value
from twinledger.operators.align import ROW_ID, align, named
from twinledger.operators.expansion import mapping_frame
from twinledger.operators.skew import is_large, lookup
from twinledger.plans.spec import LEFT, CompareSpec, ExpansionRule, TransformRule
from twinledger.session import fits_broadcast


def expected_rows(
    left: DataFrame,
    spec: CompareSpec,
    rules: Iterable[TransformRule] = (),
    rule: ExpansionRule | None = None,
    mapping: DataFrame | None = None,
    normalise_mapping: bool = False,
    row_id: str | None = None,
) -> DataFrame:
    """One row per left row under the target names, or one per mapped target with a rule.

    ``row_id`` leads each row; drop it or order by it when writing. Mapping values are joined
    as they stand unless ``normalise_mapping`` asks for the compare's cleaning. A left value
    outside the mapping keeps itself in the first target column, the rest being NULL.
    """
    extra = [rule.left_col] if rule else []
    view = align(left, spec, LEFT, list(rules), extra, row_id)
    keys = [named(f"key_{p.left_col}").alias(p.right_col) for p in spec.key_columns]
    if rule is None:
        values = [named(f"{LEFT}_{p.left_col}").alias(p.right_col) for p in spec.compare_columns]
        return view.frame.select(ROW_ID, *keys, *values)
    if mapping is None:
        mapping = mapping_frame(left.sparkSession, rule)
    cells = [f"rc_{i}" for i in range(len(rule.right_cols))]
    targets = mapping.select("left_val", *cells)
    if normalise_mapping:
        targets = targets.select(
            *[normalise_mapping_value(c, spec.options).alias(c) for c in targets.columns]
        )
    owner = next(v for v in view.values if v.lower() == f"{LEFT}_{rule.left_col}".lower())
    plain = [
        named(f"{LEFT}_{p.left_col}").alias(p.right_col)
        for p in spec.compare_columns
        if p.left_col.lower() != rule.left_col.lower()
    ]
    rows = view.frame.select(ROW_ID, *keys, *plain, named(owner).alias("left_val"))
    marked = targets.withColumn("_known", F.lit(True))
    if fits_broadcast(marked):
        joined = rows.join(F.broadcast(marked), "left_val", "left")
    else:  # few values may hold most left rows, so they are salted
        joined = lookup(rows, marked, ["left_val"], "left", is_large(rows, ["left_val"]))
    filled = [
        F.when(F.col("_known"), F.col(cell)).otherwise(
            F.col("left_val") if i == 0 else F.lit(None)
        ).alias(name)
        for i, (cell, name) in enumerate(zip(cells, rule.right_cols))
    ]
    kept = [named(p.right_col) for p in spec.key_columns] + [
        named(p.right_col)
        for p in spec.compare_columns
        if p.left_col.lower() != rule.left_col.lower()
    ]
    return joined.select(ROW_ID, *kept, *filled)
