"""Normalised views of the two sides, the starting point of every compare."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.normalise import key_text, normalise_columns
from twinledger.plans.spec import LEFT, CompareSpec, TransformRule, rules_for

ROW_ID = "row_id"
SPREAD = "_spread"


def named(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def scattered(side: str) -> Column:
    """A number per row that is never 0, so that it marks the row and deals it out evenly."""
    return F.xxhash64(F.col(ROW_ID), F.lit(side)).bitwiseOR(F.lit(1))


def unique_names(names: Iterable[str]) -> list[str]:
    seen: dict[str, str] = {}
    for name in names:
        seen.setdefault(name.lower(), name)
    return list(seen.values())


@dataclass(frozen=True)
class View:
    """One side after cleaning.

    ``frame`` holds ``row_id``, the ``key_*`` columns, ``_spread`` and ``<side>_<column>``
    values. ``_spread`` is 0 for usable keys and a per-row number for keys with a NULL, so
    such rows, which never pair up, hash evenly instead of landing in one partition.
    """

    frame: DataFrame
    side: str
    keys: tuple[str, ...]
    values: tuple[str, ...]

    @property
    def join_keys(self) -> list[str]:
        return [*self.keys, SPREAD]

    @property
    def keyed(self) -> DataFrame:
        return self.frame.where(F.col(SPREAD) == 0)

    def payload(self) -> Column:
        fields = [named(v) for v in self.values] or [F.lit(0).alias("_none")]
        return F.struct(*fields)

    def packed(self) -> DataFrame:
        """row id, join keys and the values as one struct."""
        return self.frame.select(
            ROW_ID, *[named(k) for k in self.join_keys], self.payload().alias(self.side)
        )


def align(
    df: DataFrame,
    spec: CompareSpec,
    side: str,
    rules: Iterable[TransformRule] = (),
    extra: Iterable[str] = (),
    row_id: str | None = None,
) -> View:
    """Project one side to keys and normalised values; everything else is pruned at the scan.

    ``row_id`` names a column holding a number unique within the side. Without it rows get
    Spark's increasing ids: unique and in scan order, but with gaps.
    """
    rules = list(rules)
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    keys = []
    for pair in spec.key_columns:
        source = pair.left_col if side == LEFT else pair.right_col
        text = key_text(source, types.get(source.lower()))
        keys.append(text.alias(f"key_{pair.left_col}"))
    key_names = tuple(f"key_{p.left_col}" for p in spec.key_columns)
    compared = [p.left_col if side == LEFT else p.right_col for p in spec.compare_columns]
    columns = unique_names([*compared, *extra])
    number = named(row_id).cast("bigint") if row_id else F.monotonically_increasing_id() + 1
    frame = normalise_columns(
        df, [number.alias(ROW_ID), *keys],
        [(c, f"{side}_{c}", rules_for(rules, c, side)) for c in columns], spec.options,
    )
    unusable = F.lit(False)
    for key in key_names:
        unusable = unusable | named(key).isNull()
    spread = F.when(unusable, scattered(side)).otherwise(F.lit(0).cast("bigint"))
    frame = frame.select(
        ROW_ID, *[named(k) for k in key_names], spread.alias(SPREAD),
        *[named(f"{side}_{c}") for c in columns],
    )
    return View(frame, side, key_names, tuple(f"{side}_{c}" for c in columns))
