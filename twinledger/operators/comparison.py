"""The classified rows of one comparison and their public JSON form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.payload import any_differs, differs, json_names, json_object
from twinledger.operators.align import ROW_ID, named
from twinledger.plans.spec import LEFT, MATCH, MISMATCH, RIGHT

CLASSIFIED = (ROW_ID, "status", "side")


@dataclass(frozen=True)
class Comparison:
    """``frame``: row_id, status, side, key columns, and ``left``/``right`` value structs.

    ``side`` tells which input the row comes from (``both`` for a pair), and the struct of
    an absent side is NULL. ``diff_pairs`` are the column pairs that decide a mismatch.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    left_values: tuple[str, ...]
    right_values: tuple[str, ...]
    diff_pairs: tuple[tuple[str, str], ...]

    def diff_flags(self) -> dict[str, Column]:
        mismatch = F.col("status") == MISMATCH
        return {
            left: mismatch & differs(side_value(LEFT, left), side_value(RIGHT, right))
            for left, right in self.diff_pairs
        }

    def results(self) -> DataFrame:
        """The result table: JSON payloads as text, plus the explicit side of each row."""
        keys = {k.removeprefix("key_"): named(k) for k in self.keys}
        return self.frame.select(
            ROW_ID,
            "status",
            json_object(keys).alias("key_values"),
            _payload_json(LEFT, self.left_values).alias("left_data"),
            _payload_json(RIGHT, self.right_values).alias("right_data"),
            json_names(self.diff_flags()).alias("diff_columns"),
            "side",
        )


def side_value(side: str, column: str) -> Column:
    return F.col(side).getField(f"{side}_{column}")


def _payload_json(side: str, values: tuple[str, ...]) -> Column:
    if not values:
        return F.lit("{}")
    whole = F.to_json(F.col(side), {"ignoreNullFields": "false"})
    return F.when(F.col(side).isNull(), F.lit("{}")).otherwise(whole)


def pair_status(diff_pairs) -> Column:
    """match or mismatch for a row that has both sides."""
    pairs = [(side_value(LEFT, a), side_value(RIGHT, b)) for a, b in diff_pairs]
    return F.when(any_differs(pairs), F.lit(MISMATCH)).otherwise(F.lit(MATCH))


def absent(like: DataFrame, side: str) -> Column:
    """A typed NULL standing for the values of a side that has no row."""
    return F.lit(None).cast(like.schema[side].dataType)
