"""Global 1..n row numbers without an unpartitioned window over the data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.operators.align import named
from twinledger.session import broadcast_if_small, materialise

_POSITION = "_position"
_PARTITION_SHIFT = 33


def _is_bare_parquet(df: DataFrame) -> bool:
    """Whether ``df`` is nothing but a parquet scan, so that a row's place in its file is its own.

    File metadata also resolves through sorts and repartitions; only the relation itself counts.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return True
    except AnalysisException:
        return False


def _offset_by(numbered: DataFrame, block: str, name: str) -> DataFrame:
    """Number rows from a position that is consecutive within each block.

    Only one row per block (a file or a written partition) is summed up in order. A row whose
    block was not there when rows were counted fails the query; no row is ever left out.
    """
    counted = materialise(
        numbered.groupBy(block).agg(
            F.count(F.lit(1)).alias("_rows"), F.min(_POSITION).alias("_first")
        ),
        "row-number-blocks",
    )
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(
        block,
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    small = broadcast_if_small(counted)
    if small is not counted:
        offsets = F.broadcast(offsets)
    lost = F.raise_error(F.concat(F.lit("rows of an uncounted block: "), F.col(block)))
    shift = F.coalesce(F.col("_shift"), lost.cast("bigint"))
    return numbered.join(offsets, block, "left").withColumn(name, F.col(_POSITION) + shift)


def _number_written(df: DataFrame, label: str, name: str) -> DataFrame:
    """Write rows once with their partition and place, then number what is written."""
    columns = [named(c) for c in df.columns]
    written = materialise(
        df.select(*columns, F.monotonically_increasing_id().alias("_scan")), label
    )
    staged = written.select(
        *columns,
        F.shiftright("_scan", _PARTITION_SHIFT).alias("_part"),
        F.col("_scan").alias(_POSITION),
    )
    return _offset_by(staged, "_part", name).select(*columns, name)


def number_in_scan_order(df: DataFrame, name: str = "rownum") -> DataFrame:
    """Row numbers in file order (path, then position), or in partition order for other plans.

    A bare parquet scan is numbered with no shuffle and no copy: the file's row index plus the
    rows of the files before it, neither of which depends on how files are split into tasks.
    Every other plan is written once, because its partitions may differ between evaluations.
    """
    if not _is_bare_parquet(df):
        return _number_written(df, "row-number-input", name)
    columns = [named(c) for c in df.columns]
    staged = df.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias(_POSITION),
    )
    return _offset_by(staged, "_file", name).select(*columns, name)


def number_by(df: DataFrame, order_by: list[str], name: str = "rownum") -> DataFrame:
    """Row numbers by ascending columns, NULLs first; ties keep the order they are read in.

    Rows are range partitioned by (order, read position) — unique, so a value shared by many
    rows still splits — sorted and written once; the per-partition counts then turn positions
    into global numbers.
    """
    columns = [named(c) for c in df.columns]
    by = [*map(named, order_by), F.col("_read")]
    ranged = (
        df.withColumn("_read", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
    )
    return _number_written(ranged.select(*columns), "row-number-sorted", name)
