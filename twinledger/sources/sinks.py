"""Result store and exports: distributed writes, sharded to the sizes spreadsheets can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators.align import ROW_ID, named
from twinledger.operators.report import RESULT_COLUMNS, RESULT_ORDER, filter_results
from twinledger.sources.store import RESULT_SCHEMA

SHEET_ROWS = 1_048_575
BYTE_ORDER_MARK = "﻿"


def save_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a result partitioned by status, so a status filter reads only its files."""
    results.write.mode(mode).partitionBy("status").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """A stored result; one that holds no rows has its columns all the same."""
    return spark.read.schema(RESULT_SCHEMA).parquet(path).select(*RESULT_COLUMNS, "side")


def clear_results(results: DataFrame, path: str) -> None:
    """Leave an empty result of the same layout behind."""
    save_results(results.limit(0), path)


def export_results(
    results: DataFrame, path: str, status: str | None = None, sheet_rows: int | None = None
) -> None:
    """CSV in row order with a header per file; ``sheet_rows`` caps the rows of each file."""
    ordered = filter_results(results, status).select(*RESULT_COLUMNS).orderBy(*RESULT_ORDER)
    write_csv(ordered, path, sheet_rows)


def export_expected(
    expected: DataFrame, path: str, ordered: bool = True, sheet_rows: int | None = None
) -> None:
    """Expected rows as CSV in source order, each file opening with a byte order mark."""
    rows = expected.orderBy(ROW_ID) if ordered else expected
    columns = [c for c in expected.columns if c != ROW_ID]
    marked = [
        named(c).alias(BYTE_ORDER_MARK + c if i == 0 else c) for i, c in enumerate(columns)
    ]
    write_csv(rows.select(*marked), path, sheet_rows)


def write_csv(rows: DataFrame, path: str, sheet_rows: int | None = None) -> None:
    """CSV with a header per file, doubled quotes and every space kept."""
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
    writer = writer.option("ignoreTrailingWhiteSpace", False)
    if sheet_rows:
        writer = writer.option("maxRecordsPerFile", min(sheet_rows, SHEET_ROWS))
    writer.csv(path)
