"""Lazy scans of either side: delimited text, columnar files, JDBC, tables, SQL."""

from __future__ import annotations

import os.path
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators.align import named
from twinledger.operators.rownum import number_in_scan_order
from twinledger.plans.spec import SourceSpec
from twinledger.session import materialise
from twinledger.sources.delimited import read_quoted_csv, vote_separator
from twinledger.sources.jdbc import read_jdbc

READ_PLACE = "_read_place"

# Encodings spelled as Java knows them, and file extensions.
ENCODINGS = {
    "utf": "UTF-8",
    "utf8": "UTF-8",
    "latin1": "ISO-8859-1",
    "iso88591": "ISO-8859-1",
    "cp1252": "windows-1252",
}
EXTENSIONS = {
    ".csv": "csv", ".tsv": "csv", ".txt": "csv",
    ".parquet": "parquet", ".orc": "orc", ".json": "json",
}


def sanitize(name: str) -> str:
    """A header as a safe column name."""
    cleaned = re.sub(r"\W", "_", str(name).strip())
    return ("col_" + cleaned if cleaned[:1].isdigit() else cleaned) or "unnamed"


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column safely; names that collide get ``_2``, ``_3`` and so on."""
    taken: set[str] = set()
    names = []
    for raw in df.columns:
        base = candidate = sanitize(raw)
        n = 2
        while candidate.lower() in taken:
            candidate = f"{base}_{n}"
            n += 1
        taken.add(candidate.lower())
        names.append(candidate)
    return df.toDF(*names)


def encoding_name(encoding: str) -> str:
    return ENCODINGS.get(encoding.lower().replace("-", "").replace("_", ""), encoding)


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator by vote over all lines of all files; a comma when in doubt."""
    return vote_separator(spark, path)


def read_csv(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Delimited text, every column a string. ``multi_line`` allows line breaks inside quotes; such files
    are split as well. Only character sets that don't hold ASCII as it is need one task per file then."""
    charset = encoding_name(source.csv_encoding)
    if _read_in_splits(source):
        df = _read_numbered(spark, source).drop(READ_PLACE)
    else:
        df = (
            spark.read.option("sep", source.csv_separator).option("encoding", charset)
            .option("quote", '"').option("escape", '"').option("multiLine", source.multi_line)
            .option("inferSchema", False).option("header", source.has_header).csv(source.file_path)
        )
        if not source.has_header:
            df = df.toDF(*[f"col_{i}" for i in range(len(df.columns))])
    return null_tokens(sanitize_columns(df), source.null_tokens)


def _holds_ascii(charset: str) -> bool:
    try:
        return '",;\n'.encode(charset) == b'",;\n'
    except LookupError:
        return False


def _read_in_splits(source: SourceSpec) -> bool:
    return source.skip_rows > 0 or source.multi_line and _holds_ascii(encoding_name(source.csv_encoding))


def _read_numbered(spark: SparkSession, source: SourceSpec) -> DataFrame:
    charset = encoding_name(source.csv_encoding)
    if not _holds_ascii(charset):
        raise ValueError(f"rows of {charset} text can't be skipped")
    return read_quoted_csv(
        spark, source.file_path, source.csv_separator, charset,
        source.has_header, source.skip_rows, source.multi_line, READ_PLACE,
    )


def null_tokens(df: DataFrame, tokens: tuple[str, ...], but: str | None = None) -> DataFrame:
    """Turn the given texts into NULL in every column but one."""
    if not tokens:
        return df
    return df.select(*[
        named(c) if c == but else F.when(~named(c).isin(*tokens), named(c)).alias(c) for c in df.columns
    ])


def source_kind(source: SourceSpec) -> str:
    return source.source_type or EXTENSIONS.get(os.path.splitext(source.file_path)[1].lower(), "")


def load_source(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """Any source on either side, with safe column names.

    The kind comes from ``source_type`` or, for files, from the extension. Typed sources stay
    typed; the compare casts them to text itself. Rows of delimited text come in no fixed order; see
    ``load_numbered``.
    """
    kind = source_kind(source)
    if kind == "csv":
        df = read_csv(spark, source)
    elif kind in ("parquet", "orc", "json"):
        df = spark.read.format(kind).load(source.file_path)
    elif kind in ("postgres", "mysql"):
        df = read_jdbc(spark, source)
    elif kind == "table":
        df = spark.table(source.table_name)
    elif kind == "sql":
        df = spark.sql(source.custom_query)
    else:
        raise ValueError(f"unsupported source: {source.source_type or source.file_path!r}")
    return sanitize_columns(df)


def load_numbered(spark: SparkSession, source: SourceSpec, name: str) -> DataFrame:
    """A source with row numbers in scan order.

    Delimited text that is read in splits is numbered by its reader, by file and place, and written once;
    other sources as ``number_in_scan_order`` does.
    """
    if source_kind(source) != "csv" or not _read_in_splits(source):
        return number_in_scan_order(load_source(spark, source), name)
    read = _read_numbered(spark, source)
    names = sanitize_columns(read).columns[:-1]
    return materialise(null_tokens(read.toDF(*names, name), source.null_tokens, but=name), "csv-rows")


def preview(df: DataFrame, n_rows: int | None = 50) -> DataFrame:
    """The first rows in scan order, or all of them."""
    return df if n_rows is None else df.limit(n_rows)


def source_stats(sources: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts per named source, each counted where it lies."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in sources.items()
    ]
    total = counted[0]
    for part in counted[1:]:
        total = total.union(part)
    return total


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every column name of either side and where it occurs."""
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    rows = [(n, n in left.columns, n in right.columns) for n in names]
    return left.sparkSession.createDataFrame(
        rows, "name string, in_left boolean, in_right boolean"
    )


def column_profile(df: DataFrame, side: str) -> DataFrame:
    """Filled values per column, from one aggregate over the source."""
    counted = df.agg(*[F.count(named(c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"_{i}").alias(f"{side}_filled"))
        for i, c in enumerate(df.columns)
    ])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def catalog_schemas(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def catalog_tables(spark: SparkSession, schema: str) -> list[str]:
    tables = spark.catalog.listTables(schema)
    return sorted(t.name for t in tables if t.tableType in ("MANAGED", "EXTERNAL"))


def catalog_columns(spark: SparkSession, schema: str, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(f"`{schema}`.`{table}`")]
