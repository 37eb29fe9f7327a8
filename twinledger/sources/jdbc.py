"""Database scans as partitioned JDBC reads; the driver jar comes with the cluster."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.plans.spec import SourceSpec

# URL prefix, default port, driver class and identifier quote per database, and
# the schemas that belong to the database itself.
DIALECTS = {
    "postgres": ("jdbc:postgresql", 5432, "org.postgresql.Driver", '"'),
    "mysql": ("jdbc:mysql", 3306, "com.mysql.cj.jdbc.Driver", "`"),
}
SYSTEM_SCHEMAS = {
    "postgres": ("information_schema", "pg_catalog", "pg_toast"),
    "mysql": ("information_schema", "mysql", "performance_schema", "sys"),
}


def _quoted(name: str, mark: str) -> str:
    return mark + name.replace(mark, mark * 2) + mark


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def relation(source: SourceSpec) -> str:
    """``schema.table`` in the database's quoting, or the custom query as a derived table."""
    if source.use_custom_query and source.custom_query:
        return f"({source.custom_query}) AS _q"
    mark = DIALECTS[source.source_type][3]
    return f"{_quoted(source.schema_name, mark)}.{_quoted(source.table_name, mark)}"


def jdbc_options(source: SourceSpec) -> dict[str, str]:
    """Reader options; a partition column splits the read into parallel range queries."""
    prefix, port, driver, _ = DIALECTS[source.source_type]
    link = source.pg_connection_inline or {}
    host, database = link.get("host", "localhost"), link.get("database", "")
    options = {
        "url": f"{prefix}://{host}:{link.get('port', port)}/{database}",
        "driver": driver,
        "user": str(link.get("username", "")),
        "password": str(link.get("password", "")),
        "dbtable": relation(source),
        "fetchsize": str(source.fetch_size),
    }
    if source.source_type == "mysql":
        options["url"] += "?useCursorFetch=true&characterEncoding=UTF-8"
    if source.partition_column:
        if not (source.lower_bound and source.upper_bound and source.num_partitions > 0):
            raise ValueError("a partition column needs both bounds and a partition count")
        options |= {
            "partitionColumn": source.partition_column,
            "lowerBound": source.lower_bound,
            "upperBound": source.upper_bound,
            "numPartitions": str(source.num_partitions),
        }
    return options


def _bound(value, kind: T.DataType) -> str:
    if isinstance(kind, T.DateType):
        return f"DATE '{value}'"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"TIMESTAMP '{value}'"
    return str(value)


def equi_depth_predicates(values: DataFrame, column: str, parts: int, mark: str) -> list[str]:
    """Conditions on ``column`` that together take each row once: ``parts`` ranges of about as many rows
    each, between sampled quantiles, and the NULLs.

    Only bounds come from the quantiles, so errors in them cost balance, not rows; a value as common as
    several parts is one range. Numbers, dates and timestamps only: a database may sort texts otherwise.
    """
    kind = values.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{column} is neither number, date nor timestamp")
    name = _quoted(column, mark)
    shares = [i / parts for i in range(1, parts)]
    usable = values.where(~F.isnan(column)) if isinstance(kind, (T.DoubleType, T.FloatType)) else values
    found = usable.agg(F.percentile_approx(column, shares, 10_000)).first()[0] if shares else None
    finite = {v for v in found or [] if not isinstance(v, float) or math.isfinite(v)}
    bounds = [_bound(v, kind) for v in sorted(finite)]
    if not bounds:
        return [f"{name} IS NULL", f"{name} IS NOT NULL"]
    between = [f"{name} >= {low} AND {name} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [f"{name} IS NULL", f"{name} < {bounds[0]}", *between, f"{name} >= {bounds[-1]}"]


def read_jdbc(spark: SparkSession, source: SourceSpec) -> DataFrame:
    """A parallel read by the given bounds; a partition column without bounds is read once by itself
    first, and its quantiles are the bounds."""
    if not source.partition_column or source.lower_bound or source.upper_bound:
        return spark.read.format("jdbc").options(**jdbc_options(source)).load()
    options = jdbc_options(replace(source, partition_column=""))
    values = spark.read.format("jdbc").options(**options).load().select(source.partition_column)
    mark = DIALECTS[source.source_type][3]
    predicates = equi_depth_predicates(values, source.partition_column, source.num_partitions, mark)
    url, table = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)


def schemas_query(source_type: str) -> str:
    system = ", ".join(_text(s) for s in SYSTEM_SCHEMAS[source_type])
    return (
        "SELECT schema_name FROM information_schema.schemata "
        f"WHERE schema_name NOT IN ({system}) ORDER BY schema_name"
    )


def tables_query(schema: str) -> str:
    return (
        "SELECT table_name FROM information_schema.tables "
        f"WHERE table_schema = {_text(schema)} AND table_type = 'BASE TABLE' ORDER BY table_name"
    )


def columns_query(schema: str, table: str) -> str:
    return (
        "SELECT column_name FROM information_schema.columns "
        f"WHERE table_schema = {_text(schema)} AND table_name = {_text(table)} "
        "ORDER BY ordinal_position"
    )


def catalog_query(spark: SparkSession, source: SourceSpec, query: str) -> list[str]:
    """Run one of the catalog queries; it returns a handful of names."""
    options = jdbc_options(source)
    for key in ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        options.pop(key, None)
    names = spark.read.format("jdbc").options(**options, query=query).load()
    return [row[0] for row in names.collect()]
