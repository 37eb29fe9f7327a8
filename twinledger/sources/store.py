"""Result store with versions and a page directory.

A version is a manifest that names written parts; it is there at once or not at all, and no part is ever
changed. Readers keep the version they opened. The rows of a part lie in files in row order, each file in
blocks of ``rows_per_file`` rows or less, and a directory says how many rows of each status each block
holds, so a page opens the files it is in and reads its blocks.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinledger.operators.align import ROW_ID
from twinledger.operators.report import RESULT_ORDER, SHALLOW_ROWS, cut_page
from twinledger.plans.spec import STATUSES
from twinledger.session import materialise

ROWS_PER_FILE = 1_000_000
BLOCK = "_block"
NO_ROW_ID = -(1 << 63)
"""Stands in the directory for a row without an id, which comes first."""
RESULT_SCHEMA = (
    f"{ROW_ID} long, status string, key_values string, left_data string, right_data string, "
    "diff_columns string, side string"
)


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[str, ...]
    schema: StructType


class _Files:
    """The few file operations a manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self.root = root
        self.system = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        if not self.system.exists(path):
            return []
        return sorted(str(s.getPath().getName()) for s in self.system.listStatus(path))

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(f"{self.root}/{name}"))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist; False if another writer was first."""
        path = self._path(f"{self.root}/{name}")
        try:
            stream = self.system.create(path, False)
        except Py4JJavaError:
            if self.system.exists(path):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True


class ResultStore:
    """Results under one folder: append, replace, clear, read any version, open any page.

    Two writers may append at once: the later one puts its part behind the earlier one's. A manifest that
    a lost writer left unfinished is no version.

    ``rows_per_file`` is what the directory tells apart, the rows of one block. It may be small: a file
    takes as many whole blocks as its task has, up to ``ROWS_PER_FILE`` rows, as files of few rows cost more
    to make and to list than their rows do.
    """

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file
        self.files = _Files(spark, self.path)

    def versions(self) -> list[int]:
        return [v.number for v in map(self._version, self._numbers()) if v is not None]

    def version(self, number: int | None = None) -> Version | None:
        """The given version, or the newest; None if the store has none."""
        if number is not None:
            return self._version(number)
        for newest in reversed(self._numbers()):
            found = self._version(newest)
            if found is not None:
                return found
        return None

    def append(self, results: DataFrame) -> int:
        return self._commit(results, lambda before: before.parts if before else ())

    def replace(self, results: DataFrame) -> int:
        return self._commit(results, lambda before: ())

    def clear(self) -> int:
        """An empty version; the columns stay."""
        before = self.version()
        schema = before.schema if before else self.spark.createDataFrame([], RESULT_SCHEMA).schema
        return self._publish(schema, None, lambda before: ())

    def read(self, number: int | None = None) -> DataFrame:
        version = self._opened(number)
        return self._rows(version, [f"{self.path}/data/{part}" for part in version.parts])

    def counts(self, number: int | None = None) -> DataFrame:
        """(status, n_rows) from the directory alone, zero-filled."""
        known = self.spark.createDataFrame([(s,) for s in STATUSES], "status string")
        held = self._directory(self._opened(number)).groupBy("status").agg(F.sum("n").alias("n"))
        return known.join(held, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_rows"))

    def page(self, page: int = 1, size: int = 100, status: str | None = None, number: int | None = None) -> DataFrame:
        """One page in row order. Only the files that may hold its rows are opened: one or two of each part
        for a page of few rows, and only its blocks of them are read. The directory tells both without
        counting any result rows; the driver sees its sums per file, then the blocks of the opened files."""
        version = self._opened(number)
        held = self._directory(version)
        if status:
            held = held.where(F.col("status") == status)
        skip = (page - 1) * size
        files, before = _holding(held, ["part", "file"], skip, size)
        found = files
        if size <= SHALLOW_ROWS:
            blocks = held.where(F.col("file").isin([f["file"] for f in files]))
            found, passed = _holding(blocks, ["part", "file", "block"], skip - before, size)
            before += passed
        pieces = [self._piece(version, part, found) for part in version.parts if any(f["part"] == part for f in found)]
        rows = reduce(DataFrame.union, pieces) if pieces else self._rows(version, [])
        if status:
            rows = rows.where(F.col("status") == status)
        return cut_page(rows, skip - before, size)

    def _piece(self, version: Version, part: str, found: list[Row]) -> DataFrame:
        """The rows of a part in the given files or blocks; the blocks of a page follow each other."""
        mine = [f for f in found if f["part"] == part]
        paths = sorted({f"{self.path}/data/{f['file']}" for f in mine})
        blocks = [f["block"] for f in mine if "block" in f]
        if not blocks or None in blocks:
            return self._rows(version, paths)
        schema = StructType([*version.schema.fields, StructField(BLOCK, LongType())])
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.where(F.col(BLOCK).between(min(blocks), max(blocks))).drop(BLOCK)

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json") and n[:-5].isdigit()]

    def _version(self, number: int) -> Version | None:
        try:
            read = json.loads(self.files.read(f"versions/{number:012d}.json"))
        except ValueError:
            return None
        return Version(number, tuple(read["parts"]), StructType.fromJson(read["schema"]))

    def _opened(self, number: int | None) -> Version:
        version = self.version(number)
        if version is None:
            raise ValueError(f"no version {'' if number is None else number} in {self.path}")
        return version

    def _rows(self, version: Version, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*paths)

    def _directory(self, version: Version) -> DataFrame:
        schema = "file string, block long, status string, n long, low long, high long"
        paths = [f"{self.path}/directory/{part}" for part in version.parts]
        held = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return held.withColumn("part", F.substring_index("file", "/", 1))

    def _commit(self, results: DataFrame, earlier) -> int:
        """Write a part in row order with its directory, then make it a version."""
        part = uuid.uuid4().hex
        folder = f"{self.path}/data/{part}"
        landed = results if _is_cheap(results) else materialise(results, "store-input")
        ordered = landed.repartitionByRange(*RESULT_ORDER).sortWithinPartitions(*RESULT_ORDER)
        place = F.monotonically_increasing_id()
        ordered.withColumn(BLOCK, F.call_function("div", place, F.lit(self.rows_per_file))).write.option(
            "maxRecordsPerFile", max(self.rows_per_file, ROWS_PER_FILE)
        ).parquet(folder)
        schema = StructType.fromJson(results.schema.jsonValue())
        for field in schema:
            field.nullable = True
        written = self.spark.read.schema(StructType([*schema.fields, StructField(BLOCK, LongType())])).parquet(folder)
        rank = F.coalesce(ROW_ID, F.lit(NO_ROW_ID))
        written.groupBy(
            F.concat(F.lit(f"{part}/"), F.col("_metadata.file_name")).alias("file"), F.col(BLOCK).alias("block"), "status"
        ).agg(
            F.count(F.lit(1)).alias("n"), F.min(rank).alias("low"), F.max(rank).alias("high")
        ).write.parquet(f"{self.path}/directory/{part}")
        return self._publish(schema, part, earlier)

    def _publish(self, schema: StructType, part: str | None, earlier) -> int:
        while True:
            before = self.version()
            if part is not None and before is not None and before.parts and before.schema != schema and earlier(before):
                raise ValueError("appended results need the columns of the store")
            number = max(self._numbers(), default=0) + 1
            parts = [*earlier(before), *([part] if part else [])]
            text = json.dumps({"parts": parts, "schema": schema.jsonValue()})
            if self.files.create(f"versions/{number:012d}.json", text):
                return number


def _is_cheap(results: DataFrame) -> bool:
    """Whether rows are only read, filtered and projected; others are landed, as a range sort computes its
    input twice."""
    plan = results._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def _holding(held: DataFrame, by: list[str], skip: int, size: int) -> tuple[list[Row], int]:
    """The groups of a directory that may hold the ``size`` rows after ``skip``, and the rows of those that lie
    wholly before them."""
    groups = held.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    lows = _Ranks([(g["low"], g["n"]) for g in groups])
    highs = _Ranks([(g["high"], g["n"]) for g in groups])
    found, before = [], 0
    for group in groups:
        if lows.upto(group["high"]) <= skip:
            before += group["n"]
        elif highs.below(group["low"]) < skip + size:
            found.append(group)
    return found, before


class _Ranks:
    """Sums of counts below a key and up to it."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.keys, self.sums, total = [], [0], 0
        for key, n in sorted(pairs):
            total += n
            self.keys.append(key)
            self.sums.append(total)

    def upto(self, key: int) -> int:
        return self.sums[bisect_right(self.keys, key)]

    def below(self, key: int) -> int:
        return self.sums[bisect_left(self.keys, key)]
