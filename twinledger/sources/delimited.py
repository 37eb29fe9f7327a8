"""Delimited text with line breaks inside quotes, read in parallel splits.

Whether a line begins inside a quoted field hangs on everything before it. Each line is a function of
the two states (outside, inside); a split composes its lines' functions, the splits of a file are
composed in order, and every line then knows its record: the last line before it that begins outside.
"""

from __future__ import annotations

import csv
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.session import broadcast_if_small, estimated_bytes, materialise

# Fixed value: the separators that are looked for.
SEPARATORS = ",;\t|"


SHORT_LINE = 1_000
"""Bytes of a line up to which Java's expressions tell its states; they recurse, so longer ones are left to Python."""

TASK_BYTES = 32 << 20


class LineStates:
    """What a line makes of either state, from its text alone; a quote opens a field only at its beginning."""

    def __init__(self, separator: str):
        sep = re.escape(separator.encode("latin-1"))
        self.separator = sep.decode("latin-1")
        body = rb'[^"]*+(?:""[^"]*+)*+"[^%b]*+' % sep
        field = rb'(?:"%b|[^"%b][^%b]*+|)' % (body, sep, sep)
        self.outside = re.compile(rb"%b(?:%b%b)*+" % (field, sep, field), re.DOTALL)
        self.closing = re.compile(body, re.DOTALL)

    def after(self, line: bytes) -> tuple[int, int]:
        """The state after the line if it begins outside, and if it begins inside quotes."""
        if b'"' not in line:
            return 0, 1
        return self._from_outside(line), self._from_inside(line)

    def expressions(self) -> tuple[str, str]:
        """What the whole of a line matches that ends outside, if it begins outside and if inside quotes."""
        outside, body = (p.pattern.decode("latin-1") for p in (self.outside, self.closing))
        return rf"(?s)\A{outside}\z", rf"(?s)\A{body}(?:{self.separator}{outside})?+\z"

    def _from_outside(self, line: bytes) -> int:
        return 0 if self.outside.fullmatch(line) else 1

    def _from_inside(self, line: bytes) -> int:
        closed = self.closing.match(line)
        if not closed:
            return 1
        rest = line[closed.end() :]
        return self._from_outside(rest[1:]) if rest else 0


def states_before(after: np.ndarray, start: int) -> np.ndarray:
    """State before each line (and after the last) of lines with functions ``after`` (n by 2)."""
    n = len(after)
    fixed = after[:, 0] == after[:, 1]
    swaps = np.concatenate([[0], np.cumsum((after[:, 0] == 1) & (after[:, 1] == 0))])
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(fixed, np.arange(n), -1))]) if n else np.array([-1])
    known = np.where(last >= 0, after[last, 0], start) if n else np.full(1, start)
    since = swaps - np.where(last >= 0, swaps[last + 1], 0)
    return (known + since) % 2


_LINES = (
    "file string, block long, line long, value binary, before_0 int, before_1 int, after_0 int, after_1 int, "
    "record_0 long, record_1 long"
)


def _packed(df: DataFrame, nbytes: int) -> DataFrame:
    """Several splits per task where they are many and small; each stays whole and in its place."""
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-nbytes // TASK_BYTES))
    return df.coalesce(tasks) if tasks < splits else df


def _line_states(line: Column, separator: str, multi_line: bool) -> list[Column]:
    """The states after a line for either state before it (NULL if the line is too long to tell here), and
    whether it is more than blanks."""
    text = F.decode(line.cast("binary"), "ISO-8859-1")
    short = F.octet_length(line) <= SHORT_LINE
    after = [
        F.when(~F.contains(line, F.lit('"')), F.lit(way)).when(short, F.when(F.rlike(text, F.lit(ends)), 0).otherwise(1))
        if multi_line else F.lit(0)
        for way, ends in enumerate(LineStates(separator).expressions())
    ]
    wanted = F.btrim(line, F.lit(" \t\n\r\x0b\x0c")) != ""
    return [*[a.cast("int").alias(f"after_{way}") for way, a in enumerate(after)], wanted.alias("wanted")]


def _borders(batch: pa.RecordBatch) -> list[int]:
    """Where another split begins within a batch."""
    if batch.num_rows < 2:
        return []
    other = [pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)) for c in (batch.column(0), batch.column(1))]
    return (np.flatnonzero(pc.or_(*other).to_numpy(zero_copy_only=False)) + 1).tolist()


def _annotate(separator: str, skip_rows: int):
    """Lines in scan order with, for either state of the split's beginning, the states before and after
    them and the number of records of the split that begin up to them."""
    names = [part.split()[0] for part in _LINES.split(", ")]

    def run(batches):
        states = LineStates(separator)
        split, number, carried = None, 0, []
        for batch in batches:
            borders = _borders(batch)
            for begin, end in zip([0, *borders], [*borders, batch.num_rows]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                file, block = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                if (file, block) != split:
                    split, number, carried = (file, block), 0, [(0, 0), (1, 0)]
                after = np.column_stack([pc.fill_null(part.column(i), -1).to_numpy() for i in (3, 4)]).astype(np.int64)
                for i in np.flatnonzero(after[:, 0] < 0).tolist():
                    after[i] = states.after(part.column(2)[i].as_py())
                lines = np.arange(number, number + part.num_rows)
                wanted = part.column(5).to_numpy(zero_copy_only=False).astype(bool)
                if block == 0:
                    after[lines < skip_rows] = (0, 1)
                    wanted = wanted & (lines >= skip_rows)
                before, counts = [], []
                for way, (state, records) in enumerate(carried):
                    known = states_before(after, state)
                    before.append(known.astype(np.int32))
                    counts.append(records + np.cumsum((known[:-1] == 0) & wanted))
                    carried[way] = (int(known[-1]), int(counts[-1][-1]))
                number += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lines), part.column(2),
                     *[pa.array(s[:-1]) for s in before], *[pa.array(s[1:]) for s in before], *map(pa.array, counts)],
                    names=names,
                )

    return run


def scanned_lines(spark: SparkSession, path: str, separator: str, skip_rows: int = 0, multi_line: bool = True) -> DataFrame:
    """All physical lines with their states, written once: a second scan might split otherwise."""
    text = spark.read.option("lineSep", "\n").text(path)
    nbytes = estimated_bytes(text)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"), *_line_states(F.col("value"), separator, multi_line),
    )
    written = materialise(_packed(lines, nbytes).mapInArrow(_annotate(separator, skip_rows), _LINES), "csv-lines")
    return _packed(written, nbytes)


def _splits(lines: DataFrame, skip_rows: int, has_header: bool) -> DataFrame:
    """Per split: its first state, the records of its file before it, and the rows of earlier files.

    One row per split is put in order by windows: a constant function fixes the state, swaps since then
    turn it round.
    """
    last = [F.max_by(f"after_{way}", "line").alias(f"after_{way}") for way in (0, 1)]
    ends = lines.groupBy("file", "block").agg(
        *last, *[F.max(f"record_{way}").alias(f"n_{way}") for way in (0, 1)],
        *[F.max((F.col(f"before_{way}") == 1) | (F.col(f"after_{way}") == 1)).alias(f"longer_{way}") for way in (0, 1)],
        F.count(F.lit(1)).alias("n_lines"),
    )
    in_file = Window.partitionBy("file").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when((F.col("after_0") == 1) & (F.col("after_1") == 0), 1).otherwise(0)
    counted = ends.withColumn("swaps", F.sum(swap).over(in_file.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "fixed", F.when(F.col("after_0") == F.col("after_1"), F.struct(F.col("after_0").alias("state"), F.col("swaps")))
    )
    fixed = F.last("fixed", ignorenulls=True).over(earlier)
    turned = F.coalesce(F.last("swaps").over(earlier), F.lit(0)) - F.coalesce(fixed["swaps"], F.lit(0))
    short = F.raise_error(F.concat(F.lit("the rows to skip fill a whole split of "), F.col("file"))).cast("int")
    several = F.count(F.lit(1)).over(Window.partitionBy("file")) > 1
    known = counted.withColumn(
        "state",
        F.when((F.col("block") == 0) & several & (F.col("n_lines") <= skip_rows), short)
        .otherwise((F.coalesce(fixed["state"], F.lit(0)) + turned) % 2),
    ).withColumn("n", F.when(F.col("state") == 0, F.col("n_0")).otherwise(F.col("n_1")))
    files = known.groupBy("file").agg(F.sum("n").alias("all"))
    rows = F.greatest(F.col("all") - int(has_header), F.lit(0))
    files = files.select(
        "file", F.coalesce(F.sum(rows).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before")
    )
    placed = known.select(
        "file", "block", "state", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records_before"),
        F.when(F.col("state") == 0, F.col("longer_0")).otherwise(F.col("longer_1")).alias("longer"),
    )
    return materialise(placed.join(files, "file"), "csv-splits")


def csv_records(lines: DataFrame, splits: DataFrame, charset: str, has_header: bool, skip_rows: int, longer: bool) -> DataFrame:
    """(file, is_first, row, value): the text of every record that isn't blank, after the skipped lines.

    ``is_first`` marks the first one of each file; ``row`` numbers all rows (records but headers) by file
    and place. A record on one line stays where it is; only lines of longer records are brought together,
    by their number, if there are any. A quote that is never closed makes the rest of its file one record.
    """
    def known(name):
        return F.when(F.col("state") == 0, F.col(f"{name}_0")).otherwise(F.col(f"{name}_1"))

    in_file = F.col("records_before") + known("record")
    text = F.decode("value", charset)
    placed = lines.join(broadcast_if_small(splits.drop("longer")), ["file", "block"]).where(
        (F.col("block") > 0) | (F.col("line") >= skip_rows)
    ).select(
        "file", "block", "line", text.alias("value"), (in_file == 1).alias("is_first"),
        (F.col("rows_before") + in_file - int(has_header)).alias("row"), known("before").alias("before"), known("after").alias("after"),
    ).where((F.col("before") == 1) | (F.trim(F.rtrim("value", F.lit("\r"))) != ""))
    whole = (F.col("before") == 0) & (F.col("after") == 0)
    records = placed.where(whole).select("file", "is_first", "row", "value")
    if longer:
        parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
        records = records.union(
            placed.where(~whole).groupBy("row", "is_first", "file").agg(parts.alias("parts")).select(
                "file", "is_first", "row", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")
            )
        )
    return records.withColumn("value", F.regexp_replace("value", "\r$", ""))


def _first_record(lines: DataFrame, records: DataFrame, file: str | None, charset: str, skip_rows: int) -> str | None:
    """The text of the first record of a file, from the lines of its first split if it has one there."""
    head = lines.where(
        (F.col("file") == file) & (F.col("block") == 0) & (F.col("record_0") == 1) & (F.col("line") >= skip_rows)
    ).select("line", F.decode("value", charset).alias("value"), "before_0").orderBy("line").collect()
    head = [r["value"] for r in head if r["before_0"] == 1 or r["value"].strip()]
    if not head:
        found = records.where("is_first").orderBy("file").first()
        return found["value"] if found else None
    return re.sub("\r$", "", "\n".join(head))


def read_quoted_csv(
    spark: SparkSession, path: str, separator: str, charset: str, has_header: bool = True, skip_rows: int = 0,
    multi_line: bool = True, number: str = "row",
) -> DataFrame:
    """Every column a string, and ``number`` with the row number in order of file and place.

    The first record of every file is its header if there is one; names are those of the first file's,
    else ``col_0`` and so on. Lines end in LF or CR LF. The skipped rows are the first lines of each file.
    """
    lines = scanned_lines(spark, path, separator, skip_rows, multi_line)
    splits = _splits(lines, skip_rows, has_header)
    figures = splits.agg(F.min("file").alias("file"), F.max("longer").alias("longer")).first()
    records = csv_records(lines, splits, charset, has_header, skip_rows, bool(figures["longer"]))
    first = _first_record(lines, records, figures["file"], charset, skip_rows)
    fields = next(csv.reader([first], delimiter=separator)) if first else ["_dummy"]
    titles = fields if has_header else [f"col_{i}" for i in range(len(fields))]
    schema = ", ".join(f"_c{i} string" for i in range(len(fields)))
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    kept = records.where("NOT is_first") if has_header else records
    return kept.select(F.from_csv("value", schema, options).alias("r"), "row").select("r.*", "row").toDF(*titles, number)


def _plain(line: Column) -> Column:
    """A line without its quoted parts."""
    return F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)


def vote_separator(spark: SparkSession, path: str) -> str:
    """The separator that most lines hold equally often, by one aggregate over all lines.

    Separators inside quotes have no vote. Among equals the one with more fields wins, then the order
    of ``SEPARATORS``; a comma if no line holds any.
    """
    line = _plain(F.col("value"))
    counts = F.array(*[
        F.struct(F.lit(i).alias("place"), (F.length(line) - F.length(F.replace(line, F.lit(s), F.lit("")))).alias("n"))
        for i, s in enumerate(SEPARATORS)
    ])
    votes = (
        spark.read.option("lineSep", "\n").text(path).select(F.explode(counts).alias("v")).where("v.n > 0")
        .groupBy("v.place", "v.n").agg(F.count(F.lit(1)).alias("lines"))
        .orderBy(F.desc("lines"), F.desc("n"), "place").first()
    )
    return SEPARATORS[votes["place"]] if votes else ","
