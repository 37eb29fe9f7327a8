"""Summaries, breakdowns, pages and labelled reports over a comparison or a stored result."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.numbers import fixed_point
from twinledger.functions.text import bind
from twinledger.operators.align import ROW_ID, View, named
from twinledger.operators.comparison import Comparison, side_value
from twinledger.operators.rownum import number_by
from twinledger.plans.spec import (
    DUPLICATE_KEY,
    LEFT,
    MATCH,
    MISMATCH,
    MISSING_LEFT,
    MISSING_RIGHT,
    RIGHT,
    STATUS_LABELS,
    STATUSES,
)

RESULT_COLUMNS = (
    ROW_ID, "status", "key_values", "left_data", "right_data", "diff_columns",
)
RESULT_ORDER = (ROW_ID, "status", "key_values", "left_data", "right_data")
"""Total but for rows alike in all columns, so pages of separate jobs fit together."""

DASH = "—"
SHALLOW_ROWS = 100_000


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_LABELS.items())])
    return F.coalesce(labels[status], status)


def thousands_text(number: Column) -> Column:
    """A whole number with commas, ``1,234``."""
    return F.format_number(number.cast("bigint"), 0)


def one_place(value: str) -> str:
    """``%.1f`` of a numeric SQL expression, NULL staying NULL."""
    return bind(f"CAST({value} AS DOUBLE)", "op", fixed_point("op", 1))


def _share(part: str, total: str) -> str:
    return one_place(f"try_divide(CAST({part} AS DOUBLE), {total}) * 100")


def percent(part: str, total: str) -> Column:
    """Share in percent, rounded to one place as the exact binary value; 0 for no rows."""
    return F.expr(
        f"CASE WHEN {total} > 0 THEN CAST({_share(part, total)} AS DOUBLE) ELSE 0.0D END"
    )


def percent_text(part: str, total: str) -> Column:
    return F.expr(f"CASE WHEN {total} > 0 THEN concat({_share(part, total)}, '%') ELSE '0%' END")


def summary_counts(frame: DataFrame) -> DataFrame:
    """One row: the total and a zero-filled count per status."""
    return frame.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(F.when(F.col("status") == s, F.lit(1))).alias(s) for s in STATUSES],
    )


def summary_percentages(summary: DataFrame) -> DataFrame:
    """Match, mismatch and missing percentages, and the rows that could be validated."""
    total = "total_rows"
    return summary.select(
        total,
        (F.col(total) - F.col(DUPLICATE_KEY)).alias("validated_rows"),
        percent(MATCH, total).alias("match_pct"),
        percent(MISMATCH, total).alias("mismatch_pct"),
        percent(f"({MISSING_LEFT} + {MISSING_RIGHT})", total).alias("missing_pct"),
    )


def summary_report(summary: DataFrame) -> DataFrame:
    """The five statuses in fixed order with label, count and percentage text."""
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(s).alias("status"),
            F.lit(STATUS_LABELS[s]).alias("label"),
            F.col(s).alias("row_count"),
        )
        for i, s in enumerate(STATUSES)
    ])
    return summary.select("total_rows", F.explode(rows).alias("r")).select(
        "r.*", percent_text("r.row_count", "total_rows").alias("pct"), "total_rows"
    )


def status_distribution(summary: DataFrame) -> DataFrame:
    """Share of the total of each status that occurs, in fixed order."""
    report = summary_report(summary).where("row_count > 0")
    share = F.col("row_count") / F.col("total_rows") * 100
    return report.select("position", "status", "row_count", share.alias("share"))


def mismatch_breakdown(comparison: Comparison, top: int = 15) -> DataFrame:
    """Columns that differ most: one counter per compared pair, no list to explode."""
    flags = comparison.diff_flags()
    if not flags:
        empty = "column_name string, mismatches long, share string"
        return comparison.frame.sparkSession.createDataFrame([], empty)
    counters = [F.count(F.when(flag, F.lit(1))).alias(f"_{i}") for i, flag in enumerate(flags.values())]
    total = F.count(F.when(F.col("status") == MISMATCH, F.lit(1))).alias("_total")
    counted = comparison.frame.agg(total, *counters)
    rows = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(f"_{i}").alias("mismatches"))
        for i, name in enumerate(flags)
    ])
    return _top(counted.select("_total", F.explode(rows).alias("r")).select("_total", "r.*"), top)


def stored_breakdown(results: DataFrame, top: int = 15) -> DataFrame:
    """The same table from a stored result, whose differences are only JSON text."""
    mismatched = results.where(F.col("status") == MISMATCH)
    listed = F.from_json("diff_columns", "array<string>")
    counts = (
        mismatched.select(F.explode(listed).alias("column_name"))
        .where("column_name IS NOT NULL")
        .groupBy("column_name")
        .agg(F.count(F.lit(1)).alias("mismatches"))
    )
    total = mismatched.agg(F.count(F.lit(1)).alias("_total"))
    return _top(counts.select("*", total.scalar().alias("_total")), top)


def _top(counts: DataFrame, top: int) -> DataFrame:
    shown = counts.where("mismatches > 0").orderBy(F.desc("mismatches"), "column_name").limit(top)
    return shown.select(
        "column_name", "mismatches",
        percent_text("mismatches", "_total").alias("share"),
    )


def duplicate_breakdown(frame: DataFrame) -> DataFrame:
    """How many ambiguous rows each side contributes, by the explicit side."""
    duplicate = F.col("status") == DUPLICATE_KEY
    return frame.agg(
        F.count(F.when(duplicate & (F.col("side") == LEFT), 1)).alias("dup_left"),
        F.count(F.when(duplicate & (F.col("side") == RIGHT), 1)).alias("dup_right"),
    )


def filter_results(
    results: DataFrame, status: str | None = None, search: str | None = None
) -> DataFrame:
    """Status filter (a partition filter on a stored result) and key text search.

    ``search`` is matched inside the key JSON with ``%`` and ``_`` as live wildcards.
    """
    if status:
        results = results.where(F.col("status") == status)
    if search:
        pattern = F.lit(f"%{search}%")
        results = results.where(F.like(F.col("key_values"), pattern, F.lit("\u0001")))
    return results


def page_info(total: int, page: int, size: int) -> dict[str, int]:
    return {
        "page": page,
        "pages": max(1, -(-total // size)),
        "first_row": (page - 1) * size + 1 if total else 0,
        "last_row": min(page * size, total),
        "total": total,
    }


def result_page(
    results: DataFrame,
    page: int = 1,
    size: int = 100,
    status: str | None = None,
    search: str | None = None,
    shallow_rows: int = SHALLOW_ROWS,
) -> DataFrame:
    """One page in row order. A deep page first narrows the row id range by counting, so no
    task ever sorts or skips more than ``shallow_rows`` rows plus the rows of one row id.

    Of a page of more rows than that, what is left after narrowing is numbered by a distributed sort and
    the page cut out by number, so no task holds the page.
    """
    kept = filter_results(results, status, search)
    skip = (page - 1) * size
    if skip + size > shallow_rows:
        kept, skip = _narrow(kept, skip, size, shallow_rows)
    return cut_page(kept.select(*RESULT_COLUMNS), skip, size, shallow_rows)


def cut_page(rows: DataFrame, skip: int, size: int, shallow_rows: int = SHALLOW_ROWS) -> DataFrame:
    """``size`` rows after ``skip`` in row order; more than ``shallow_rows`` of them never meet in one task."""
    if size <= shallow_rows:
        return rows.orderBy(*RESULT_ORDER).offset(skip).limit(size)
    numbered = number_by(rows, list(RESULT_ORDER), "_nth")
    return numbered.where(F.col("_nth").between(skip + 1, skip + size)).orderBy("_nth").drop("_nth")


def _narrow(
    rows: DataFrame, skip: int, size: int, enough: int, buckets: int = 1024
) -> tuple[DataFrame, int]:
    """The rows of a range of row ids that holds the page, and how many of them come before it. Rows without
    a row id come first."""
    low, high, unnumbered = rows.agg(F.min(ROW_ID), F.max(ROW_ID), F.count_if(F.col(ROW_ID).isNull())).first()
    if low is None:
        return rows, skip
    if skip < unnumbered:
        if skip + size <= unnumbered:
            return rows.where(F.col(ROW_ID).isNull()), skip
        rest, _ = _narrow(rows.where(F.col(ROW_ID).isNotNull()), 0, skip + size - unnumbered, enough, buckets)
        return rows.where(F.col(ROW_ID).isNull()).union(rest), skip
    skip -= unnumbered
    while True:
        width = max(1, -(-(high - low + 1) // buckets))
        inside = rows.where(F.col(ROW_ID).between(low, high))
        counts = (
            inside.groupBy(F.expr(f"({ROW_ID} - ({low}L)) div {width}L").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("b")
            .collect()
        )
        passed, first, last = 0, None, None
        for bucket, n in counts:
            if first is None and passed + n > skip:
                first, before = bucket, passed
            if first is not None:
                last = bucket
                if passed + n >= skip + size:
                    break
            passed += n
        if first is None:
            return inside.where(F.lit(False)), 0
        narrowed = low + first * width, min(high, low + (last + 1) * width - 1)
        settled = width == 1 or narrowed == (low, high)
        low, high = narrowed
        skip -= before
        held = sum(n for b, n in counts if first <= b <= last)
        if held <= max(enough, 2 * size) or settled:
            return rows.where(F.col(ROW_ID).between(low, high)), skip


def _entries(json_text: Column) -> Column:
    return F.map_entries(F.from_json(json_text, "map<string,string>"))


def _json_string(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )


def spaced_json(json_text: Column) -> Column:
    """The same flat object written with a space after each comma and colon."""
    parts = F.transform(
        _entries(json_text),
        lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def key_text_list(json_text: Column, separator: str) -> Column:
    parts = F.transform(
        _entries(json_text),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))),
    )
    return F.array_join(parts, separator)


def report_rows(
    results: DataFrame, key_separator: str = "; ", **numbering
) -> DataFrame:
    """The labelled report: running number in row order, status label, readable keys and data."""
    numbered = number_by(
        results.select(*RESULT_COLUMNS), list(RESULT_ORDER),
        "No", **numbering,
    )
    differing = F.from_json("diff_columns", "array<string>")
    return numbered.select(
        "No",
        status_label(F.col("status")).alias("Status"),
        key_text_list(F.col("key_values"), key_separator).alias("Key Values"),
        spaced_json(F.col("left_data")).alias("Data Kiri"),
        spaced_json(F.col("right_data")).alias("Data Kanan"),
        F.array_join(differing, ", ").alias("Kolom Berbeda"),
    )


def detail_wide(comparison: Comparison) -> DataFrame:
    """Side-by-side detail: left and right value per pair, a dash for the missing side."""
    status = F.col("status")

    def shown(side: str, column: str, missing: str) -> Column:
        value = F.coalesce(side_value(side, column), F.lit(""))
        return F.when(status == missing, F.lit(DASH)).otherwise(value)

    lefts = [v.removeprefix(f"{LEFT}_") for v in comparison.left_values]
    rights = [v.removeprefix(f"{RIGHT}_") for v in comparison.right_values]
    interleaved = []
    for i in range(max(len(lefts), len(rights))):
        if i < len(lefts):
            interleaved.append(shown(LEFT, lefts[i], MISSING_LEFT).alias(f"{lefts[i]}_left"))
        if i < len(rights):
            interleaved.append(shown(RIGHT, rights[i], MISSING_RIGHT).alias(f"{rights[i]}_right"))
    flags = comparison.diff_flags()
    names = [F.when(flags[n], F.lit(n)) for n in sorted(flags)]
    differing = F.nullif(F.concat_ws(", ", *names), F.lit("")) if names else F.lit(None)
    keys = [F.coalesce(named(k), F.lit("None")) for k in comparison.keys]
    return comparison.frame.select(
        ROW_ID,
        status_label(status).alias("status_label"),
        F.concat_ws(" / ", *keys).alias("key_text"),
        *interleaved,
        F.coalesce(differing, F.lit(DASH)).alias("diff_text"),
    )


def sample_keys(left: View, right: View, comparison: Comparison, n: int = 5) -> DataFrame:
    """The first keys of each side and of the rows missing on either side."""
    key_json = F.to_json(
        F.struct(*[named(k).alias(k.removeprefix("key_")) for k in left.keys]),
        {"ignoreNullFields": "false"},
    )

    def first(frame: DataFrame, sample: str) -> DataFrame:
        picked = frame.select(ROW_ID, key_json.alias("key_values"))
        return picked.orderBy(ROW_ID).limit(n).select(
            F.lit(sample).alias("sample"), ROW_ID, "key_values"
        )

    def missing(status: str) -> DataFrame:
        return first(comparison.frame.where(F.col("status") == status), status)

    return (
        first(left.frame, LEFT)
        .union(first(right.frame, RIGHT))
        .union(missing(MISSING_RIGHT))
        .union(missing(MISSING_LEFT))
    )
