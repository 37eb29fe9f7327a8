"""The checked queries: one or more per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions.normalise import normalise, normalise_columns
from twinledger.operators import expansion, keyed, report
from twinledger.operators.align import ROW_ID, align, named
from twinledger.operators.comparison import Comparison
from twinledger.operators.expected import expected_rows
from twinledger.operators.keyed import compare_keyed, keyed_views
from twinledger.operators.one_to_many import compare_one_to_many
from twinledger.operators.rownum import number_by, number_in_scan_order
from twinledger.operators.roworder import compare_row_order
from twinledger.plans import history
from twinledger.plans.run import CompareResult, compare, run_compare
from twinledger.plans.spec import (
    MISMATCH,
    MISSING_LEFT,
    MISSING_RIGHT,
    CompareOptions,
    CompareSpec,
    ExpansionRule,
    SourceSpec,
    TransformRule,
    auto_map,
)
from twinledger.session import scratch_path
from twinledger.sources import load, mapping, sinks
from workload import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ORDERS = CompareSpec.of(
    keys=[("o_orderkey", "order_id")],
    compare=[
        ("o_orderstatus", "status"),
        ("o_totalprice", "total_price"),
        ("o_orderpriority", "priority"),
    ],
)
LINES = CompareSpec.of(
    keys=[("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")],
    compare=[("l_returnflag", "l_returnflag"), ("l_quantity", "l_quantity")],
)
CUSTOMERS = CompareSpec.of(
    keys=[("c_custkey", "cust_id")],
    compare=[("c_name", "cust_name"), ("c_mktsegment", "seg")],
)
EVENTS = CompareSpec.of(
    compare=[("user_id", "user_id"), ("event_type", "event_type")], use_row_order=True
)
SEGMENT_MAPPING: dict[str, list[list[str]]] = {}
for _left, *_right in fx.SEGMENT_ROWS:
    SEGMENT_MAPPING.setdefault(_left, []).append(_right)
SEGMENTS = ExpansionRule("c_mktsegment", ("seg", "sub"), SEGMENT_MAPPING)
SIDED_RULES = (
    TransformRule("o_orderstatus", "left", "prefix", {"text": "S-"}),
    TransformRule("status", "right", "prefix", {"text": "S-"}),
    TransformRule("O_ORDERPRIORITY", "both", "replace", {"old": "URGENT", "new": "TOP"}),
    TransformRule("priority", "left", "suffix", {"text": "!"}),
    TransformRule("status", "right", "suffix", {"text": "?"}, enabled=False),
)
FULL_OPTIONS = CompareOptions(
    ignore_case=True, normalize_date=True, normalize_number=True,
    date_format="%d/%m/%Y", decimal_places=1,
)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name] = function
        return function

    return register


def _orders(spark, d) -> tuple[DataFrame, DataFrame]:
    return fx.frame(spark, d, fx.ORDERS_LEFT), fx.frame(spark, d, fx.ORDERS_RIGHT)


def _lines(spark, d) -> tuple[DataFrame, DataFrame]:
    return fx.frame(spark, d, fx.LINE_LEFT), fx.frame(spark, d, fx.LINE_RIGHT)


def _customers(spark, d) -> tuple[DataFrame, DataFrame]:
    return fx.frame(spark, d, fx.CUST_LEFT), fx.frame(spark, d, fx.CUST_RIGHT)


def _order_comparison(spark, d, **details) -> Comparison:
    left, right = _orders(spark, d)
    return compare_keyed(
        left, right, ORDERS, left_row_id="pos", right_row_id="pos", **details
    )


def _customer_comparison(spark, d) -> Comparison:
    left, right = _customers(spark, d)
    return compare(
        left, right, CUSTOMERS, expansions=[SEGMENTS], left_row_id="pos", right_row_id="pos"
    )


# --- compare by key ---------------------------------------------------------------------


@query("compare_keyed")
def q_compare_keyed(spark, d):
    left, right = (number_by(side, ["pos"], "n") for side in _orders(spark, d))
    return compare_keyed(left, right, ORDERS, left_row_id="n", right_row_id="n").results()


@query("compare_keyed_join_strategy")
def q_compare_keyed_join(spark, d):
    return _order_comparison(spark, d, strategy="join").results()


@query("compare_keyed_composite")
def q_compare_keyed_composite(spark, d):
    left, right = _lines(spark, d)
    return compare_keyed(left, right, LINES).results().drop(ROW_ID)


@query("compare_keyed_with_rules")
def q_compare_with_rules(spark, d):
    left, right = _orders(spark, d)
    return compare(
        left, right, ORDERS, rules=SIDED_RULES, left_row_id="pos", right_row_id="pos"
    ).results()


@query("diff_columns")
def q_diff_columns(spark, d):
    results = _order_comparison(spark, d).results()
    return results.where(F.col("status") == MISMATCH).select(ROW_ID, "diff_columns")


def _order_views(spark, d):
    left, right = _orders(spark, d)
    return keyed_views(left, right, ORDERS, (), "pos", "pos")


def _as_results(a, b, rows: DataFrame) -> DataFrame:
    pairs = tuple((p.left_col, p.right_col) for p in ORDERS.compare_columns)
    return Comparison(rows, a.keys, a.values, b.values, pairs).results()


@query("paired_rows")
def q_paired_rows(spark, d):
    a, b = _order_views(spark, d)
    pairs = tuple((p.left_col, p.right_col) for p in ORDERS.compare_columns)
    return _as_results(a, b, keyed.paired_rows(a, b, pairs))


@query("missing_right")
def q_missing_right(spark, d):
    a, b = _order_views(spark, d)
    return _as_results(a, b, keyed.missing_right_rows(a, b))


@query("missing_left")
def q_missing_left(spark, d):
    a, b = _order_views(spark, d)
    return _as_results(a, b, keyed.missing_left_rows(a, b))


@query("duplicate_rows")
def q_duplicate_rows(spark, d):
    a, b = _order_views(spark, d)
    return _as_results(a, b, keyed.duplicate_rows(a, b))


@query("ambiguous_keys")
def q_ambiguous_keys(spark, d):
    left, right = _lines(spark, d)
    a, b = keyed_views(left, right, LINES)
    return keyed.ambiguous_keys(a, b)


@query("compare_one_to_many")
def q_one_to_many(spark, d):
    left, right = _customers(spark, d)
    return compare_one_to_many(
        left, right, CUSTOMERS, left_row_id="pos", right_row_id="pos"
    ).results()


# --- compare by row order ----------------------------------------------------------------


@query("compare_row_order")
def q_row_order(spark, d):
    return compare_row_order(
        fx.frame(spark, d, fx.EVENTS_LEFT),
        fx.frame(spark, d, fx.EVENTS_RIGHT),
        EVENTS, (), ["event_id"], ["event_id"],
    ).results()


@query("row_numbers")
def q_row_numbers(spark, d):
    orders = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return number_by(orders, ["o_custkey", "o_orderkey"], "n")


@query("row_numbers_scan_order")
def q_row_numbers_scan(spark, d):
    return number_in_scan_order(fx.table(spark, d, "events").select("event_id"), "n")


# --- group expansion ---------------------------------------------------------------------


@query("ge_compare")
def q_ge_compare(spark, d):
    return _customer_comparison(spark, d).results()


@query("ge_missing_right")
def q_ge_missing_right(spark, d):
    results = _customer_comparison(spark, d).results()
    return results.where(F.col("status") == MISSING_RIGHT)


@query("ge_missing_left")
def q_ge_missing_left(spark, d):
    results = _customer_comparison(spark, d).results()
    return results.where(F.col("status") == MISSING_LEFT)


@query("ge_fallback")
def q_ge_fallback(spark, d):
    left, right = _customers(spark, d)
    comparison = compare(
        left, right, CUSTOMERS, expansions=[SEGMENTS], left_row_id="pos", right_row_id="pos"
    )
    pairs = comparison.results().where("side = 'both' AND right_data LIKE '%\"right_sub\":null}'")
    return pairs.select(ROW_ID, "status", "key_values", "diff_columns")


@query("ge_unmapped_values")
def q_ge_unmapped(spark, d):
    left = fx.frame(spark, d, fx.CUST_LEFT)
    rows = expansion.mapping_frame(spark, SEGMENTS)
    return expansion.unmapped_values(left, CUSTOMERS, SEGMENTS, rows)


# --- expected migration ------------------------------------------------------------------


@query("expected_standard")
def q_expected_standard(spark, d):
    left = number_by(fx.frame(spark, d, fx.ORDERS_LEFT), ["pos"], "n")
    return expected_rows(left, ORDERS, row_id="n").orderBy(ROW_ID)


@query("expected_expansion")
def q_expected_expansion(spark, d):
    left = fx.frame(spark, d, fx.CUST_LEFT)
    return expected_rows(left, CUSTOMERS, (), SEGMENTS, row_id="pos")


@query("expected_export")
def q_expected_export(spark, d):
    left = fx.frame(spark, d, fx.CUST_LEFT)
    expected = expected_rows(left, CUSTOMERS, (), SEGMENTS, row_id="pos")
    path = scratch_path(spark, "expected-export")
    sinks.export_expected(expected, path, sheet_rows=500)
    return load.load_source(spark, SourceSpec("csv", path))


# --- projection and normalising ----------------------------------------------------------


@query("keys_projection")
def q_keys_projection(spark, d):
    view = align(fx.frame(spark, d, fx.LINE_LEFT), LINES, "left")
    return view.frame.select(*map(named, view.keys))


@query("norm_defaults")
def q_norm_defaults(spark, d):
    view = align(fx.frame(spark, d, fx.ORDERS_RIGHT), ORDERS, "right", row_id="pos")
    return view.frame.select(ROW_ID, *map(named, view.values))


@query("norm_text")
def q_norm_text(spark, d):
    documents = fx.table(spark, d, "documents")
    options = CompareOptions(ignore_case=True)
    return documents.select(
        "doc_id", *[normalise(c, options).alias(c) for c in ("text", "lang", "source")]
    )


@query("norm_all_options")
def q_norm_all(spark, d):
    lines = fx.table(spark, d, "lineitem")
    return normalise_columns(lines, [], [(c, c, ()) for c in lines.columns], FULL_OPTIONS)


@query("norm_date")
def q_norm_date(spark, d):
    texts = fx.frame(spark, d, fx.DATE_TEXTS)
    options = CompareOptions(normalize_date=True, date_format="%d.%m.%Y (%b, %j)")
    return texts.select("o_orderkey", normalise("s", options).alias("s"))


@query("norm_number")
def q_norm_number(spark, d):
    texts = fx.frame(spark, d, fx.NUMBER_TEXTS)
    options = CompareOptions(normalize_number=True)
    return texts.select("o_orderkey", normalise("s", options).alias("s"))


TRANSFORM_CASES = {
    "prefix": {"text": "P'"},
    "suffix": {"text": "-s"},
    "lpad": {"length": "12", "pad_char": "*"},
    "rpad": {"length": 6},
    "strip_chars": {"chars": "-. UH"},
    "replace": {"old": "IGH", "new": "i"},
    "substring": {"start": 3, "length": 4},
}


def _transform_query(kind: str, params: dict) -> Query:
    def run(spark, d):
        orders = fx.frame(spark, d, fx.ORDERS_RIGHT)
        rule = TransformRule("priority", "both", kind, params)
        value = normalise("priority", CompareOptions(), [rule])
        return orders.select("pos", value.alias("s"))

    return run


for _kind, _params in TRANSFORM_CASES.items():
    REGISTRY[f"transform_{_kind}"] = _transform_query(_kind, _params)


@query("transform_side_scope")
def q_side_scope(spark, d):
    left, right = _orders(spark, d)
    a = align(left, ORDERS, "left", SIDED_RULES, row_id="pos")
    b = align(right, ORDERS, "right", SIDED_RULES, row_id="pos")
    return a.frame.select(ROW_ID, "left_o_orderstatus", "left_o_orderpriority").join(
        b.frame.select(ROW_ID, "right_status", "right_priority"), ROW_ID
    )


# --- reports -----------------------------------------------------------------------------


@query("summary_counts")
def q_summary_counts(spark, d):
    return report.summary_counts(_order_comparison(spark, d).frame)


@query("summary_pct")
def q_summary_pct(spark, d):
    return CompareResult(_order_comparison(spark, d)).percentages()


@query("summary_report")
def q_summary_report(spark, d):
    return CompareResult(_order_comparison(spark, d)).summary_report()


@query("status_distribution")
def q_status_distribution(spark, d):
    summary = report.summary_counts(_customer_comparison(spark, d).frame)
    shares = report.status_distribution(summary)
    return shares.withColumn("share", F.round("share", 6))


@query("mismatch_breakdown")
def q_mismatch_breakdown(spark, d):
    return CompareResult(_order_comparison(spark, d)).mismatch_breakdown()


@query("mismatch_breakdown_stored")
def q_stored_breakdown(spark, d):
    path = scratch_path(spark, "stored-result")
    return report.stored_breakdown(CompareResult(_order_comparison(spark, d)).stored(path))


@query("duplicate_breakdown")
def q_duplicate_breakdown(spark, d):
    left, right = _lines(spark, d)
    return CompareResult(compare_keyed(left, right, LINES)).duplicate_breakdown()


@query("sample_keys")
def q_sample_keys(spark, d):
    a, b = _order_views(spark, d)
    return report.sample_keys(a, b, _order_comparison(spark, d))


@query("result_page")
def q_result_page(spark, d):
    results = _order_comparison(spark, d).results()
    return report.result_page(results, page=2, size=100, status=MISMATCH)


@query("result_page_deep")
def q_result_page_deep(spark, d):
    results = _order_comparison(spark, d).results()
    return report.result_page(results, page=20, size=200, shallow_rows=1_000)


@query("key_search")
def q_key_search(spark, d):
    results = _order_comparison(spark, d).results()
    return report.filter_results(results, search='"1_7%')


@query("detail_wide")
def q_detail_wide(spark, d):
    return report.detail_wide(_order_comparison(spark, d))


@query("detail_expanded")
def q_detail_expanded(spark, d):
    return report.detail_wide(_customer_comparison(spark, d))


@query("report_rows")
def q_report_rows(spark, d):
    return report.report_rows(_customer_comparison(spark, d).results())


# --- sources and sinks -------------------------------------------------------------------

ODD_HEADERS = ("o order-key", "o custkey ", "1st status", "total.price", "order date", "prio/rity")


def _odd_orders(spark, d) -> DataFrame:
    orders = fx.table(spark, d, "orders")
    as_text = [F.col(c).cast("string") for c in orders.columns]
    return orders.select(*[c.alias(n) for c, n in zip(as_text, ODD_HEADERS)])


@query("scan_csv")
def q_scan_csv(spark, d):
    path = scratch_path(spark, "scan-csv")
    _odd_orders(spark, d).write.option("header", True).option("sep", ";").csv(path)
    separator = load.detect_separator(spark, path)
    return load.load_source(spark, SourceSpec("csv", path, csv_separator=separator))


@query("scan_csv_multiline")
def q_scan_csv_multiline(spark, d):
    path = scratch_path(spark, "scan-csv-multiline")
    documents = fx.table(spark, d, "documents").select("doc_id", "lang", "text")
    writer = documents.write.option("header", True).option("sep", "|").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    source = SourceSpec("csv", path, csv_separator="|", multi_line=True)
    return load.load_source(spark, source)


@query("sanitize_columns")
def q_sanitize(spark, d):
    return load.sanitize_columns(_odd_orders(spark, d))


@query("source_stats")
def q_source_stats(spark, d):
    return load.source_stats({t: fx.table(spark, d, t) for t in fx.TABLES})


@query("preview_n")
def q_preview(spark, d):
    return load.preview(fx.table(spark, d, "orders").orderBy("o_orderkey"), 50)


@query("auto_mapping")
def q_auto_mapping(spark, d):
    left = fx.table(spark, d, "customer").drop("c_acctbal")
    right = fx.frame(spark, d, fx.CUST_RIGHT).drop("pos").withColumnRenamed("cust_name", "c_name")
    pairs = spark.createDataFrame(
        [(p.left_col, p.right_col) for p in auto_map(left, right)], "left_col string, right_col string"
    )
    lefts = load.column_profile(left, "left").withColumnRenamed("name", "left_col")
    rights = load.column_profile(right, "right").withColumnRenamed("name", "right_col")
    return pairs.join(F.broadcast(lefts), "left_col").join(F.broadcast(rights), "right_col")


@query("schema_diff")
def q_schema_diff(spark, d):
    left, right = _orders(spark, d)
    found = load.schema_diff(left, right)
    return found.join(F.broadcast(load.column_profile(left, "left")), "name", "left").join(
        F.broadcast(load.column_profile(right, "right")), "name", "left"
    )


MAPPING_LINES = """
SELECT '  ' || c_mktsegment || ' ' || CAST(c_custkey AS VARCHAR(20)) AS a,
       CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name || ' ' END AS b,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR(20)) END AS c
FROM customer"""


def _mapping_file(spark, d) -> tuple[list[str], DataFrame]:
    path = scratch_path(spark, "mapping")
    lines = fx.frame(spark, d, MAPPING_LINES).toDF("left_value", " seg", "sub ")
    sinks.write_csv(lines, path)
    return mapping.read_mapping(spark, path)


@query("mapping_ingest")
def q_mapping_ingest(spark, d):
    columns, rows = _mapping_file(spark, d)
    return rows.toDF("left_val", *columns)


@query("mapping_totals")
def q_mapping_totals(spark, d):
    columns, rows = _mapping_file(spark, d)
    return mapping.mapping_totals(rows, columns)


@query("result_roundtrip")
def q_roundtrip(spark, d):
    left, right = _lines(spark, d)
    path = scratch_path(spark, "result")
    return CompareResult(compare_keyed(left, right, LINES)).stored(path).drop(ROW_ID)


@query("export_results")
def q_export(spark, d):
    path = scratch_path(spark, "export")
    results = _order_comparison(spark, d).results()
    sinks.export_results(results, path, status=MISMATCH, sheet_rows=1_000)
    return load.load_source(spark, SourceSpec("csv", path))


@query("run_compare")
def q_run_compare(spark, d):
    paths = [scratch_path(spark, "run-left"), scratch_path(spark, "run-right")]
    left, right = _orders(spark, d)
    text = [F.col(c).cast("string").alias(c) for c in left.columns]
    sinks.write_csv(left.select(*text), paths[0])
    right.write.parquet(paths[1])
    spec = CompareSpec.from_dict(
        ORDERS.to_dict()
        | {
            "left_source": {"source_type": "csv", "file_path": paths[0]},
            "right_source": {"source_type": "parquet", "file_path": paths[1]},
        }
    )
    rerun = CompareSpec.from_json(spec.to_json())
    return run_compare(spark, rerun).summary_report()


# --- run history -------------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    return fx.frame(spark, d, fx.RUNS)


@query("run_history")
def q_run_history(spark, d):
    shown = history.run_history(_runs(spark, d), status="completed", search="USER 1")
    return shown.drop("created_at", "updated_at")


@query("run_kpis")
def q_run_kpis(spark, d):
    return history.run_kpis(_runs(spark, d))
