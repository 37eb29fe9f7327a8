"""Checked queries for paths the first set doesn't walk: sorted sources, hot keys, CSV corners."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinledger.functions.normalise import normalise
from twinledger.operators import report
from twinledger.operators.align import ROW_ID
from twinledger.operators.keyed import compare_keyed
from twinledger.operators.rownum import number_in_scan_order
from twinledger.operators.roworder import compare_row_order
from twinledger.operators.search import search_indexed, write_key_index
from twinledger.plans import history
from twinledger.plans.run import compare, run_compare
from twinledger.plans.spec import CompareOptions, CompareSpec, SourceSpec, TransformRule
from twinledger.session import materialise, scratch_path
from twinledger.sources import load
from twinledger.sources.jdbc import equi_depth_predicates
from twinledger.sources.store import ResultStore
from workload import fixtures as fx
from workload import oracles as o
from workload.queries import CUSTOMERS, EVENTS, LINES, ORDERS, SEGMENTS, query

ORACLES: dict[str, str] = {}


# --- row numbers and row order --------------------------------------------------------------


@query("row_order_sorted_source")
def q_row_order_sorted(spark, d):
    """Both sides the same SQL source with an order; each row meets itself."""
    sql = f"SELECT o_orderkey, o_totalprice FROM parquet.`{d}/orders.parquet` ORDER BY o_totalprice DESC, o_orderkey"
    source = {"source_type": "sql", "custom_query": sql}
    spec = CompareSpec.from_dict(
        CompareSpec.of(compare=[("o_orderkey", "o_orderkey"), ("o_totalprice", "o_totalprice")], use_row_order=True).to_dict()
        | {"left_source": source, "right_source": source}
    )
    return run_compare(spark, spec).summary_report().select("status", "row_count")


ORACLES["row_order_sorted_source"] = """
SELECT status, CASE WHEN status = 'match' THEN (SELECT count(*) FROM orders) ELSE 0 END AS row_count
FROM (SELECT unnest(['match', 'mismatch', 'missing_left', 'missing_right', 'duplicate_key']) AS status)"""


@query("row_numbers_csv_splits")
def q_row_numbers_csv(spark, d):
    """Rows of many CSV files, each numbered once: the count, the ends and the distinct numbers."""
    path = scratch_path(spark, "csv-splits")
    fx.table(spark, d, "orders").select("o_orderkey").repartition(7).write.csv(path)
    numbered = number_in_scan_order(spark.read.schema("o_orderkey long").csv(path), "n")
    return numbered.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("first"), F.max("n").alias("last"),
        F.count_distinct("n").alias("n_numbers"), F.count_distinct("o_orderkey").alias("n_keys"),
    )


ORACLES["row_numbers_csv_splits"] = """
SELECT count(*) AS n_rows, 1::BIGINT AS first, count(*) AS last, count(*) AS n_numbers,
       count(DISTINCT o_orderkey) AS n_keys FROM orders"""


@query("compare_row_order_left_longer")
def q_row_order_left_longer(spark, d):
    swapped = CompareSpec.of(compare=[(b.right_col, b.left_col) for b in EVENTS.compare_columns], use_row_order=True)
    return compare_row_order(
        fx.frame(spark, d, fx.EVENTS_RIGHT), fx.frame(spark, d, fx.EVENTS_LEFT), swapped, (), ["event_id"], ["event_id"],
    ).results()


ORACLES["compare_row_order_left_longer"] = f"""
WITH x AS ({o.event_side(fx.EVENTS_RIGHT)}), y AS ({o.event_side(fx.EVENTS_LEFT)})
SELECT x.n AS row_id,
       CASE WHEN y.n IS NULL THEN 'missing_right' WHEN {o.differ(o._EVENT_DIFF)} THEN 'mismatch' ELSE 'match' END AS status,
       {o.json([("row", "CAST(x.n AS VARCHAR)")])} AS key_values,
       {o.json([("left_user_id", "x.a"), ("left_event_type", "x.b")])} AS left_data,
       CASE WHEN y.n IS NULL THEN '{{}}'
            ELSE {o.json([("right_user_id", "y.a"), ("right_event_type", "y.b")])} END AS right_data,
       CASE WHEN y.n IS NULL THEN '[]' ELSE {o.names_json(o._EVENT_DIFF)} END AS diff_columns,
       CASE WHEN y.n IS NULL THEN 'left' ELSE 'both' END AS side
FROM x LEFT JOIN y ON x.n = y.n"""


# --- hot keys -------------------------------------------------------------------------------

HOT_LEFT = """
SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_partkey % 3 > 0 THEN 7 ELSE l_orderkey END AS k, l_returnflag AS f
FROM lineitem"""
HOT_RIGHT = """
SELECT o_orderkey AS pos, o_orderkey AS k, o_orderstatus AS f FROM orders"""
HOT = CompareSpec.of(keys=[("k", "k")], compare=[("f", "f")])


def _hot(spark, d, min_bytes):
    left, right = fx.frame(spark, d, HOT_LEFT), fx.frame(spark, d, HOT_RIGHT)
    compared = compare_keyed(left, right, HOT, left_row_id="pos", right_row_id="pos", min_bytes=min_bytes)
    return compared.results().drop(ROW_ID)


@query("compare_keyed_hot_key")
def q_hot(spark, d):
    return _hot(spark, d, None)


@query("compare_keyed_hot_key_salted")
def q_hot_salted(spark, d):
    return _hot(spark, d, 0)


ORACLES["compare_keyed_hot_key"] = ORACLES["compare_keyed_hot_key_salted"] = (
    "WITH " + o.keyed(HOT_LEFT, HOT_RIGHT, [("k", "k")], [("f", "f")]) + " SELECT * EXCLUDE (row_id) FROM res"
)


# --- delimited text -------------------------------------------------------------------------


def _quoted_lines(spark, d) -> str:
    path = scratch_path(spark, "quoted")
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"),
        F.concat(F.lit("a "), "o_orderpriority", F.lit("\nb \"q\", "), F.col("o_custkey").cast("string")).alias("v"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


@query("scan_csv_quoted_breaks")
def q_quoted_breaks(spark, d):
    """Line breaks inside quotes, with the settings a source has by default."""
    return load.load_source(spark, SourceSpec("csv", _quoted_lines(spark, d)))


ORACLES["scan_csv_quoted_breaks"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS k,
       'a ' || o_orderpriority || chr(10) || 'b "q", ' || CAST(o_custkey AS VARCHAR) AS v FROM orders"""


@query("scan_csv_no_header")
def q_no_header(spark, d):
    path = scratch_path(spark, "no-header")
    fx.table(spark, d, "nation").select("n_nationkey", "n_name").write.csv(path)
    return load.load_source(spark, SourceSpec("csv", path, has_header=False))


ORACLES["scan_csv_no_header"] = "SELECT CAST(n_nationkey AS VARCHAR) AS col_0, n_name AS col_1 FROM nation"


def _one_split_at(spark, nbytes: int):
    """The session with another split size until the scan is planned."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(nbytes))
    return lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@query("scan_csv_quoted_splits")
def q_quoted_splits(spark, d):
    """Few files of quoted line breaks, separators and quotes, each read in many tasks; numbered rows."""
    path = scratch_path(spark, "quoted-splits")
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("k"),
        F.concat(F.lit("a "), "o_orderpriority", F.lit("\nb \"q\", "), F.col("o_custkey").cast("string"), F.lit("\n,\"\n")).alias("v"),
    )
    rows.repartitionByRange(2, F.col("k").cast("long")).sortWithinPartitions(F.col("k").cast("long")).write.option(
        "header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    restore = _one_split_at(spark, 1 << 18)
    try:
        numbered = load.load_numbered(spark, SourceSpec("csv", path), "n")
    finally:
        restore()
    return numbered.select("n", "k", "v")


ORACLES["scan_csv_quoted_splits"] = """
SELECT row_number() OVER (ORDER BY o_orderkey) AS n, CAST(o_orderkey AS VARCHAR) AS k,
       'a ' || o_orderpriority || chr(10) || 'b "q", ' || CAST(o_custkey AS VARCHAR) || chr(10) || ',"' || chr(10) AS v
FROM orders"""


@query("scan_csv_skip_rows")
def q_skip_rows(spark, d):
    """Three lines above the header of each file, in every file other ones: blank, quoted, with separators."""
    path = scratch_path(spark, "skip-rows")
    files = 6
    body = fx.table(spark, d, "orders").select(
        F.concat_ws(";", "o_orderkey", "o_orderpriority").alias("value"),
        F.pmod("o_orderkey", F.lit(files)).alias("file"), F.lit(4).alias("place"),
    )
    titles = F.array(
        F.when(F.col("id") % 2 == 0, "").otherwise('Report "of; day'), F.when(F.col("id") % 3 == 0, " ").otherwise("1;a"),
        F.when(F.col("id") % 4 == 0, '"').otherwise(""), F.lit("key;priority"),
    )
    top = spark.range(files).select(F.posexplode(titles).alias("place", "value"), F.col("id").alias("file"))
    lines = body.unionByName(top).repartition(files, "file").sortWithinPartitions("file", "place")
    lines.select("value", "file").write.partitionBy("file").text(path)
    folder = SourceSpec("csv", f"{path}/*", csv_separator=";", skip_rows=3)
    return load.load_source(spark, folder)


ORACLES["scan_csv_skip_rows"] = (
    "SELECT CAST(o_orderkey AS VARCHAR) AS \"key\", o_orderpriority AS priority FROM orders"
)


@query("separator_vote")
def q_separator_vote(spark, d):
    """Pages under misleading first lines: all lines vote, not the first ones; then the rows themselves."""
    path = scratch_path(spark, "separator-vote")
    pages = fx.table(spark, d, "documents").select(
        F.concat_ws("|", "doc_id", "lang", "source", F.concat(F.lit('"a;b;c,'), "source", F.lit('"'))).alias("value"), F.lit(1).alias("place")
    )
    top = spark.range(60).select(F.lit("one;two;three;four;five|title|x|y").alias("value"), F.lit(0).alias("place"))
    top.union(pages).repartitionByRange(3, "place").sortWithinPartitions("place").select("value").write.text(path)
    separator = load.detect_separator(spark, path)
    spec = SourceSpec("csv", path, csv_separator=separator, has_header=False)
    return load.load_source(spark, spec).where("col_1 <> 'title'").select("col_0", "col_2", "col_3", F.lit(separator).alias("separator"))


ORACLES["separator_vote"] = """
SELECT CAST(doc_id AS VARCHAR) AS col_0, source AS col_2, 'a;b;c,' || source AS col_3, '|' AS separator FROM documents"""


@query("scan_csv_null_tokens")
def q_null_tokens(spark, d):
    """The texts that stand for nothing, as the named default choice of a stored spec."""
    path = scratch_path(spark, "null-tokens")
    fx.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "NULL").when(F.col("o_orderkey") % 3 == 1, "N/A").otherwise(F.col("o_orderpriority")).alias("v")
    ).write.option("header", True).csv(path)
    source = SourceSpec.from_dict({"source_type": "csv", "file_path": path, "null_tokens": "default"})
    return load.load_source(spark, source)


ORACLES["scan_csv_null_tokens"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS v FROM orders"""


@query("empty_source")
def q_empty_source(spark, d):
    """A file with nothing but its header against a full side: all rows are missing on one side."""
    path = scratch_path(spark, "header-only")
    region = fx.table(spark, d, "region").select("r_regionkey", "r_name")
    region.limit(0).coalesce(1).write.option("header", True).csv(path)
    header = load.load_source(spark, SourceSpec("csv", path))
    spec = CompareSpec.of(keys=[("r_regionkey", "r_regionkey")], compare=[("r_name", "r_name")])
    return compare_keyed(region, header, spec).results().drop(ROW_ID)


ORACLES["empty_source"] = f"""
SELECT 'missing_right' AS status, {o.json([("r_regionkey", "CAST(r_regionkey AS VARCHAR)")])} AS key_values,
       {o.json([("left_r_name", "r_name")])} AS left_data, '{{}}' AS right_data, '[]' AS diff_columns, 'left' AS side
FROM region"""


# --- rules, pages and history ----------------------------------------------------------------


@query("transform_unknown")
def q_transform_unknown(spark, d):
    rule = TransformRule("n_name", "both", "rot13", {"by": 1})
    return fx.table(spark, d, "nation").select("n_nationkey", normalise("n_name", CompareOptions(), [rule]).alias("v"))


ORACLES["transform_unknown"] = f"SELECT n_nationkey, {o.value('n_name')} AS v FROM nation"


@query("result_pages_whole")
def q_pages(spark, d):
    """All pages of a stored result put together again: every row once, ties included."""
    path = scratch_path(spark, "paged")
    left, right = fx.frame(spark, d, HOT_LEFT), fx.frame(spark, d, HOT_RIGHT)
    results = compare_keyed(left.where("k <> 7"), right, HOT, left_row_id="k", right_row_id="k").results()
    results.write.parquet(path)
    stored = spark.read.parquet(path)
    total = stored.count()
    size = -(-total // 3)
    pages = [report.result_page(stored, p, size, shallow_rows=1_000) for p in range(1, report.page_info(total, 1, size)["pages"] + 1)]
    out = pages[0]
    for page in pages[1:]:
        out = out.union(page)
    return out.groupBy("row_id", "status").count()


ORACLES["result_pages_whole"] = (
    "WITH " + o.keyed(f"SELECT * FROM ({HOT_LEFT}) q WHERE k <> 7", HOT_RIGHT, [("k", "k")], [("f", "f")], row_id="k")
    + " SELECT row_id, status, count(*) AS \"count\" FROM res GROUP BY ALL"
)

OLD_RUNS = """
SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)) AS id, 'Run over order ' || CAST(o_orderkey AS VARCHAR(20)) AS name,
       'file_vs_file' AS job_type, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
       CAST(NULL AS VARCHAR(10)) AS result_summary,
       CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM orders"""


@query("run_history_old")
def q_run_history_old(spark, d):
    """Filters see every run, however many are newer."""
    shown = history.run_history(fx.frame(spark, d, OLD_RUNS), status="failed", search="order 1")
    return shown.select("id", "name", "status")


ORACLES["run_history_old"] = f"""
SELECT id, name, status FROM ({OLD_RUNS}) r
WHERE status = 'failed' AND (contains(lower(name), 'order 1') OR contains(lower(id), 'order 1'))"""


@query("page_figures")
def q_page_figures(spark, d):
    """The arithmetic of every page size over the orders."""
    total = fx.table(spark, d, "orders").count()
    rows = [(size, *[report.page_info(total, page, size)[k] for k in ("pages", "first_row", "last_row")])
            for size in (50, 100, 200, 500) for page in (2,)]
    return spark.createDataFrame(rows, "size long, pages long, first_row long, last_row long")


ORACLES["page_figures"] = """
SELECT size, CAST(greatest(1, ceil(n / size)) AS BIGINT) AS pages, size + 1 AS first_row, least(2 * size, n) AS last_row
FROM (SELECT unnest([50, 100, 200, 500])::BIGINT AS size, (SELECT count(*) FROM orders) AS n)"""


@query("thousands_text")
def q_thousands(spark, d):
    customers = fx.table(spark, d, "customer")
    return customers.select("c_custkey", report.thousands_text(F.col("c_custkey") * 12345 - 1_000_000).alias("n"))


ORACLES["thousands_text"] = "SELECT c_custkey, format('{:,}', c_custkey * 12345 - 1000000) AS n FROM customer"


# --- the versioned store -----------------------------------------------------------------------


def _order_results(spark, d):
    left, right = fx.frame(spark, d, fx.ORDERS_LEFT), fx.frame(spark, d, fx.ORDERS_RIGHT)
    return compare_keyed(left, right, ORDERS, left_row_id="pos", right_row_id="pos").results()


def _line_results(spark, d):
    left, right = fx.frame(spark, d, fx.LINE_LEFT), fx.frame(spark, d, fx.LINE_RIGHT)
    return compare_keyed(left, right, LINES).results()


@query("result_store_appended")
def q_store_appended(spark, d):
    """Two results appended one after the other: the counts of each version, and all rows of the last."""
    store = ResultStore(spark, scratch_path(spark, "store"), rows_per_file=5_000)
    first = store.append(_order_results(spark, d))
    second = store.append(_line_results(spark, d))
    counts = [store.counts(v).select(F.lit(f"version {i + 1}").alias("what"), "status", "n_rows") for i, v in enumerate((first, second))]
    rows = store.read().groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts[0].union(counts[1]).union(rows.select(F.lit("rows").alias("what"), "status", "n_rows"))


_STATUS_LIST = "(SELECT unnest(['match', 'mismatch', 'missing_left', 'missing_right', 'duplicate_key']) AS status) s"
ORACLES["result_store_appended"] = f"""
WITH a AS (WITH {o.ORDER_CTES} SELECT status, count(*) AS n FROM res GROUP BY status),
b AS (SELECT status, count(*) AS n FROM ({o.ORACLES["compare_keyed_composite"]}) q GROUP BY status),
c AS (SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) q GROUP BY status)
SELECT 'version 1' AS what, s.status, coalesce(n, 0) AS n_rows FROM {_STATUS_LIST} LEFT JOIN a USING (status)
UNION ALL SELECT 'version 2', s.status, coalesce(n, 0) FROM {_STATUS_LIST} LEFT JOIN c USING (status)
UNION ALL SELECT 'rows', status, n FROM c"""


@query("result_store_cleared")
def q_store_cleared(spark, d):
    """A store that is cleared and written again: the empty version has its columns, older ones their rows."""
    store = ResultStore(spark, scratch_path(spark, "store"))
    full = store.append(_order_results(spark, d))
    empty = store.clear()
    store.append(_order_results(spark, d).where("status = 'mismatch'"))
    now, then = store.read(), store.read(full)
    return now.unionByName(store.read(empty)).join(then.select("row_id", "status"), ["row_id", "status"])


ORACLES["result_store_cleared"] = f"WITH {o.ORDER_CTES} SELECT * FROM res WHERE status = 'mismatch'"


@query("result_page_stored")
def q_page_stored(spark, d):
    """A deep page through the directory of a store: at most two files are opened, nothing is counted."""
    store = ResultStore(spark, scratch_path(spark, "store"), rows_per_file=500)
    store.append(_order_results(spark, d))
    page = store.page(page=20, size=200)
    if len(page.inputFiles()) > 2:
        raise AssertionError(f"{len(page.inputFiles())} files opened for one page")
    return page.drop("side")


ORACLES["result_page_stored"] = o.ORACLES["result_page_deep"]


@query("result_page_appended")
def q_page_appended(spark, d):
    """Pages of one status over two appended parts whose row numbers overlap, put together again."""
    store = ResultStore(spark, scratch_path(spark, "store"), rows_per_file=700)
    results = materialise(_order_results(spark, d), "results")
    store.append(results.where("row_id % 3 = 0"))
    store.append(results.where("row_id % 3 <> 0"))
    total = store.counts().where("status = 'mismatch'").first()["n_rows"]
    size = -(-total // 3)
    pages = [store.page(p, size, status="mismatch").select(F.lit(p).alias("page"), "row_id", "key_values") for p in (1, 2, 3)]
    return pages[0].union(pages[1]).union(pages[2])


ORACLES["result_page_appended"] = f"""
WITH {o.ORDER_CTES}, kept AS (SELECT * FROM res WHERE status = 'mismatch'),
n AS (SELECT row_id, key_values, row_number() OVER (ORDER BY row_id, status, key_values, left_data NULLS FIRST, right_data NULLS FIRST) AS nth,
             count(*) OVER () AS total FROM kept)
SELECT CAST((nth - 1) // ((total + 2) // 3) + 1 AS INTEGER) AS page, row_id, key_values FROM n"""


# --- several fallback pairs of one row -----------------------------------------------------------

CUST_RIGHT_MANY = fx.CUST_RIGHT + """
UNION ALL
SELECT -1 - c_custkey * 2, c_custkey, c_name, 'OTHER', 'Z1' FROM customer
UNION ALL
SELECT -2 - c_custkey * 2, c_custkey, lower(c_name), 'OTHER', NULL FROM customer"""


@query("ge_fallback_many")
def q_ge_fallback_many(spark, d):
    """Unmapped rows that meet several rows no mapping names: every pair is reported."""
    return compare(
        fx.frame(spark, d, fx.CUST_LEFT), fx.frame(spark, d, CUST_RIGHT_MANY), CUSTOMERS,
        expansions=[SEGMENTS], left_row_id="pos", right_row_id="pos",
    ).results()


ORACLES["ge_fallback_many"] = o.ORACLES["ge_compare"].replace(fx.CUST_RIGHT, CUST_RIGHT_MANY)


# --- key search by index, partition predicates, a compacted ledger -------------------------------


@query("key_search_indexed")
def q_key_search_indexed(spark, d):
    """Three searches through one trigram index, each with the rows a scan finds."""
    results = materialise(_order_results(spark, d).select("row_id", "status", "key_values"), "results")
    index = write_key_index(results, scratch_path(spark, "key-index"))
    found = [search_indexed(results, index, text).withColumn("search", F.lit(text)) for text in INDEX_SEARCHES]
    return found[0].union(found[1]).union(found[2]).select("search", "row_id", "status", "key_values")


INDEX_SEARCHES = ('"1_7%', "2_345", "%77")
ORACLES["key_search_indexed"] = f"WITH {o.ORDER_CTES} " + " UNION ALL ".join(
    f"SELECT '{text}' AS search, row_id, status, key_values FROM res WHERE key_values LIKE '%{text}%'"
    for text in INDEX_SEARCHES
)

DATED_ORDERS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 10 < 3 THEN DATE '1995-06-17'
                        ELSE CAST(o_orderdate AS DATE) END AS placed,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price
FROM orders"""


@query("jdbc_partition_cover")
def q_jdbc_partition_cover(spark, d):
    """Planned read partitions over dates with a hot day and NULLs, and over prices: each row in one."""
    rows = fx.frame(spark, d, DATED_ORDERS)
    sums = []
    for column in ("placed", "price"):
        predicates = equi_depth_predicates(rows, column, 8, "`")
        times = sum(F.coalesce(F.expr(p).cast("int"), F.lit(0)) for p in predicates)
        sums.append(rows.groupBy(F.lit(column).alias("column_name"), times.alias("times")).agg(F.count(F.lit(1)).alias("n_rows")))
    return sums[0].union(sums[1])


ORACLES["jdbc_partition_cover"] = """
SELECT column_name, 1 AS times, (SELECT count(*) FROM orders) AS n_rows
FROM (SELECT unnest(['placed', 'price']) AS column_name)"""


@query("run_history_compacted")
def q_run_history_compacted(spark, d):
    """A ledger of two states per run in many files, merged: the newest states, in at most two files per 100,000 runs."""
    path = scratch_path(spark, "ledger")
    shown = ["id", "name", "job_type", "status", "config", "result_summary", "error_message", "created_at", "updated_at"]
    runs = fx.frame(spark, d, fx.RUNS).withColumns({"config": F.lit("{}"), "error_message": F.lit(None).cast("string")})
    runs = runs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})
    started = runs.withColumns({
        "status": F.lit("processing"), "result_summary": F.lit(None).cast("string"), "updated_at": F.col("created_at") - F.expr("INTERVAL 1 SECOND"),
    })
    for part in (started, runs):
        part.select(*shown).repartition(6, "id").write.mode("append").parquet(path)
    history.compact_runs(spark, path)
    files = spark.read.parquet(path).inputFiles()
    if len(files) > history.compacted_files(spark.read.parquet(path).count()):
        raise AssertionError(f"{len(files)} files after compaction")
    return history.run_history(history.read_runs(spark, path), status="completed", search="USER 1").drop("created_at", "updated_at")


ORACLES["run_history_compacted"] = o.ORACLES["run_history"]


# --- doubles of any magnitude ---------------------------------------------------------------------

WIDE_PRICES = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1e-9 WHEN 1 THEN 1e14 WHEN 2 THEN 1e30 WHEN 3 THEN 1e-20
                   ELSE -1e44 END * o_totalprice AS price
FROM orders"""


@query("norm_wide_numbers")
def q_norm_wide_numbers(spark, d):
    """Prices times powers of ten: the shortest text that reads back, and two exact places."""
    prices = fx.frame(spark, d, WIDE_PRICES)
    column = prices.schema["price"].dataType
    shortest, rounded = CompareOptions(), CompareOptions(normalize_number=True)
    return prices.select(
        "o_orderkey", normalise("price", shortest, data_type=column).alias("shortest"),
        normalise("price", rounded, data_type=column).alias("rounded")
    )


ORACLES["norm_wide_numbers"] = f"""
SELECT o_orderkey, CAST(price AS VARCHAR) AS shortest, printf('%.2f', price) AS rounded FROM ({WIDE_PRICES}) t"""
