"""Plain SQL giving the expected rows of every query, for DuckDB over the same tables."""

from __future__ import annotations

from workload import fixtures as fx
from workload.queries import MAPPING_LINES, TRANSFORM_CASES

ORACLES: dict[str, str] = {}

ORDER_KEYS = [("o_orderkey", "order_id")]
ORDER_PAIRS = [
    ("o_orderstatus", "status"), ("o_totalprice", "total_price"), ("o_orderpriority", "priority"),
]
LINE_KEYS = [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]
LINE_PAIRS = [("l_returnflag", "l_returnflag"), ("l_quantity", "l_quantity")]
CUSTOMER_PAIRS = [("c_name", "cust_name"), ("c_mktsegment", "seg")]
LABELS = (
    ("match", "Cocok"), ("mismatch", "Tidak Cocok"), ("missing_left", "Tdk Ada di Kiri"),
    ("missing_right", "Tdk Ada di Kanan"), ("duplicate_key", "Key Duplikat"),
)
LABEL_CASE = "CASE status " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in LABELS) + " END"


def value(column: str) -> str:
    return f"NULLIF(TRIM(CAST({column} AS VARCHAR)), '')"


def key(column: str) -> str:
    return f"TRIM(CAST({column} AS VARCHAR))"


def json(fields: list[tuple[str, str]]) -> str:
    inner = ", ".join(f"'{name}', {expr}" for name, expr in fields)
    return f"CAST(json_object({inner}) AS VARCHAR)"


def names_json(pairs: list[tuple[str, str]]) -> str:
    """JSON list of the left names whose two values differ."""
    items = ", ".join(
        f"CASE WHEN {a} IS DISTINCT FROM {b} THEN '{name}' END" for name, a, b in pairs
    )
    return f"CAST(to_json([x FOR x IN [{items}] IF x IS NOT NULL]) AS VARCHAR)"


def differ(pairs: list[tuple[str, str, str]]) -> str:
    return " OR ".join(f"{a} IS DISTINCT FROM {b}" for _, a, b in pairs)


def sides(left: str, right: str, keys, pairs, left_values=None, right_values=None,
          row_id="pos") -> str:
    """CTEs nl and nr: row_id, k0…, and one cleaned value per compared column."""
    lv = left_values or [value(a) for a, _ in pairs]
    rv = right_values or [value(b) for _, b in pairs]
    lcols = [f"{key(a)} AS k{i}" for i, (a, _) in enumerate(keys)]
    lcols += [f"{v} AS l{i}" for i, v in enumerate(lv)]
    rcols = [f"{key(b)} AS k{i}" for i, (_, b) in enumerate(keys)]
    rcols += [f"{v} AS r{i}" for i, v in enumerate(rv)]
    return (
        f"nl AS (SELECT {row_id} AS row_id, {', '.join(lcols)} FROM ({left}) s), "
        f"nr AS (SELECT {row_id} AS row_id, {', '.join(rcols)} FROM ({right}) s)"
    )


def keyed(left: str, right: str, keys, pairs, **options) -> str:
    """CTEs ending in ``res``, the keyed result table."""
    n = len(keys)
    ks = ", ".join(f"k{i}" for i in range(n))
    usable = " AND ".join(f"k{i} IS NOT NULL" for i in range(n))

    def same(a, b):
        return " AND ".join(f"{a}.k{i} = {b}.k{i}" for i in range(n))

    key_fields = [(a, f"x.k{i}") for i, (a, _) in enumerate(keys)]
    ljson = json([(f"left_{a}", f"x.l{i}") for i, (a, _) in enumerate(pairs)])
    rjson = json([(f"right_{b}", f"y.r{i}") for i, (_, b) in enumerate(pairs)])
    own = json([(f"right_{b}", f"x.r{i}") for i, (_, b) in enumerate(pairs)])
    triples = [(a, f"x.l{i}", f"y.r{i}") for i, (a, _) in enumerate(pairs)]
    return f"""
{sides(left, right, keys, pairs, **options)},
cl AS (SELECT {ks}, COUNT(*) AS n FROM nl WHERE {usable} GROUP BY {ks}),
cr AS (SELECT {ks}, COUNT(*) AS n FROM nr WHERE {usable} GROUP BY {ks}),
res AS (
  SELECT x.row_id,
         CASE WHEN cl.n > 1 OR cr.n > 1 THEN 'duplicate_key'
              WHEN y.k0 IS NULL THEN 'missing_right'
              WHEN {differ(triples)} THEN 'mismatch' ELSE 'match' END AS status,
         {json(key_fields)} AS key_values, {ljson} AS left_data,
         CASE WHEN y.k0 IS NULL THEN '{{}}' ELSE {rjson} END AS right_data,
         CASE WHEN y.k0 IS NULL THEN '[]' ELSE {names_json(triples)} END AS diff_columns,
         CASE WHEN y.k0 IS NULL THEN 'left' ELSE 'both' END AS side
  FROM nl x LEFT JOIN cl ON {same('x', 'cl')} LEFT JOIN cr ON {same('x', 'cr')}
  LEFT JOIN nr y ON {same('x', 'y')} AND cl.n = 1 AND cr.n = 1
  UNION ALL
  SELECT x.row_id, CASE WHEN cl.n > 1 OR cr.n > 1 THEN 'duplicate_key' ELSE 'missing_left' END,
         {json(key_fields)}, '{{}}', {own}, '[]', 'right'
  FROM nr x LEFT JOIN cl ON {same('x', 'cl')} LEFT JOIN cr ON {same('x', 'cr')}
  WHERE cl.n IS NULL OR cl.n > 1 OR cr.n > 1)"""


RESULT = "row_id, status, key_values, left_data, right_data, diff_columns"
ORDER_CTES = keyed(fx.ORDERS_LEFT, fx.ORDERS_RIGHT, ORDER_KEYS, ORDER_PAIRS)
LINE_CTES = keyed(fx.LINE_LEFT, fx.LINE_RIGHT, LINE_KEYS, LINE_PAIRS, row_id="0")


def numbered(sql: str) -> str:
    return f"SELECT *, ROW_NUMBER() OVER (ORDER BY pos) AS n FROM ({sql}) q"


ORACLES["compare_keyed"] = "WITH " + keyed(
    numbered(fx.ORDERS_LEFT), numbered(fx.ORDERS_RIGHT), ORDER_KEYS, ORDER_PAIRS, row_id="n"
) + " SELECT * FROM res"
ORACLES["compare_keyed_join_strategy"] = f"WITH {ORDER_CTES} SELECT * FROM res"
ORACLES["compare_keyed_composite"] = f"WITH {LINE_CTES} SELECT * EXCLUDE (row_id) FROM res"
ORACLES["result_roundtrip"] = ORACLES["compare_keyed_composite"]


def clean(expr: str) -> str:
    return f"NULLIF({expr}, '')"


RULED_LEFT = [
    clean("CONCAT('S-', TRIM(CAST(o_orderstatus AS VARCHAR)))"),
    value("o_totalprice"),
    clean("REPLACE(TRIM(CAST(o_orderpriority AS VARCHAR)), 'URGENT', 'TOP')"),
]
RULED_RIGHT = [
    clean("CONCAT('S-', TRIM(CAST(status AS VARCHAR)))"), value("total_price"), value("priority"),
]
ORACLES["compare_keyed_with_rules"] = "WITH " + keyed(
    fx.ORDERS_LEFT, fx.ORDERS_RIGHT, ORDER_KEYS, ORDER_PAIRS,
    left_values=RULED_LEFT, right_values=RULED_RIGHT,
) + " SELECT * FROM res"
ORACLES["transform_side_scope"] = f"""
WITH {sides(fx.ORDERS_LEFT, fx.ORDERS_RIGHT, ORDER_KEYS, ORDER_PAIRS, RULED_LEFT, RULED_RIGHT)}
SELECT nl.row_id, l0 AS left_o_orderstatus, l2 AS left_o_orderpriority,
       r0 AS right_status, r2 AS right_priority
FROM nl JOIN nr ON nl.row_id = nr.row_id"""
ORACLES["diff_columns"] = (
    f"WITH {ORDER_CTES} SELECT row_id, diff_columns FROM res WHERE status = 'mismatch'"
)
for _name, _where in {
    "paired_rows": "status IN ('match', 'mismatch')",
    "missing_right": "status = 'missing_right'",
    "missing_left": "status = 'missing_left'",
    "duplicate_rows": "status = 'duplicate_key'",
    "key_search": "key_values LIKE '%\"1_7%%'",
}.items():
    ORACLES[_name] = f"WITH {ORDER_CTES} SELECT * FROM res WHERE {_where}"
ORACLES["ambiguous_keys"] = f"""
SELECT {key('l_orderkey')} AS key_l_orderkey, {key('l_linenumber')} AS key_l_linenumber
FROM ({fx.LINE_LEFT}) a GROUP BY 1, 2 HAVING COUNT(*) > 1
UNION
SELECT {key('l_orderkey')}, {key('l_linenumber')}
FROM ({fx.LINE_RIGHT}) b GROUP BY 1, 2 HAVING COUNT(*) > 1"""

# --- customers: one to many and group expansion -------------------------------------------

CUSTOMER_SIDES = sides(
    fx.CUST_LEFT, fx.CUST_RIGHT, [("c_custkey", "cust_id")], CUSTOMER_PAIRS,
    right_values=[value("cust_name"), value("seg"), value("sub")],
)
CUST_KEY = json([("c_custkey", "x.k0")])
CUST_LEFT_JSON = json([("left_c_name", "x.l0"), ("left_c_mktsegment", "x.l1")])


def right_json(alias: str, with_sub: bool) -> str:
    fields = [("right_cust_name", f"{alias}.r0"), ("right_seg", f"{alias}.r1")]
    return json(fields + ([("right_sub", f"{alias}.r2")] if with_sub else []))


_CUST_DIFF = [("c_name", "x.l0", "y.r0"), ("c_mktsegment", "x.l1", "y.r1")]
ORACLES["compare_one_to_many"] = f"""
WITH {CUSTOMER_SIDES},
cl AS (SELECT k0, COUNT(*) AS n FROM nl WHERE k0 IS NOT NULL GROUP BY k0)
SELECT y.row_id,
       CASE WHEN cl.n IS NULL THEN 'missing_left' WHEN cl.n > 1 THEN 'duplicate_key'
            WHEN {differ(_CUST_DIFF)} THEN 'mismatch' ELSE 'match' END AS status,
       {json([("c_custkey", "y.k0")])} AS key_values,
       CASE WHEN x.k0 IS NULL THEN '{{}}' ELSE {CUST_LEFT_JSON} END AS left_data,
       {right_json('y', False)} AS right_data,
       CASE WHEN x.k0 IS NULL THEN '[]' ELSE {names_json(_CUST_DIFF)} END AS diff_columns,
       CASE WHEN x.k0 IS NULL THEN 'right' ELSE 'both' END AS side
FROM nr y LEFT JOIN cl ON cl.k0 = y.k0 LEFT JOIN nl x ON x.k0 = y.k0 AND cl.n = 1
UNION ALL
SELECT x.row_id, CASE WHEN cl.n > 1 THEN 'duplicate_key' ELSE 'missing_right' END,
       {CUST_KEY}, {CUST_LEFT_JSON}, '{{}}', '[]', 'left'
FROM nl x LEFT JOIN cl ON cl.k0 = x.k0
WHERE cl.n > 1 OR NOT EXISTS (SELECT 1 FROM nr WHERE nr.k0 = x.k0)"""

_NAME_DIFF = [("c_name", "x.l0", "y.r0")]
EXPANSION_CTES = f"""
{CUSTOMER_SIDES},
m AS ({fx.SEGMENT_MAP}),
lm AS (SELECT x.*, EXISTS (SELECT 1 FROM m WHERE m.left_val = x.l1) AS mapped FROM nl x),
rm AS (SELECT y.*, EXISTS (SELECT 1 FROM m WHERE m.rc_0 = y.r1 AND m.rc_1 = y.r2) AS known
       FROM nr y),
hits AS (SELECT x.row_id AS li, y.row_id AS ri FROM nl x JOIN m ON m.left_val = x.l1
         JOIN nr y ON y.k0 = x.k0 AND y.r1 = m.rc_0 AND y.r2 = m.rc_1),
firsts AS (SELECT li, MIN(ri) AS ri FROM hits GROUP BY li),
free AS (SELECT x.row_id AS li, y.row_id AS ri FROM lm x JOIN rm y ON y.k0 = x.k0
         WHERE NOT x.mapped AND NOT y.known),
res AS (
  SELECT x.row_id, 'match' AS status, {CUST_KEY} AS key_values, {CUST_LEFT_JSON} AS left_data,
         {right_json('y', True)} AS right_data, '[]' AS diff_columns, 'both' AS side
  FROM firsts f JOIN nl x ON x.row_id = f.li JOIN nr y ON y.row_id = f.ri
  UNION ALL
  SELECT x.row_id, CASE WHEN {differ(_NAME_DIFF)} THEN 'mismatch' ELSE 'match' END,
         {CUST_KEY}, {CUST_LEFT_JSON}, {right_json('y', True)}, {names_json(_NAME_DIFF)}, 'both'
  FROM free f JOIN nl x ON x.row_id = f.li JOIN nr y ON y.row_id = f.ri
  UNION ALL
  SELECT x.row_id, 'missing_right', {CUST_KEY}, {CUST_LEFT_JSON}, '{{}}', '[]', 'left'
  FROM lm x
  WHERE (x.mapped AND x.row_id NOT IN (SELECT li FROM hits))
     OR (NOT x.mapped AND x.row_id NOT IN (SELECT li FROM free))
  UNION ALL
  SELECT y.row_id, 'missing_left', {json([("c_custkey", "y.k0")])}, '{{}}',
         {right_json('y', True)}, '[]', 'right'
  FROM nr y
  WHERE y.row_id NOT IN (SELECT ri FROM hits) AND y.row_id NOT IN (SELECT ri FROM free))"""
ORACLES["ge_compare"] = f"WITH {EXPANSION_CTES} SELECT * FROM res"
for _status in ("missing_right", "missing_left"):
    ORACLES[f"ge_{_status}"] = (
        f"WITH {EXPANSION_CTES} SELECT * FROM res WHERE status = '{_status}'"
    )
ORACLES["ge_fallback"] = f"""
WITH {EXPANSION_CTES}
SELECT x.row_id, CASE WHEN {differ(_NAME_DIFF)} THEN 'mismatch' ELSE 'match' END AS status,
       {CUST_KEY} AS key_values, {names_json(_NAME_DIFF)} AS diff_columns
FROM free f JOIN nl x ON x.row_id = f.li JOIN nr y ON y.row_id = f.ri"""
ORACLES["ge_unmapped_values"] = f"""
WITH {CUSTOMER_SIDES}, m AS ({fx.SEGMENT_MAP})
SELECT DISTINCT l1 AS value FROM nl
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.left_val = nl.l1)"""

# --- row order ------------------------------------------------------------------------------

_EVENT_DIFF = [("user_id", "x.a", "y.a"), ("event_type", "x.b", "y.b")]


def event_side(sql: str) -> str:
    return (
        f"SELECT ROW_NUMBER() OVER (ORDER BY event_id) AS n, {value('user_id')} AS a, "
        f"{value('event_type')} AS b FROM ({sql}) s"
    )


ORACLES["compare_row_order"] = f"""
WITH x AS ({event_side(fx.EVENTS_LEFT)}), y AS ({event_side(fx.EVENTS_RIGHT)})
SELECT COALESCE(x.n, y.n) AS row_id,
       CASE WHEN y.n IS NULL THEN 'missing_right' WHEN x.n IS NULL THEN 'missing_left'
            WHEN {differ(_EVENT_DIFF)} THEN 'mismatch' ELSE 'match' END AS status,
       {json([("row", "CAST(COALESCE(x.n, y.n) AS VARCHAR)")])} AS key_values,
       CASE WHEN x.n IS NULL THEN '{{}}'
            ELSE {json([("left_user_id", "x.a"), ("left_event_type", "x.b")])} END AS left_data,
       CASE WHEN y.n IS NULL THEN '{{}}'
            ELSE {json([("right_user_id", "y.a"), ("right_event_type", "y.b")])} END AS right_data,
       CASE WHEN x.n IS NULL OR y.n IS NULL THEN '[]' ELSE {names_json(_EVENT_DIFF)} END
         AS diff_columns,
       CASE WHEN y.n IS NULL THEN 'left' WHEN x.n IS NULL THEN 'right' ELSE 'both' END AS side
FROM x FULL OUTER JOIN y ON x.n = y.n"""
ORACLES["row_numbers"] = """
SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (ORDER BY o_custkey, o_orderkey) AS n
FROM orders"""
ORACLES["row_numbers_scan_order"] = (
    "SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id) AS n FROM events"
)

# --- expected migration ---------------------------------------------------------------------

ORACLES["expected_standard"] = f"""
SELECT n AS row_id, {key('o_orderkey')} AS order_id, {value('o_orderstatus')} AS status,
       {value('o_totalprice')} AS total_price, {value('o_orderpriority')} AS priority
FROM ({numbered(fx.ORDERS_LEFT)}) q"""
_EXPECTED = f"""
SELECT s.pos AS row_id, {key('c_custkey')} AS cust_id, {value('c_name')} AS cust_name,
       CASE WHEN m.left_val IS NULL THEN {value('c_mktsegment')} ELSE m.rc_0 END AS seg,
       m.rc_1 AS sub
FROM ({fx.CUST_LEFT}) s LEFT JOIN ({fx.SEGMENT_MAP}) m ON m.left_val = {value('c_mktsegment')}"""
ORACLES["expected_expansion"] = _EXPECTED
ORACLES["expected_export"] = f"SELECT * EXCLUDE (row_id) FROM ({_EXPECTED}) e"

# --- normalising ----------------------------------------------------------------------------

ORACLES["keys_projection"] = f"""
SELECT {key('l_orderkey')} AS key_l_orderkey, {key('l_linenumber')} AS key_l_linenumber
FROM ({fx.LINE_LEFT}) s"""
ORACLES["norm_defaults"] = f"""
SELECT pos AS row_id, {value('status')} AS right_status, {value('total_price')} AS right_total_price,
       {value('priority')} AS right_priority FROM ({fx.ORDERS_RIGHT}) s"""
ORACLES["norm_text"] = "SELECT doc_id, " + ", ".join(
    f"LOWER({value(c)}) AS {c}" for c in ("text", "lang", "source")
) + " FROM documents"


def dated(expr: str, pattern: str) -> str:
    """A text that is a date is shown in the pattern, any other stays."""
    day = f"TRY_CAST({expr} AS DATE)"
    return f"CASE WHEN {day} IS NULL THEN {expr} ELSE strftime({day}, '{pattern}') END"


def fixed(expr: str, places: int) -> str:
    """A text that is a number is shown with so many places, any other stays."""
    number = f"TRY_CAST({expr} AS DOUBLE)"
    return f"CASE WHEN {number} IS NULL THEN {expr} ELSE format('{{:.{places}f}}', {number}) END"


LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
ORACLES["norm_all_options"] = "SELECT " + ", ".join(
    f"{fixed(dated(f'LOWER({value(c)})', '%d/%m/%Y'), 1)} AS {c}" for c in LINE_COLUMNS
) + " FROM lineitem"
ORACLES["norm_date"] = f"""
SELECT o_orderkey, {dated('s', '%d.%m.%Y (%b, %j)')} AS s
FROM (SELECT o_orderkey, {value('s')} AS s FROM ({fx.DATE_TEXTS}) t) u"""
ORACLES["norm_number"] = f"""
SELECT o_orderkey, {fixed('s', 2)} AS s
FROM (SELECT o_orderkey, {value('s')} AS s FROM ({fx.NUMBER_TEXTS}) t) u"""
_T = "TRIM(CAST(priority AS VARCHAR))"
TRANSFORMED = {
    "prefix": f"CONCAT('P''', {_T})",
    "suffix": f"CONCAT({_T}, '-s')",
    "lpad": f"LPAD({_T}, 12, '*')",
    "rpad": f"RPAD({_T}, 6, ' ')",
    "strip_chars": f"TRANSLATE({_T}, '-. UH', '')",
    "replace": f"REPLACE({_T}, 'IGH', 'i')",
    "substring": f"SUBSTR({_T}, 3, 4)",
}
for _kind in TRANSFORM_CASES:
    ORACLES[f"transform_{_kind}"] = (
        f"SELECT pos, {clean(TRANSFORMED[_kind])} AS s FROM ({fx.ORDERS_RIGHT}) q"
    )

# --- reports --------------------------------------------------------------------------------

_COUNTS = "COUNT(*) AS total_rows, " + ", ".join(
    f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s, _ in LABELS
)
ORDER_SUMMARY = f"WITH {ORDER_CTES}, sm AS (SELECT {_COUNTS} FROM res)"


def pct(expr: str) -> str:
    return f"CAST(PRINTF('%.1f', CAST({expr} AS DOUBLE) / total_rows * 100) AS DOUBLE)"


ORACLES["summary_counts"] = f"{ORDER_SUMMARY} SELECT * FROM sm"
ORACLES["summary_pct"] = f"""{ORDER_SUMMARY}
SELECT total_rows, total_rows - duplicate_key AS validated_rows, {pct('match')} AS match_pct,
       {pct('mismatch')} AS mismatch_pct, {pct('missing_left + missing_right')} AS missing_pct
FROM sm"""
_REPORT = " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INTEGER) AS position, '{s}' AS status, '{t}' AS label, "
    f"{s} AS row_count, PRINTF('%.1f', CAST({s} AS DOUBLE) / total_rows * 100) || '%' AS pct, "
    "total_rows FROM sm"
    for i, (s, t) in enumerate(LABELS)
)
ORACLES["summary_report"] = f"{ORDER_SUMMARY} {_REPORT}"
ORACLES["run_compare"] = ORACLES["summary_report"]
ORACLES["status_distribution"] = f"""
WITH {EXPANSION_CTES}, sm AS (SELECT {_COUNTS} FROM res)
SELECT position, status, row_count,
       ROUND(CAST(row_count AS DOUBLE) / total_rows * 100, 6) AS share
FROM ({_REPORT}) r WHERE row_count > 0"""
_BREAKDOWN = f"""WITH {ORDER_CTES},
d AS (SELECT UNNEST(CAST(from_json(diff_columns, '["VARCHAR"]') AS VARCHAR[])) AS column_name
      FROM res WHERE status = 'mismatch'),
t AS (SELECT COUNT(*) AS total FROM res WHERE status = 'mismatch')
SELECT column_name, COUNT(*) AS mismatches,
       PRINTF('%.1f', CAST(COUNT(*) AS DOUBLE) / ANY_VALUE(t.total) * 100) || '%' AS share
FROM d, t GROUP BY column_name ORDER BY mismatches DESC, column_name LIMIT 15"""
ORACLES["mismatch_breakdown"] = _BREAKDOWN
ORACLES["mismatch_breakdown_stored"] = _BREAKDOWN
ORACLES["duplicate_breakdown"] = f"""WITH {LINE_CTES}
SELECT COUNT(*) FILTER (WHERE side = 'left') AS dup_left,
       COUNT(*) FILTER (WHERE side = 'right') AS dup_right
FROM res WHERE status = 'duplicate_key'"""
_KEY = json([("o_orderkey", "k0")])
ORACLES["sample_keys"] = f"""WITH {ORDER_CTES}
(SELECT 'left' AS sample, row_id, {_KEY} AS key_values FROM nl ORDER BY row_id LIMIT 5)
UNION ALL (SELECT 'right', row_id, {_KEY} FROM nr ORDER BY row_id LIMIT 5)
UNION ALL (SELECT 'missing_right', row_id, key_values FROM res
           WHERE status = 'missing_right' ORDER BY row_id LIMIT 5)
UNION ALL (SELECT 'missing_left', row_id, key_values FROM res
           WHERE status = 'missing_left' ORDER BY row_id LIMIT 5)"""
ORACLES["result_page"] = f"""WITH {ORDER_CTES}
SELECT {RESULT} FROM res WHERE status = 'mismatch'
ORDER BY row_id, status, key_values, left_data NULLS FIRST, right_data NULLS FIRST LIMIT 100 OFFSET 100"""
ORACLES["result_page_deep"] = f"""WITH {ORDER_CTES}
SELECT {RESULT} FROM res ORDER BY row_id, status, key_values, left_data NULLS FIRST, right_data NULLS FIRST LIMIT 200 OFFSET 3800"""


def detail(ctes: str, left: list[str], right: list[str], key_name: str, names: list[str]) -> str:
    def shown(column, name, missing):
        return (
            f"CASE WHEN status = '{missing}' THEN '—' ELSE "
            f"COALESCE(json_extract_string({column}, '$.{name}'), '') END"
        )

    columns = [f"{shown('left_data', 'left_' + c, 'missing_left')} AS {c}_left" for c in left]
    columns += [f"{shown('right_data', 'right_' + c, 'missing_right')} AS {c}_right" for c in right]
    marks = " || ".join(
        f"CASE WHEN contains(diff_columns, '\"{n}\"') THEN ', {n}' ELSE '' END"
        for n in sorted(names)
    )
    return f"""WITH {ctes}
SELECT row_id, {LABEL_CASE} AS status_label,
       COALESCE(json_extract_string(key_values, '$.{key_name}'), 'None') AS key_text,
       {', '.join(columns)},
       CASE WHEN diff_columns = '[]' THEN '—' ELSE SUBSTR({marks}, 3) END AS diff_text
FROM res"""


ORACLES["detail_wide"] = detail(
    ORDER_CTES, [a for a, _ in ORDER_PAIRS], [b for _, b in ORDER_PAIRS], "o_orderkey",
    [a for a, _ in ORDER_PAIRS],
)
ORACLES["detail_expanded"] = detail(
    EXPANSION_CTES, ["c_name", "c_mktsegment"], ["cust_name", "seg", "sub"], "c_custkey",
    ["c_name"],
)


def spaced(column: str, names: list[str]) -> str:
    parts = " || ', ' || ".join(
        f"'\"{n}\": ' || COALESCE(CAST(to_json(json_extract_string({column}, '$.{n}')) AS VARCHAR), "
        "'null')"
        for n in names
    )
    return f"CASE WHEN {column} = '{{}}' THEN '{{}}' ELSE '{{' || {parts} || '}}' END"


ORACLES["report_rows"] = f"""WITH {EXPANSION_CTES}
SELECT ROW_NUMBER() OVER (ORDER BY row_id, status, key_values, left_data, right_data) AS "No",
       {LABEL_CASE} AS "Status",
       'c_custkey=' || COALESCE(json_extract_string(key_values, '$.c_custkey'), 'None')
         AS "Key Values",
       {spaced('left_data', ['left_c_name', 'left_c_mktsegment'])} AS "Data Kiri",
       {spaced('right_data', ['right_cust_name', 'right_seg', 'right_sub'])} AS "Data Kanan",
       CASE WHEN diff_columns = '[]' THEN '' ELSE 'c_name' END AS "Kolom Berbeda"
FROM res"""

# --- sources and sinks ------------------------------------------------------------------------

_ORDER_TEXT = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_order_key, CAST(o_custkey AS VARCHAR) AS o_custkey,
       CAST(o_orderstatus AS VARCHAR) AS col_1st_status,
       CAST(o_totalprice AS VARCHAR) AS total_price, CAST(o_orderdate AS VARCHAR) AS order_date,
       CAST(o_orderpriority AS VARCHAR) AS prio_rity
FROM orders"""
ORACLES["scan_csv"] = _ORDER_TEXT
ORACLES["sanitize_columns"] = _ORDER_TEXT
ORACLES["scan_csv_multiline"] = (
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, NULLIF(text, '') AS text FROM documents"
)
_WIDTHS = {
    "nation": 3, "region": 2, "customer": 5, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5,
}
ORACLES["source_stats"] = " UNION ALL ".join(
    f"SELECT '{t}' AS source, COUNT(*) AS n_rows, CAST({_WIDTHS[t]} AS INTEGER) AS n_columns FROM {t}"
    for t in fx.TABLES
)
ORACLES["preview_n"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50"
_MAPPED = {"c_custkey": "cust_id", "c_name": "c_name", "c_nationkey": "cust_id",
           "c_mktsegment": "cust_id"}
ORACLES["auto_mapping"] = " UNION ALL ".join(
    f"SELECT '{a}' AS left_col, '{b}' AS right_col, "
    f"(SELECT COUNT({a}) FROM customer) AS left_filled, "
    f"(SELECT COUNT({'cust_name' if b == 'c_name' else b}) FROM ({fx.CUST_RIGHT}) r) AS right_filled"
    for a, b in _MAPPED.items()
)
_LEFT_NAMES = ("pos", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority")
_RIGHT_NAMES = ("pos", "order_id", "customer_id", "status", "total_price", "order_date",
                "priority")
ORACLES["schema_diff"] = " UNION ALL ".join(
    f"SELECT '{n}' AS name, {str(n in _LEFT_NAMES).upper()} AS in_left, "
    f"{str(n in _RIGHT_NAMES).upper()} AS in_right, "
    + (f"(SELECT COUNT({n}) FROM ({fx.ORDERS_LEFT}) a)" if n in _LEFT_NAMES else "CAST(NULL AS BIGINT)")
    + " AS left_filled, "
    + (f"(SELECT COUNT({n}) FROM ({fx.ORDERS_RIGHT}) b)" if n in _RIGHT_NAMES else "CAST(NULL AS BIGINT)")
    + " AS right_filled"
    for n in dict.fromkeys(_LEFT_NAMES + _RIGHT_NAMES)
)
_MAPPING = f"""
SELECT TRIM(a) AS left_val, TRIM(b) AS seg, COALESCE(TRIM(c), '') AS sub
FROM ({MAPPING_LINES}) q WHERE TRIM(b) <> '' OR COALESCE(TRIM(c), '') <> ''"""
ORACLES["mapping_ingest"] = _MAPPING
ORACLES["mapping_totals"] = f"""
SELECT COUNT(DISTINCT left_val) AS left_values, COUNT(*) AS right_rows,
       CAST(2 AS INTEGER) AS right_cols FROM ({_MAPPING}) m"""
ORACLES["export_results"] = f"""WITH {ORDER_CTES}
SELECT CAST(row_id AS VARCHAR) AS row_id, status, key_values, left_data, right_data, diff_columns
FROM res WHERE status = 'mismatch'"""

# --- run history ------------------------------------------------------------------------------

_FIGURES = f"""
SELECT *, COALESCE(CAST(json_extract(result_summary, '$.total_rows') AS BIGINT), 0) AS total_rows,
       COALESCE(CAST(json_extract(result_summary, '$.match') AS BIGINT), 0) AS m,
       COALESCE(CAST(json_extract(result_summary, '$.mismatch') AS BIGINT), 0) AS mm,
       COALESCE(CAST(json_extract(result_summary, '$.missing_left') AS BIGINT), 0) AS ms
FROM ({fx.RUNS}) r"""


def run_pct(column: str) -> str:
    return (
        f"CASE WHEN total_rows > 0 THEN CAST(PRINTF('%.1f', CAST({column} AS DOUBLE) / "
        "total_rows * 100) AS DOUBLE) ELSE 0.0 END"
    )


_SECONDS = "CAST(FLOOR((epoch_us(updated_at) - epoch_us(created_at)) / 1000000.0) AS BIGINT)"
ORACLES["run_history"] = f"""
WITH f AS (SELECT *, {_SECONDS} AS secs FROM ({_FIGURES}) g
           )
SELECT id, 'JOB-' || UPPER(SUBSTR(id, 1, 8)) AS job_number, name, job_type, status, total_rows,
       {run_pct('m')} AS match_pct, {run_pct('mm')} AS mismatch_pct, {run_pct('ms')} AS missing_pct,
       CASE WHEN secs < 60 THEN secs || 's'
            WHEN secs < 3600 THEN (secs // 60) || 'm ' || (secs % 60) || 's'
            ELSE (secs // 3600) || 'h ' || (secs // 60 % 60) || 'm' END AS duration,
       result_summary IS NOT NULL AS has_summary
FROM f WHERE status = 'completed' AND (contains(LOWER(name), 'user 1') OR contains(LOWER(id), 'user 1'))"""
ORACLES["run_kpis"] = f"""
WITH f AS ({_FIGURES}),
recent AS (SELECT *, {run_pct('mm')} AS mismatch_pct FROM f ORDER BY created_at DESC, id LIMIT 50),
ten AS (SELECT * FROM recent WHERE result_summary IS NOT NULL ORDER BY created_at DESC, id LIMIT 10),
a AS (SELECT COUNT(*) AS runs, COUNT(*) FILTER (WHERE status = 'completed') AS completed FROM f),
b AS (SELECT CAST(COALESCE(SUM(total_rows), 0) AS BIGINT) AS recent_rows FROM recent),
c AS (SELECT AVG(mismatch_pct) AS mean FROM ten)
SELECT runs, completed, PRINTF('%.1f', CAST(completed AS DOUBLE) / runs * 100) || '%' AS success_rate,
       recent_rows,
       CASE WHEN recent_rows >= 1000000 THEN PRINTF('%.1f', recent_rows / 1e6) || 'M'
            WHEN recent_rows >= 1000 THEN PRINTF('%.1f', recent_rows / 1e3) || 'K'
            ELSE CAST(recent_rows AS VARCHAR) END AS recent_rows_text,
       PRINTF('%.1f', mean) || '%' AS mean_mismatch
FROM a, b, c"""
