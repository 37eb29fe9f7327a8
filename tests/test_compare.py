import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinledger.operators import report
from twinledger.operators.expansion import compare_expanded
from twinledger.operators.expected import expected_rows
from twinledger.operators.keyed import ambiguous_keys, compare_keyed, keyed_views
from twinledger.operators.one_to_many import compare_one_to_many
from twinledger.operators.roworder import compare_row_order
from twinledger.plans.run import compare
from twinledger.plans.spec import CompareOptions, CompareSpec, ExpansionRule
from twinledger import session as shared

KEYED = CompareSpec.of([("case", "case"), ("a", "ra"), ("b", "rb")], [("v", "rv")])
LEFT_SCHEMA = "n long, case int, a string, b string, v string"
RIGHT_SCHEMA = "n long, case int, ra string, rb string, rv string"


def summary(comparison):
    counts = report.summary_counts(comparison.frame).first().asDict()
    return {k: v for k, v in counts.items() if v}


def clean(value):
    return (value or "").strip(" ") or None


def brute_keyed(left, right):
    """(row, status, side) by looking at every row of the other side."""
    def key(row):
        parts = [None if p is None else str(p).strip(" ") for p in row[1:4]]
        return None if None in parts else tuple(parts)

    nl, nr = Counter(map(key, left)), Counter(map(key, right))
    out = []
    for row in left:
        k = key(row)
        if k is None or (nl[k] == 1 and not nr[k]):
            out.append((row[0], "missing_right", "left"))
        elif nl[k] > 1 or nr[k] > 1:
            out.append((row[0], "duplicate_key", "left"))
        else:
            other = next(r for r in right if key(r) == k)
            same = clean(row[4]) == clean(other[4])
            out.append((row[0], "match" if same else "mismatch", "both"))
    for row in right:
        k = key(row)
        if k is None or (nr[k] == 1 and not nl[k]):
            out.append((row[0], "missing_left", "right"))
        elif nl[k] > 1 or nr[k] > 1:
            out.append((row[0], "duplicate_key", "right"))
    return sorted(out)


def classified(comparison):
    rows = comparison.frame.select("row_id", "status", "side").collect()
    return sorted(map(tuple, rows))


def random_side(rng, cases):
    rows = []
    for case in range(cases):
        for _ in range(rng.randint(0, 6)):
            rows.append((
                len(rows) + 1, case, rng.choice(["1", " 1", "2", "3", "", None]),
                rng.choice(["x", "x ", "y", None]), rng.choice(["p", " p", "q", "", None]),
            ))
    return rows


@pytest.mark.parametrize("strategy", ["window", "join"])
@pytest.mark.parametrize("min_bytes", [None, 0])
def test_keyed_equals_brute_force_on_many_cases(spark, strategy, min_bytes):
    rng = random.Random(11)
    left, right = random_side(rng, 300), random_side(rng, 300)
    got = compare_keyed(
        spark.createDataFrame(left, LEFT_SCHEMA), spark.createDataFrame(right, RIGHT_SCHEMA),
        KEYED, left_row_id="n", right_row_id="n", strategy=strategy, min_bytes=min_bytes,
    )
    assert classified(got) == brute_keyed(left, right)


@pytest.mark.parametrize("strategy", ["window", "join"])
def test_a_hot_key_and_hot_nulls(spark, strategy):
    def side(n):
        return [
            (i, 0, "hot" if i % 3 == 0 else None if i % 3 == 1 else str(i), "x", "p")
            for i in range(1, n)
        ]

    left, right = side(4_000), side(3_000)
    got = compare_keyed(
        spark.createDataFrame(left, LEFT_SCHEMA), spark.createDataFrame(right, RIGHT_SCHEMA),
        KEYED, left_row_id="n", right_row_id="n", strategy=strategy, min_bytes=0,
    )
    assert classified(got) == brute_keyed(left, right)


_key = st.sampled_from(["1", " 1", "2", "", None])
_rows = st.lists(st.tuples(_key, _key, st.sampled_from(["p", "q", "", None])), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(_rows, _rows)
def test_conservation_and_symmetry(spark, left, right):
    a = [(i + 1, 0, *r) for i, r in enumerate(left)]
    b = [(i + 1, 0, *r) for i, r in enumerate(right)]
    frames = [spark.createDataFrame(rows, LEFT_SCHEMA) for rows in (a, b)]
    spec = CompareSpec.of([("case", "case"), ("a", "a"), ("b", "b")], [("v", "v")])
    one, two = (
        compare_keyed(x, y, spec, left_row_id="n", right_row_id="n")
        for x, y in (frames, frames[::-1])
    )
    counts, swapped = summary(one), summary(two)
    pairs = counts.get("match", 0) + counts.get("mismatch", 0)
    assert counts.get("total_rows", 0) == len(a) + len(b) - pairs
    assert counts.get("missing_left", 0) == swapped.get("missing_right", 0)
    assert counts.get("duplicate_key", 0) == swapped.get("duplicate_key", 0)
    itself = summary(compare_keyed(frames[0], frames[0], spec, left_row_id="n", right_row_id="n"))
    assert not itself.get("mismatch")


def test_documented_counts(documented):
    t = documented
    orders = CompareSpec.of(
        [("o_orderkey", "order_id")], [("o_orderstatus", "status"), ("o_orderpriority", "priority")]
    )
    assert summary(compare_keyed(t["orders_l"], t["orders_r"], orders)) == {
        "total_rows": 15539, "duplicate_key": 841, "mismatch": 3666, "match": 9426,
        "missing_right": 757, "missing_left": 849,
    }
    lines = CompareSpec.of(
        [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")],
        [("l_returnflag", "l_returnflag")],
    )
    assert summary(compare_keyed(t["line_l"], t["line_r"], lines)) == {
        "total_rows": 84223, "duplicate_key": 50195, "mismatch": 916, "match": 30896,
        "missing_right": 1134, "missing_left": 1082,
    }
    rule = ExpansionRule("c_mktsegment", ("seg", "sub"))
    customers = CompareSpec.of([("c_custkey", "cust_id")], [("c_name", "cust_name"), ("c_mktsegment", "seg")])
    expanded = compare_expanded(t["cust_l"], t["cust_r"], customers, rule, t["seg_map"])
    assert summary(expanded) == {
        "total_rows": 2094, "match": 1433, "missing_right": 30, "missing_left": 631,
    }
    events = CompareSpec.of((), [("event_type", "event_type")], use_row_order=True)
    ordered = compare_row_order(t["ev_l"], t["ev_r"], events, (), ["event_id"], ["event_id"])
    assert summary(ordered) == {
        "total_rows": 10000, "match": 2009, "mismatch": 7891, "missing_right": 100,
    }


def test_one_shuffle_for_the_keyed_compare(spark, documented):
    spec = CompareSpec.of([("o_orderkey", "order_id")], [("o_orderstatus", "status")])
    frame = compare_keyed(documented["orders_l"], documented["orders_r"], spec).results()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "o_totalprice" not in plan


def test_no_compare_columns_still_reports_sides(spark):
    left = spark.createDataFrame([("1",), ("1",), ("2",)], "k string")
    right = spark.createDataFrame([("2",), ("3",)], "k string")
    got = compare_keyed(left, right, CompareSpec.of([("k", "k")]))
    rows = got.results().select("status", "left_data", "right_data", "diff_columns").collect()
    assert {tuple(r)[1:] for r in rows} == {("{}", "{}", "[]")}
    assert Counter(r.status for r in rows) == {"duplicate_key": 2, "match": 1, "missing_left": 1}
    assert report.duplicate_breakdown(got.frame).first() == (2, 0)


def test_null_keys_are_ambiguous_only_as_a_listing(spark):
    left = spark.createDataFrame([(None,), (None,), ("1",)], "k string")
    right = spark.createDataFrame([("1",)], "k string")
    spec = CompareSpec.of([("k", "k")])
    assert ambiguous_keys(*keyed_views(left, right, spec)).collect() == [(None,)]
    assert summary(compare_keyed(left, right, spec)) == {"total_rows": 3, "match": 1, "missing_right": 2}


# --- expansion -----------------------------------------------------------------------------

RULE = ExpansionRule("g", ("h", "s"))
EXPAND = CompareSpec.of([("case", "case"), ("k", "k")], [("v", "rv"), ("g", "h")])


def brute_expanded(left, right, mapping):
    def norm(x):
        return clean(x)

    def key(row):
        parts = [None if p is None else str(p).strip(" ") for p in row[1:3]]
        return None if None in parts else tuple(parts)

    rows = [tuple(norm(c) for c in r) for r in mapping]
    tuples = {r[1:] for r in rows if None not in r[1:]}
    values = {r[0] for r in rows if r[0] is not None}
    wanted = {r for r in rows if None not in r}
    out, covered = [], set()
    for l in left:
        lk, g = key(l), norm(l[4])
        mates = [r for r in right if lk is not None and key(r) == lk]
        if g in values:
            hits = [r for r in mates if (g, norm(r[4]), norm(r[5])) in wanted]
            covered |= {r[0] for r in hits}
            if hits:
                out.append((l[0], "match", "both", min(r[0] for r in hits)))
            else:
                out.append((l[0], "missing_right", "left", None))
            continue
        free = [r for r in mates if (norm(r[4]), norm(r[5])) not in tuples]
        covered |= {r[0] for r in free}
        for r in free:
            same = norm(l[3]) == norm(r[3])
            out.append((l[0], "match" if same else "mismatch", "both", r[0]))
        if not free:
            out.append((l[0], "missing_right", "left", None))
    out += [(r[0], "missing_left", "right", r[0]) for r in right if r[0] not in covered]
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes,limit", [(None, None), (0, 0)])
def test_expansion_equals_brute_force(spark, monkeypatch, min_bytes, limit):
    if limit is not None:
        monkeypatch.setattr(shared, "fits_broadcast", lambda df, n=0: False)
        monkeypatch.setattr("twinledger.operators.expansion.fits_broadcast", lambda df, n=0: False)
    rng = random.Random(3)
    mapping = [("A", "x", "1"), ("A", "x", "2"), ("B", "y", "1"), ("C", "x", "1"),
               ("D", "z", ""), ("", "w", "1"), ("A", "x", "1")]
    left, right = [], []
    for case in range(200):
        for _ in range(rng.randint(0, 4)):
            left.append((len(left) + 1, case, rng.choice(["1", "1 ", "2", None]),
                         rng.choice(["p", "q", None]), rng.choice(["A", " A", "B", "C", "D", "E", "", None])))
        for _ in range(rng.randint(0, 5)):
            right.append((len(right) + 1, case, rng.choice(["1", "2", None]), rng.choice(["p", "q", None]),
                          rng.choice(["x", "y", "z", "w", "v", None]), rng.choice(["1", "2", "", None])))
    got = compare_expanded(
        spark.createDataFrame(left, "n long, case int, k string, v string, g string"),
        spark.createDataFrame(
            [(*r[:4], r[4], r[5], str(r[0])) for r in right],
            "n long, case int, k string, rv string, h string, s string, own string",
        ),
        CompareSpec.of(
            [("case", "case"), ("k", "k")], [("v", "rv"), ("g", "h"), ("n", "own")],
        ),
        RULE, spark.createDataFrame(mapping, "left_val string, rc_0 string, rc_1 string"),
        left_row_id="n", right_row_id="n", min_bytes=min_bytes,
    )
    rows = got.frame.select(
        "row_id", "status", "side", F.col("right.right_own").cast("long")
    ).collect()
    # `own` may differ from `n`, so pairs are checked by partner, not by match or mismatch
    ours = [tuple(r) for r in rows]
    expected = brute_expanded(left, right, mapping)
    assert sorted([(r[0], r[2], r[3]) for r in ours], key=str) == sorted(
        [(e[0], e[2], e[3]) for e in expected], key=str
    )
    assert Counter(r[1] for r in ours if r[2] != "both") == Counter(
        e[1] for e in expected if e[2] != "both"
    )


def test_expansion_statuses_and_payload(spark):
    left = spark.createDataFrame([(1, 0, "1", "p", "A"), (2, 0, "2", "p", "E")],
                                 "n long, case int, k string, v string, g string")
    right = spark.createDataFrame(
        [(1, 0, "1", "other", "x", "2"), (2, 0, "1", "p", "x", "1"), (3, 0, "2", "q", "v", None)],
        "n long, case int, k string, rv string, h string, s string",
    )
    rule = ExpansionRule("g", ("h", "s"), {"A": [["x", "1"], ["x", "2"]]})
    got = compare(left, right, EXPAND, expansions=[rule], left_row_id="n", right_row_id="n")
    rows = {r.row_id: r for r in got.results().collect()}
    assert rows[1].status == "match" and rows[1].diff_columns == "[]"
    assert rows[1].right_data == '{"right_rv":"other","right_h":"x","right_s":"2"}'
    assert rows[2].status == "mismatch" and rows[2].diff_columns == '["v"]'
    off = CompareSpec.of([("case", "case"), ("k", "k")], [("v", "rv")], CompareOptions(apply_group_expansion=False))
    assert summary(compare(left, right, off, expansions=[rule]))["duplicate_key"] == 3


def test_expected_rows_keep_raw_mapping_by_default(spark):
    left = spark.createDataFrame([(1, "k1", " a ", "p"), (2, "k2", "z", "q")], "n long, k string, g string, v string")
    spec = CompareSpec.of([("k", "key")], [("g", "h"), ("v", "w")], CompareOptions(ignore_case=True))
    rule = ExpansionRule("g", ("h", "s"), {"A": [["X", "1"]], "a": [["Y", ""]]})
    raw = expected_rows(left, spec, rule=rule, row_id="n").orderBy("row_id").collect()
    assert [tuple(r) for r in raw] == [(1, "k1", "p", "Y", ""), (2, "k2", "q", "z", None)]
    cleaned = expected_rows(left, spec, rule=rule, row_id="n", normalise_mapping=True)
    assert sorted((tuple(r) for r in cleaned.where("row_id = 1").collect()), key=str) == [
        (1, "k1", "p", "x", "1"), (1, "k1", "p", "y", None),
    ]


def test_one_to_many_compares_every_right_row(spark):
    left = spark.createDataFrame([("1", "p"), ("2", "p"), ("2", "q"), ("3", "p"), (None, "p")], "k string, v string")
    right = spark.createDataFrame([("1", "p"), ("1", "q"), ("2", "p"), ("4", "p"), (None, "p")], "k string, v string")
    spec = CompareSpec.of([("k", "k")], [("v", "v")])
    for min_bytes in (None, 0):
        got = compare_one_to_many(left, right, spec, min_bytes=min_bytes)
        assert summary(got) == {
            "total_rows": 9, "match": 1, "mismatch": 1, "duplicate_key": 3,
            "missing_right": 2, "missing_left": 2,
        }
