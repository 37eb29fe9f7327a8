"""The trigram index against the scan, planned partitions and ledger compaction on edge cases."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from twinledger.operators.report import filter_results
from twinledger.operators.search import search_grams, search_indexed, write_key_index
from twinledger.plans import history
from twinledger.session import scratch_path
from twinledger.sources.jdbc import equi_depth_predicates


@given(st.text(alphabet="ab%_", max_size=12))
def test_grams_lie_in_literal_parts(search):
    parts = search.replace("_", "%").split("%")
    grams = search_grams(search)
    assert all(any(g in p for p in parts) and len(g) == 3 for g in grams)
    assert bool(grams) == any(len(p) >= 3 for p in parts)


def test_index_equals_scan(spark):
    keys = ['{"k":"alpha_1"}', '{"k":"alphabet"}', '{"k":"ALPHA"}', '{"k":"Ünï€de"}', "ab", "", None, '{"k":"aaaaaa"}']
    rows = [(i if i % 5 else None, "match", k) for i, k in enumerate(keys)] + [(1, "match", keys[1])]
    results = spark.createDataFrame(rows, "row_id long, status string, key_values string")
    index = write_key_index(results, scratch_path(spark, "test-index"))
    for search in ("alpha", "alp%t", "a_p", "ab", "%", "nï€", "aaaa", "zzz", "al_ha", "\u0001%", '"k":'):
        want = sorted(map(str, filter_results(results, search=search).collect()))
        assert sorted(map(str, search_indexed(results, index, search).collect())) == want, search


def test_index_is_made_without_a_shuffle_and_holds_every_posting(spark):
    texts = [None, "", "ab", "abc", "abcabc", "\U0001F600x\U0001F600x", "a\u0000bc", "zzzz"] * 40
    rows = [(None if i % 7 == 0 else i % 50, t) for i, t in enumerate(texts)]
    results = spark.createDataFrame(rows, "row_id long, key_values string").repartition(3)
    index = write_key_index(results, scratch_path(spark, "test-index"))
    got = sorted(map(str, (r for r in index.selectExpr("gram", "explode(rows) AS row_id").collect())))
    want = [(t[i : i + 3], n) for n, t in rows if t for i in sorted({t.index(t[j : j + 3]) for j in range(len(t) - 2)})]
    assert got == sorted(str(Row(gram=g, row_id=n)) for g, n in want)
    assert all(r.n == len(r.rows) for r in index.collect())
    assert index.groupBy("gram").count().where("count > 1").count() > 0


@pytest.mark.parametrize("kind,values", [
    ("long", [None, 5, 5, 5, 5, 5, 6, -7, 100]),
    ("double", [None, float("nan"), float("inf"), float("inf"), float("inf"), 1.5, -0.0, 2.5, float("-inf")]),
    ("decimal(20,4)", [None, *map(Decimal, ("1.25", "-3.5", "99999999999999.0001"))]),
    ("date", [None, dt.date(1, 1, 1), dt.date(1999, 12, 31), dt.date(9999, 12, 31)]),
    ("timestamp_ntz", [None, dt.datetime(2020, 1, 1, 0, 0, 0, 5), dt.datetime(2020, 1, 1)]),
    ("long", [None, None]), ("long", []),
])
@pytest.mark.parametrize("parts", [1, 4])
def test_each_row_lies_in_one_partition(spark, kind, values, parts):
    plain = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    predicates = equi_depth_predicates(plain, "c", parts, "`")
    times = sum(F.coalesce(F.expr(p).cast("int"), F.lit(0)) for p in predicates)
    assert [r[0] for r in plain.select(times).collect()] == [1] * len(values)
    assert len(predicates) <= parts + 1


def test_texts_are_not_split(spark):
    with pytest.raises(ValueError):
        equi_depth_predicates(spark.createDataFrame([("x",)], "c string"), "c", 4, '"')


def test_parts_are_even(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id")).alias("c"))
    counts = [df.where(p).count() for p in equi_depth_predicates(df, "c", 8, "`")]
    assert counts[0] == 0 and all(abs(n - 1250) <= 20 for n in counts[1:])


def test_compaction_reads_alike_and_keeps_later_states(spark):
    path = scratch_path(spark, "test-ledger")
    day = dt.datetime(2024, 1, 1)
    rows = [(str(i), f"run {i}", "t", "processing", "{}", None, None, day + dt.timedelta(days=i), day) for i in range(9)]
    done = [(*r[:3], "completed", *r[4:8], day + dt.timedelta(seconds=1)) for r in rows[:6]]
    for row in (*rows, *done):
        spark.createDataFrame([row], history.RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    before = sorted(map(str, history.read_runs(spark, path).collect()))
    assert history.compact_runs(spark, path) == 15
    assert sorted(map(str, history.read_runs(spark, path).collect())) == before
    assert len(spark.read.parquet(path).inputFiles()) <= 2
    late = (*rows[8][:3], "failed", *rows[8][4:8], day + dt.timedelta(days=1))
    spark.createDataFrame([late], history.RUN_SCHEMA).write.mode("append").parquet(path)
    history.compact_runs(spark, path)
    states = {r.id: r.status for r in history.read_runs(spark, path).collect()}
    assert (states["8"], states["7"], states["0"], len(states)) == ("failed", "processing", "completed", 9)


def test_compacted_files_follow_from_the_runs(spark):
    path = scratch_path(spark, "test-ledger")
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    runs = spark.range(2_500).select(
        F.col("id").cast("string"), *[F.lit("x").alias(c) for c in ("name", "job_type", "status", "config", "result_summary", "error_message")],
        day.alias("created_at"), day.alias("updated_at"),
    )
    for _ in range(2):
        runs.repartition(6).write.mode("append").parquet(path)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        history.compact_runs(spark, path)
        assert len(spark.read.parquet(path).inputFiles()) <= history.compacted_files(2_500) == 2
        assert history.compact_runs(spark, path, rows_per_file=1_000) <= 2
        assert 3 <= len(spark.read.parquet(path).inputFiles()) <= history.compacted_files(2_500, 1_000) == 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert history.read_runs(spark, path).count() == 2_500
