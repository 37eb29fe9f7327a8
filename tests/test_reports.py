import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinledger.operators import report
from twinledger.operators.comparison import Comparison
from twinledger.plans import history
from twinledger.plans.spec import CompareSpec
from twinledger.session import scratch_path


@pytest.fixture(scope="module")
def results(spark):
    return spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, F.lit(77)).otherwise(F.col("id") * 3).alias("row_id"),
        F.when(F.col("id") % 2 == 0, F.lit("match")).otherwise(F.lit("mismatch")).alias("status"),
        F.concat(F.lit('{"k":"'), F.col("id"), F.lit('"}')).alias("key_values"),
        F.lit("{}").alias("left_data"), F.lit("{}").alias("right_data"),
        F.lit("[]").alias("diff_columns"),
    ).cache()


@pytest.mark.parametrize("page,size,status", [
    (1, 50, None), (40, 200, None), (100, 200, None), (101, 200, None), (30, 100, "mismatch"),
    (2, 5_000, None),
])
def test_deep_pages_equal_plain_ones(results, page, size, status):
    plain = report.result_page(results, page, size, status).collect()
    deep = report.result_page(results, page, size, status, shallow_rows=100).collect()
    assert deep == plain


def test_wide_pages_are_cut_by_number_and_keep_rows_without_an_id(spark, results):
    odd = results.withColumn("row_id", F.when(F.col("row_id") % 10 != 1, F.col("row_id")))
    rows = [tuple(r) for r in odd.orderBy(*report.RESULT_ORDER).collect()]
    assert rows[0][0] is None
    for page, size in ((1, 700), (2, 700), (1, 9_000), (2, 9_000), (3, 9_000), (4, 50), (40, 50)):
        got = report.result_page(odd, page, size, shallow_rows=100)
        assert [tuple(r) for r in got.collect()] == rows[(page - 1) * size : page * size]
        limits = got._jdf.queryExecution().executedPlan().toString()
        assert size <= 100 or not any(x in limits for x in ("GlobalLimit", "TakeOrdered", "CollectLimit"))


def test_page_info():
    assert report.page_info(0, 1, 50) == {"page": 1, "pages": 1, "first_row": 0, "last_row": 0, "total": 0}
    assert report.page_info(101, 3, 50)["pages"] == 3
    assert report.page_info(101, 3, 50)["last_row"] == 101


def test_search_has_live_wildcards_and_plain_backslashes(spark):
    df = spark.createDataFrame([('{"k":"a\\\\b"}',), ('{"k":"axb"}',)], "key_values string")
    assert report.filter_results(df, search="a_b").count() == 1
    assert report.filter_results(df, search="a\\\\b").count() == 1
    assert report.filter_results(df, search="K").count() == 0


def test_report_text(spark):
    row = (5, "mismatch", '{"a":"1","b":null}', '{"left_x":"q\\"\\n"}', "{}", '["x","y"]')
    names = "row_id long, status string, key_values string, left_data string, right_data string, diff_columns string"
    df = spark.createDataFrame([row], names)
    assert tuple(report.report_rows(df).first()) == (
        1, "Tidak Cocok", "a=1; b=None", '{"left_x": "q\\"\\n"}', "{}", "x, y",
    )
    assert report.report_rows(df, ", ").first()["Key Values"] == "a=1, b=None"


def test_empty_summary(spark):
    frame = spark.createDataFrame([], "status string")
    summary = report.summary_counts(frame)
    assert [r.pct for r in report.summary_report(summary).collect()] == ["0%"] * 5
    assert report.summary_percentages(summary).first()[1:] == (0, 0.0, 0.0, 0.0)
    assert report.status_distribution(summary).count() == 0
    empty = Comparison(spark.createDataFrame([], "status string"), (), (), (), ())
    assert report.mismatch_breakdown(empty).count() == 0


def test_ledger(spark):
    path = scratch_path(spark, "ledger")
    spec = CompareSpec.of([("a", "b")])
    start = dt.datetime(2024, 1, 1, 12)
    summary = {"total_rows": 8, "match": 7, "mismatch": 1}
    run = history.append_run(spark, path, spec, None, "First", "processing", created_at=start, updated_at=start)
    history.append_run(
        spark, path, spec, summary, "First", run_id=run, created_at=start,
        updated_at=start + dt.timedelta(seconds=83),
    )
    history.append_run(
        spark, path, spec, None, "Second", "failed", "no file",
        created_at=start + dt.timedelta(days=2), updated_at=start + dt.timedelta(days=2, seconds=9),
    )
    runs = history.read_runs(spark, path)
    assert runs.count() == 2
    shown = history.run_history(runs).collect()
    assert [(r.name, r.duration, r.match_pct, r.mismatch_pct) for r in shown] == [
        ("Second", "9s", 0.0, 0.0), ("First", "1m 23s", 87.5, 12.5),
    ]
    assert shown[1].job_number == "JOB-" + run[:8].upper()
    assert history.run_history(runs, "failed").count() == 1
    assert history.run_history(runs, search="FIRST").count() == 1
    old = history.runs_older_than(runs, 1, now=start + dt.timedelta(days=2))
    assert [r.name for r in old.collect()] == ["First"]
    kpis = history.run_kpis(runs).first()
    assert (kpis.runs, kpis.completed, kpis.success_rate, kpis.mean_mismatch) == (2, 1, "50.0%", "12.5%")
    assert CompareSpec.from_json(runs.first().config) == spec
