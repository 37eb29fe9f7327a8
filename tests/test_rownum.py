import pytest
from pyspark.sql import functions as F

from twinledger.operators.rownum import number_by, number_in_scan_order
from twinledger.session import scratch_path


def consecutive(df, name="n"):
    total = df.count()
    seen = df.agg(F.min(name), F.max(name), F.countDistinct(name)).first()
    return tuple(seen) == (1, total, total)


def test_ordered_numbers_with_a_hot_value_and_equal_rows(spark):
    df = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 100).alias("k"),
        F.lit("same").alias("v"),
    )
    got = number_by(df, ["k"], "n")
    assert consecutive(got)
    disordered = got.alias("a").join(got.alias("b"), F.expr("a.n + 1 = b.n")).where("a.k > b.k")
    assert disordered.count() == 0


def test_nulls_come_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    got = number_by(df, ["k"], "n")
    assert {r.k: r.n for r in got.collect()} == {None: 1, "a": 2, "b": 3}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_scan_order_over_many_files(spark, fmt):
    path = scratch_path(spark, f"scan-{fmt}")
    spark.range(5_000).repartition(7).write.format(fmt).save(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = spark.read.format(fmt).schema("id long").load(path)
        assert df.rdd.getNumPartitions() > 7
        got = number_in_scan_order(df, "n")
        assert consecutive(got)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scan_order_of_a_derived_frame_and_of_nothing(spark):
    assert consecutive(number_in_scan_order(spark.range(100).repartition(5), "n"))
    assert number_in_scan_order(spark.range(0), "n").count() == 0


def test_numbers_do_not_hang_on_splits(spark):
    """Planned under one split size and run under another, no row is lost or numbered twice."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"splits-{fmt}")
        spark.range(20_000).repartition(3).write.format(fmt).save(path)
        got = number_in_scan_order(spark.read.format(fmt).schema("id long").load(path), "n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        try:
            assert consecutive(got) and got.count() == 20_000
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_numbers_of_frames_derived_from_files(spark):
    path = scratch_path(spark, "derived")
    spark.range(20_000).repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    for derived in (df.orderBy(F.desc("id")), df.repartition(3), df.join(df, "id"), df.where("id % 2 = 0")):
        assert consecutive(number_in_scan_order(derived, "n"))
    ordered = number_in_scan_order(df.orderBy(F.desc("id")), "n")
    assert ordered.where("n + id <> 20000").isEmpty()
