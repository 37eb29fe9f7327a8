"""Run history: an append-only ledger of runs and the figures drawn from it."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators.report import one_place, percent, percent_text
from twinledger.plans.spec import MISMATCH, MATCH, MISSING_LEFT, MISSING_RIGHT, CompareSpec

RUN_SCHEMA = (
    "id string, name string, job_type string, status string, config string, "
    "result_summary string, error_message string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)
ROWS_PER_FILE = 100_000
_SUMMARY = (
    "total_rows long, match long, mismatch long, missing_left long, missing_right long, "
    "duplicate_key long, _left_rows long, _right_rows long"
)


def append_run(
    spark: SparkSession,
    path: str,
    spec: CompareSpec,
    summary: dict[str, Any] | None,
    name: str = "",
    status: str = "completed",
    error: str | None = None,
    run_id: str | None = None,
    created_at: dt.datetime | None = None,
    updated_at: dt.datetime | None = None,
) -> str:
    """Add one state of a run; a later state of the same id supersedes it when read."""
    run_id = run_id or str(uuid.uuid4())
    updated = updated_at or dt.datetime.now()
    text = json.dumps(summary) if summary is not None else None
    row = (
        run_id, name, spec.job_type, status, spec.to_json(), text, error,
        created_at or updated, updated,
    )
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return latest_states(spark.read.schema(RUN_SCHEMA).parquet(path))


def latest_states(states: DataFrame) -> DataFrame:
    """The newest state of each run."""
    columns = [c for c in states.columns if c != "id"]
    newest = states.groupBy("id").agg(
        F.max_by(F.struct(*columns), F.struct("updated_at", *columns)).alias("s")
    )
    return newest.select("id", *[F.col(f"s.{c}").alias(c) for c in columns])


def compacted_files(runs: int, rows_per_file: int = ROWS_PER_FILE) -> int:
    """The most files that ``compact_runs`` leaves of so many runs: parts of about ``rows_per_file`` rows, of which
    a longer one is cut."""
    return 2 * max(1, -(-runs // rows_per_file))


def compact_runs(spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Merge the files of a ledger into few, sorted by creation and with the newest state of each run;
    returns how many files were merged. Their number follows from the runs alone (``compacted_files``), not
    from the session's partitions.

    The merged files are committed beside the old ones before those go. Readers take the newest state of
    a run, so the ledger reads alike before, between and after, also if the job ends half-way; states
    appended meanwhile stay. A reader that listed the old files must list anew.
    """
    old = spark.read.schema(RUN_SCHEMA).parquet(path).inputFiles()
    if not old:
        return 0
    states = spark.read.schema(RUN_SCHEMA).parquet(*old)
    parts = compacted_files(states.select("id").distinct().count(), rows_per_file) // 2
    merged = latest_states(states).repartitionByRange(parts, "created_at", "id").sortWithinPartitions("created_at", "id")
    merged.write.option("maxRecordsPerFile", rows_per_file).mode("append").parquet(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in old:
        file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        file.getFileSystem(conf).delete(file, False)
    return len(old)


def duration_text(start: Column, end: Column) -> Column:
    """``9s``, ``1m 23s`` or ``2h 5m``."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    secs = F.greatest(F.floor(micros / 1_000_000), F.lit(0))
    minutes = F.floor(secs / 60)
    return (
        F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(
            minutes.cast("string"), F.lit("m "), (secs % 60).cast("string"), F.lit("s")
        ))
        .otherwise(F.concat(
            F.floor(minutes / 60).cast("string"), F.lit("h "),
            (minutes % 60).cast("string"), F.lit("m"),
        ))
    )


def with_figures(runs: DataFrame) -> DataFrame:
    """Totals, percentages and duration of each run; zeros where there is no summary."""
    parsed = runs.withColumn("_s", F.from_json("result_summary", _SUMMARY))

    def figure(name: str) -> str:
        return f"coalesce(_s.{name}, 0L)"

    total = figure("total_rows")
    return parsed.select(
        "id",
        F.concat(F.lit("JOB-"), F.upper(F.substring("id", 1, 8))).alias("job_number"),
        "name", "job_type", "status", "created_at", "updated_at",
        F.expr(total).alias("total_rows"),
        percent(figure(MATCH), total).alias("match_pct"),
        percent(figure(MISMATCH), total).alias("mismatch_pct"),
        percent(f"({figure(MISSING_LEFT)} + {figure(MISSING_RIGHT)})", total).alias("missing_pct"),
        duration_text(F.col("created_at"), F.col("updated_at")).alias("duration"),
        F.col("result_summary").isNotNull().alias("has_summary"),
    )


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "id").limit(n)


def run_history(
    runs: DataFrame, status: str | None = None, search: str | None = None, limit: int | None = None
) -> DataFrame:
    """The runs that pass the status and name/id filters, newest first; of those ``limit`` if given."""
    shown = runs
    if status:
        shown = shown.where(F.col("status") == status)
    wanted = (search or "").strip().lower()
    if wanted:
        shown = shown.where(
            F.contains(F.lower("name"), F.lit(wanted)) | F.contains(F.lower("id"), F.lit(wanted))
        )
    newest = [F.desc("created_at"), "id"]
    return with_figures(shown.orderBy(*newest) if limit is None else recent_runs(shown, limit))


def runs_older_than(
    runs: DataFrame, days: int, now: dt.datetime | None = None
) -> DataFrame:
    cutoff = (now or dt.datetime.now()) - dt.timedelta(days=days)
    old = F.col("created_at") < F.lit(cutoff.isoformat()).cast("timestamp_ntz")
    return runs.where(old).orderBy("created_at", "id")


def run_kpis(runs: DataFrame, newest: int = 50, averaged: int = 10) -> DataFrame:
    """One row: run and completed counts, rows of the ``newest`` runs, and the mean mismatch
    percentage of the ``averaged`` newest of those that carry a summary."""
    counts = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed"),
    )
    recent = with_figures(recent_runs(runs, newest))
    rows = recent.agg(F.coalesce(F.sum("total_rows"), F.lit(0)).alias("recent_rows"))
    ten = recent.where("has_summary").orderBy(F.desc("created_at"), "id").limit(averaged)
    mean = ten.agg(F.avg("mismatch_pct").alias("mean"))
    joined = counts.select(
        "*", rows.scalar().alias("recent_rows"), mean.scalar().alias("mean")
    )
    total = F.col("recent_rows")
    return joined.select(
        "runs",
        "completed",
        percent_text("completed", "runs").alias("success_rate"),
        "recent_rows",
        F.when(total >= 1_000_000, F.expr(f"concat({one_place('recent_rows / 1e6D')}, 'M')"))
        .when(total >= 1_000, F.expr(f"concat({one_place('recent_rows / 1e3D')}, 'K')"))
        .otherwise(total.cast("string"))
        .alias("recent_rows_text"),
        F.expr(f"concat({one_place('mean')}, '%')").alias("mean_mismatch"),
    )
