"""The corpus pipeline: stages over ``documents``, each calling one operator of ``twinledger.llm``.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. Stages
but the last return the columns of ``documents``; other columns are left behind. Every row is judged by
its own text, whether its doc_id is null, its own or that of other rows too; of a group of near copies
the row of the least doc_id stays (a null one only if no other has an id), of repeated rows one. Null and
empty texts pass every filter; without words there is nothing to schedule. An empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import pick, sized_join, table
from twinledger.llm.decontaminate import benchmark_matches
from twinledger.llm.lines import dedup_lines
from twinledger.llm.minhash import NearDuplicates, near_duplicates
from twinledger.llm.mixing import Mix, mixture
from twinledger.llm.toxicity import toxicity_scores, train
from twinledger.session import materialise, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; null and empty texts stay."""
    docs = pick(docs, *COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    kept = toxicity_scores(docs, model, keep=COLUMNS)
    return kept.where((F.col("score") < 0.5) | (F.coalesce(F.length("text"), F.lit(0)) == 0)).select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that stand earlier; a document that loses its whole text goes."""
    cut = dedup_lines(pick(docs, *COLUMNS))
    emptied = (F.col("n_cut") > 0) & (F.trim("text") == "")
    return cut.where(F.coalesce(~emptied, F.lit(True))).select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a unique ``row``, written so that every use sees the same numbers."""
    return materialise(pick(docs, *COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies (five words, 0.8)."""
    rows = _numbered(docs)
    judged = materialise(
        near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), NearDuplicates())
        .select(F.col("doc_id").alias("row"), "component_id"),
        "near-copies",
    )
    grouped = judged.join(
        judged.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "component_id"
    ).join(rows.select("row", "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = grouped.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = materialise(grouped.select("row").join(stays, "row", "left_anti"), "near-copies-gone")
    return sized_join(rows, gone, "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an exact window of ten words of a benchmark item."""
    rows = _numbered(docs)
    numbers, matches = benchmark_matches(
        rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")
    )
    hit = matches.where("kind = 'phrase'").select("row").distinct().join(numbers, "row").select(F.col("doc_id").alias("row"))
    return sized_join(rows, materialise(hit, "contaminated"), "row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The schedule of all that is left: every document with words at least once."""
    return mixture(docs, Mix())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None
"""A trained classifier and near-duplicate components have no SQL; the tests compare by brute force."""

PIPELINE_QUERIES = {"pipeline": run}
