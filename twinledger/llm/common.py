"""What the operators share: safe column choice, tables, sized joins, word hashes, components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.session import fits_broadcast, materialise

BROADCAST_BYTES = 8 << 20
"""Written (compressed) bytes up to which a lookup table is broadcast; beyond, a shuffle join."""

BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

WORD_CACHE = 200_000
"""Words a task keeps the hash of; further words are hashed each time they are met."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the named columns (``new=old`` renames), whatever other columns there are.

    A name is looked up with its exact case first and without case after, so that an extra column
    ``TEXT`` beside ``text`` is no ambiguity; the first of several equal names is taken.
    """
    wanted = {**{name: name for name in names}, **renamed}
    lower = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    chosen = []
    for new, old in wanted.items():
        if old in df.columns:
            at = df.columns.index(old)
        elif old.lower() in lower:
            at = lower.index(old.lower())
        else:
            raise ValueError(f"no column {old} in {df.columns}")
        chosen.append(F.col(f"c{at}").alias(new))
    return plain.select(*chosen)


def sized_join(df: DataFrame, written: DataFrame, on, how: str) -> DataFrame:
    """Join a written table: broadcast if its files are small, otherwise by shuffle."""
    small = fits_broadcast(written, BROADCAST_BYTES)
    return df.join(F.broadcast(written) if small else written, on, how)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows.

    Texts may be long, and Arrow's buffers lie outside the executor's heap. Spark takes the limit from
    the session when the plan runs, so it stays set there; a smaller one is left alone.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING, "10000")) > BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, kept for up to ``WORD_CACHE`` of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _large_star(edges: DataFrame, label: str) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-large")
    return (
        both.join(least, "a")
        .where("b > a AND b > m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame, label: str) -> DataFrame:
    edges = materialise(edges, f"{label}-grown")
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m")), f"{label}-small")
    return (
        edges.join(least, "a")
        .select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        .where("e.b > e.m")
        .select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component_id) of every node that a link (a, b) touches, by alternating stars.

    Large-star links every greater neighbour of a node to the least one, small-star every smaller
    one; repeated until nothing changes, each node hangs on the least id of its component. The
    neighbourhood minima are pre-aggregated and written, and go back by an equi join of two exchanges,
    of which AQE splits hot nodes, so a hub never lands in one task. Each round is a written table; only a count
    and a checksum reach the driver. Links of a node with itself or with NULL are ignored.
    """
    edges = (
        edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), "a", "b")
        .where("a <> b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )
    edges = materialise(edges, f"{label}-links")
    seen = None
    while True:
        edges = materialise(_small_star(_large_star(edges, label).distinct(), label).distinct(), f"{label}-stars")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return nodes.union(roots)
