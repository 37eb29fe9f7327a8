"""Protection against keys that hold a large share of all rows.

The list of heavy keys is bounded by construction and only steers where rows go: any other key takes
the ordinary path with the same result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.operators.align import ROW_ID, named
from twinledger.session import estimated_bytes, materialise

MIN_BYTES = 64 << 20
"""Estimated key bytes from which heavy keys are looked for; below, one task could hold all rows."""

MIN_HITS = 3
"""Rows that prove a key ambiguous: one side must hold two of them."""

MAX_TRACKED = 1 << 19
MAX_SALTS = 256
HEAVY = "_heavy"
SALT = "_salt"


def is_large(frame: DataFrame, on: list[str], min_bytes: int | None = None) -> bool:
    """Whether the keys of a side are big enough for one of them to overload a task."""
    limit = MIN_BYTES if min_bytes is None else min_bytes
    return estimated_bytes(frame.select(*map(named, on))) >= limit


def heavy_keys(frame: DataFrame, on: list[str]) -> DataFrame | None:
    """Keys that hold more rows than an even task would: fewer than there are shuffle partitions.

    One pass keeps a bounded, mergeable summary of frequent key hashes (eight counters per partition,
    combined before anything is shuffled) that misses no such key. What it names is counted exactly, so
    no key below the mark is listed; in most tables it names none and that pass falls away.
    """
    spark = frame.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = frame.where(reduce(and_, (named(c).isNotNull() for c in on))).select(
        *map(named, on), F.xxhash64(*map(named, on)).alias("_hash")
    )
    listed = min(2 * partitions, MAX_TRACKED // 4)
    summary = usable.agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_hash, {listed}, {4 * listed})").alias("top")
    ).first()
    mark = max(MIN_HITS, -(-summary["n"] // partitions))
    named_by_summary = [(found["item"],) for found in summary["top"] or [] if found["count"] >= mark]
    if not named_by_summary:
        return None
    asked = F.broadcast(spark.createDataFrame(named_by_summary, "_hash long"))
    counted = (
        usable.join(asked, "_hash").groupBy(*map(named, on)).agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= mark).drop("_rows")
    )
    heavy = materialise(counted, "heavy-keys")
    return None if heavy.isEmpty() else heavy


def flag_heavy(frame: DataFrame, heavy: DataFrame | None, on: list[str]) -> DataFrame:
    """Add a boolean telling whether the row's key is heavy; the list is shorter than the number of partitions."""
    if heavy is None:
        return frame.withColumn(HEAVY, F.lit(False))
    listed = F.broadcast(heavy.withColumn(HEAVY, F.lit(True)))
    return frame.join(listed, on, "left").withColumn(HEAVY, F.coalesce(HEAVY, F.lit(False)))


def lookup(
    big: DataFrame, dim: DataFrame, on: list[str], how: str, large: bool
) -> DataFrame:
    """Join ``big`` to ``dim``, which has few rows per ``on``, whatever the skew of a ``large`` side.

    Rows of a heavy key are spread over salts by their row id and the key's ``dim`` rows are
    copied to each salt, so each row still meets each partner once. Rows with a NULL in
    ``on`` meet none and are spread as well.
    """
    if not large:
        return big.join(dim, on, how)
    heavy = heavy_keys(big, on)
    salts = min(MAX_SALTS, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unmatched = F.lit(False)
    for column in on:
        unmatched = unmatched | named(column).isNull()
    spread = flag_heavy(big, heavy, on).withColumn(
        SALT,
        F.when(unmatched, F.col(ROW_ID))
        .when(F.col(HEAVY), F.pmod(F.col(ROW_ID), F.lit(salts)))
        .otherwise(F.lit(0).cast("bigint")),
    )
    whole = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    copies = F.when(F.col(HEAVY), whole).otherwise(F.array(F.lit(0).cast("bigint")))
    copied = flag_heavy(dim, heavy, on).withColumn(SALT, F.explode(copies)).drop(HEAVY)
    return spread.drop(HEAVY).join(copied, [*on, SALT], how).drop(SALT)


def flag_members(
    big: DataFrame, members: DataFrame, on: list[str], flag: str, small: bool, large: bool
) -> DataFrame:
    """Left join ``members`` and tell for each row whether it met one.

    ``small`` members, whose size the caller has checked, are broadcast; others take the
    skew-safe lookup.
    """
    marked = members.withColumn(flag, F.lit(True))
    if small:
        joined = big.join(F.broadcast(marked), on, "left")
    else:
        joined = lookup(big, marked, on, "left", large)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))
