"""Mixing sources by temperature: an exponent bisected to a target, realised as block permutations.

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.common import pick
from twinledger.session import materialise

POINTS = 16
"""Exponents that one aggregate over the sources evaluates: four bisection steps at once."""

ROUNDS = 8
"""Aggregates per bisection; the exponent is known to 17^-8, 1.4e-10."""

BUCKETS = 4_096
"""Hash ranges in which a source is put in order; only their sums are added up one after another."""


@dataclass(frozen=True)
class Mix:
    """Weights are token shares to the power of an exponent between 0 and 1, normalised.

    The exponent is the greatest one whose weights have at least ``entropy`` of the greatest possible
    entropy (log of the number of sources), or, if ``entropy`` is None, the least one with which no
    source is repeated more than ``repetitions`` times. If both are given, the repetition limit has
    priority. ``budget`` are the tokens to hand out; None means as many as pass the source that is
    repeated least exactly once, so that every document is used. ``blocks`` is the number of blocks,
    each of which holds the sources at their weights.
    """

    entropy: float | None = 0.98
    repetitions: float = 4.0
    budget: int | None = None
    blocks: int = 64
    seed: int = 5


def _bisect(shares: DataFrame, holds, rising: bool) -> float:
    """The edge of the exponents for which ``holds(aggregated figures)`` is true.

    ``rising``: true from some exponent on (the least such one is returned), else true up to some one
    (the greatest is returned). One aggregate looks at ``POINTS`` exponents, whatever the number of
    sources; a handful of rows comes back.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        width = (high - low) / (POINTS + 1)
        grid = [low + width * (i + 1) for i in range(POINTS)]
        figures = (
            shares.select("log_share", F.explode(F.array(*[F.lit(x) for x in grid])).alias("exponent"))
            .withColumn("power", F.exp(F.col("exponent") * F.col("log_share")))
            .groupBy("exponent")
            .agg(
                F.sum("power").alias("z"),
                F.sum(F.col("power") * F.col("exponent") * F.col("log_share")).alias("zlog"),
                F.max(F.exp((F.col("exponent") - 1) * F.col("log_share"))).alias("most"),
                F.min(F.exp((F.col("exponent") - 1) * F.col("log_share"))).alias("least"),
            )
            .orderBy("exponent").collect()
        )
        true = [x["exponent"] for x in figures if holds(x)]
        if rising:
            high = min(true, default=high)
            low = max((x for x in grid if x < high), default=low)
        else:
            low = max(true, default=low)
            high = min((x for x in grid if x > low), default=high)
    return round((low + high) / 2, 8)


def source_weights(docs: DataFrame, spec: Mix = Mix()) -> tuple[DataFrame, DataFrame, float]:
    """(documents with tokens, table of sources with weight and budget, exponent).

    Tokens are runs of other than white space. A null source is a source of its own. Sources without
    any token have no share and are left out.
    """
    counted = pick(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        F.substring(F.md5("text"), 1, 16).alias("digest"),
    )
    counted = materialise(counted.where("n_tokens > 0"), "mix-tokens")
    totals = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    all_tokens = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    tokens, n = float(all_tokens[0] or 0), all_tokens[1]
    shares = materialise(
        totals.withColumn("log_share", F.log(F.col("tokens") / F.lit(tokens or 1.0))), "mix-sources"
    )
    exponent = 1.0
    if n > 1:
        if spec.entropy is not None:
            aim = spec.entropy * math.log(n)
            exponent = _bisect(shares, lambda x: math.log(x["z"]) - x["zlog"] / x["z"] >= aim, rising=False)
        budget = spec.budget

        def in_limit(x):
            scale = budget / tokens / x["z"] if budget is not None else 1 / x["least"]
            return x["most"] * scale <= spec.repetitions

        limit = _bisect(shares, in_limit, rising=True)
        exponent = limit if spec.entropy is None else max(exponent, limit)
    powered = shares.withColumn("power", F.exp(F.lit(exponent) * F.col("log_share")))
    figures = powered.agg(F.sum("power"), F.min(F.col("power") / F.col("tokens"))).first()
    z = figures[0] or 1.0
    total = spec.budget if spec.budget is not None else int(round(z / figures[1])) if figures[1] else 0
    weighted = powered.select(
        "source", "tokens", (F.col("power") / F.lit(z)).alias("weight"),
        F.round(F.col("power") / F.lit(z) * F.lit(float(total))).cast("long").alias("budget"),
    )
    return counted, materialise(weighted, "mix-weights"), exponent


def mixture(docs: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """The schedule: (doc_id, source, pass, block, place, n_tokens, weight, exponent), one row per use.

    A source's documents are permuted anew in every pass; as many passes as its budget fills, the last
    one cut where the budget ends. A document that straddles the end is still used. ``place`` is the
    number of tokens of its source used before, as a share of the source's budget; the block is that
    share in ``blocks`` parts, so each block holds the sources at their weights. Within a block, order
    by ``shuffle``. Documents without tokens use no budget and are not scheduled; a repeated row is a
    document of its own.

    The running sums are two-level: sums of hash ranges per source and pass are added up (at most
    ``BUCKETS`` rows each), the rows of a range by a window in it. A source with a third of all rows is
    so in 4,096 windows. A row's place among them hangs on its doc_id and its text, so rows that share an
    id (or have none) spread as well; only rows equal in both stay side by side.
    """
    counted, weights, exponent = source_weights(docs, spec)
    passes = F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("tokens"))).cast("int")
    sources = weights.where("budget > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    used = counted.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(
        weights.where("budget > 0").select(
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("s"), passes.alias("passes")
        ), "s",
    ).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    used = used.withColumn(
        "shuffle", F.md5(F.concat_ws(":", F.lit(str(spec.seed)), "pass", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest"))
    ).withColumn("bucket", F.substring("shuffle", 1, 3))
    keys = ["s", "pass", "bucket"]
    sums = used.groupBy(*keys).agg(F.sum("n_tokens").alias("sum"))
    before = Window.partitionBy("s", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    facts = sources.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("s"), "pass",
        (F.col("pass") * F.col("tokens")).alias("earlier"), F.col("budget").alias("whole"), "weight",
    )
    offsets = sums.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).join(facts, ["s", "pass"])
    inside = Window.partitionBy(*keys).orderBy("shuffle", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        used.join(offsets.drop("sum"), keys)
        .withColumn("done", F.col("earlier") + F.col("offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("done < whole")
    )
    return placed.select(
        "doc_id", "source", "pass",
        F.floor(F.col("done") * spec.blocks / F.col("whole")).cast("int").alias("block"),
        F.col("done").alias("place"), "shuffle", "n_tokens",
        F.round("weight", 9).alias("weight"), F.round(F.lit(exponent), 6).alias("exponent"),
    )


def oracle(spec: Mix) -> str:
    """The same in DuckDB: the exponent by 60 bisection steps over the sources of ``documents``."""
    return rf"""
WITH RECURSIVE counted AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
           substr(md5(text), 1, 16) AS digest FROM documents
), used AS (SELECT * FROM counted WHERE n_tokens > 0),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM used GROUP BY source),
shares AS (SELECT source, tokens, ln(tokens / CAST(sum(tokens) OVER () AS DOUBLE)) AS ls FROM totals),
entropy_steps(i, lo, hi) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
    FROM (SELECT i, lo, hi, (
        SELECT ln(sum(exp(e.lo / 2 * ls + e.hi / 2 * ls)))
             - sum(exp((e.lo + e.hi) / 2 * ls) * (e.lo + e.hi) / 2 * ls) / sum(exp((e.lo + e.hi) / 2 * ls))
             >= {spec.entropy} * ln(count(*)) FROM shares) AS ok
        FROM entropy_steps e WHERE i < 50)
), limit_steps(i, lo, hi) AS (
    SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
    UNION ALL
    SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
    FROM (SELECT i, lo, hi, (
        SELECT max(exp(((l.lo + l.hi) / 2 - 1) * ls)) / min(exp(((l.lo + l.hi) / 2 - 1) * ls)) <= {spec.repetitions}
        FROM shares) AS ok
        FROM limit_steps l WHERE i < 50)
), found AS (
    SELECT greatest(max(e.lo), (SELECT min(hi) FROM limit_steps)) AS x FROM entropy_steps e
), powered AS (
    SELECT source, tokens, exp(x * ls) AS p, x FROM shares, (SELECT round(x, 8) AS x FROM found)
), weighted AS (
    SELECT source, tokens, x, p / sum(p) OVER () AS weight,
           CAST(round(p / sum(p) OVER () * round(sum(p) OVER () / min(p / tokens) OVER ())) AS BIGINT) AS budget
    FROM powered
), uses AS (
    SELECT u.doc_id, u.source, r.pass, u.n_tokens, w.weight, w.x, w.budget, w.tokens,
           md5('{spec.seed}:' || r.pass || ':' || coalesce(CAST(u.doc_id AS VARCHAR), '') || ':' || u.digest) AS shuffle
    FROM used u JOIN weighted w ON u.source IS NOT DISTINCT FROM w.source
    JOIN (SELECT CAST(range AS INTEGER) AS pass FROM range(64)) r
      ON r.pass < greatest(1, ceil(w.budget / CAST(w.tokens AS DOUBLE)))
), placed AS (
    SELECT *, CAST(pass * tokens + coalesce(sum(n_tokens) OVER (
        PARTITION BY source, pass ORDER BY shuffle, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done
    FROM uses
)
SELECT doc_id, source, pass, CAST(floor(done * {spec.blocks} / CAST(budget AS DOUBLE)) AS INTEGER) AS block, done AS place,
       shuffle, n_tokens, round(weight, 9) AS weight, round(x, 6) AS exponent
FROM placed WHERE done < budget
"""
