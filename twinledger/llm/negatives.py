"""Hard-negative mining with exact integer scores from Kronecker-packed products.

Several candidates' components, biased to be non-negative, lie in separated fields of one wide integer.
One multiplication by an anchor's component serves all of them; after the last component the fields are
unpacked to exact inner products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.common import pick
from twinledger.session import materialise

WORD_BITS = 63
"""Bits of a wide integer in machine words; scores that need more are packed in Python's integers."""

TILE_ANCHORS = 256
"""Anchors that are multiplied with a shard's candidates at once; their scores are all a task holds."""


@dataclass(frozen=True)
class HardNegatives:
    """Scores are inner products of ``floor(scale * component)``.

    An anchor's positives are its ``positives`` best rows of its own label; for each, the ``negatives``
    best rows of other labels whose score lies between ``low`` and ``high`` per cent of the positive's.
    ``shard_rows`` candidates are scored by one task against ``block_anchors`` anchors.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    shard_rows: int = 32_768
    block_anchors: int = 131_072


class PackedCandidates:
    """Candidates (rows by components, integers) packed for products with any anchors up to a size.

    A field has room for the greatest possible score on either side of zero: biased components are at
    most ``2 * bias``, so a sum over an anchor of absolute sum ``reach`` stays below ``2 * bias * reach``.
    ``shift`` makes every field's sum non-negative before it is unpacked, so fields can't borrow.
    """

    def __init__(self, rows: np.ndarray, reach: int):
        self.n = len(rows)
        self.bias = int(abs(rows).max()) if rows.size else 0
        self.shift = 2 * self.bias * reach + 1
        self.width = (2 * self.shift).bit_length()
        self.fields = max(1, WORD_BITS // self.width)
        kind = np.int64 if self.width <= WORD_BITS else object
        words = -(-self.n // self.fields)
        biased = np.zeros((words * self.fields, rows.shape[1]), dtype=kind)
        biased[: self.n] = rows.astype(kind) + self.bias
        biased = biased.reshape(words, self.fields, rows.shape[1])
        self.packed = np.zeros((rows.shape[1], words), dtype=kind)
        for field in range(self.fields):
            self.packed += biased[:, field].T << self.width * field
        self.start = sum(self.shift << self.width * field for field in range(self.fields))

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of every anchor with every candidate."""
        kind = self.packed.dtype
        if kind == object:
            sums = anchors.astype(object) @ self.packed + self.start
        else:
            sums = np.einsum("ad,dw->aw", anchors, self.packed) + self.start
        mask = (1 << self.width) - 1
        out = np.empty((len(anchors), sums.shape[1] * self.fields), dtype=kind)
        for field in range(self.fields):
            out[:, field :: self.fields] = (sums >> self.width * field) & mask
        own = self.shift + self.bias * anchors.astype(kind).sum(axis=1)
        return out[:, : self.n] - own[:, None]


def _usable(column: str) -> Column:
    """Not null, and no component null or not finite."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~odd


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * component)`` as a matrix; Python integers where 64 bits could overflow."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if not len(scaled) or abs(scaled).max() < 1 << 40:
        values = scaled.astype(np.int64)
    else:
        exact = (np.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in flat.tolist())
        values = np.array([int(x) for x in exact], dtype=object)
    return values.reshape(len(column), -1)


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of ``among``: by score, then smaller id (null last), then row."""
    if len(among) > k and scores.dtype != object:
        least = np.partition(scores[among], len(among) - k)[len(among) - k]
        among = among[scores[among] >= least]
    order = sorted(among.tolist(), key=lambda i: (-scores[i], ids[i], rows[i]))
    return np.array(order[:k], dtype=np.int64)


_NO_ID = np.iinfo(np.int64).max


class _Shard:
    """The candidates of one tile, in order of label."""

    def __init__(self, batches: list[pa.RecordBatch], scale: int):
        table = pa.Table.from_batches(batches).combine_chunks().sort_by("label")
        self.labels = table.column("label").to_numpy()
        self.rows = table.column("row").to_numpy()
        self.ids = table.column("vec_id").to_numpy()
        self.values = _integers(table.column("embedding").combine_chunks(), scale)
        self.reach, self.cached = -1, {}

    def packed(self, low: int, high: int, reach: int) -> PackedCandidates:
        if reach > self.reach:
            self.reach, self.cached = reach, {}
        if (low, high) not in self.cached:
            self.cached[low, high] = PackedCandidates(self.values[low:high], self.reach)
        return self.cached[low, high]


def _tiles(spec: HardNegatives, find, schema: pa.Schema):
    """Stream a sorted partition: a tile's candidates first, then its anchors, a bounded number at once."""

    def anchors_of(shard, batch):
        values = _integers(batch.column("embedding"), spec.scale)
        labels = batch.column("label").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        for start, end in zip(bounds, bounds[1:]):
            low, high = np.searchsorted(shard.labels, [labels[start], labels[start] + 1]).tolist()
            for at in range(start, end, TILE_ANCHORS):
                stop = min(end, at + TILE_ANCHORS)
                some = values[at:stop]
                reach = int(abs(some).sum(axis=1).max())
                yield from find(shard, low, high, reach, some, batch.slice(at, stop - at))

    def run(batches):
        tile, waiting, shard = None, [], None
        for batch in batches:
            keys = batch.column("tile").to_numpy()
            roles = batch.column("role").to_numpy()
            borders = np.flatnonzero((np.diff(keys) != 0) | (np.diff(roles) != 0)) + 1
            bounds = [0, *borders.tolist(), len(keys)]
            for start, end in zip(bounds, bounds[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if keys[start] != tile:
                    tile, waiting, shard = keys[start], [], None
                if roles[start] == 0:
                    waiting.append(part)
                elif waiting:
                    if shard is None:
                        shard = _Shard(waiting, spec.scale)
                    found = [row for rows in anchors_of(shard, part) for row in rows]
                    if found:
                        columns = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _fits(score) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"a score of {score} doesn't fit a long; scale the vectors down")
    return int(score)


def _positives(spec: HardNegatives):
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "row", "vec_id", "score")])

    def find(shard, low, high, reach, anchors, batch):
        if low == high:
            return
        scores = shard.packed(low, high, reach).scores(anchors)
        ids, rows = shard.ids[low:high], shard.rows[low:high]
        for own, line in zip(batch.column("row").to_pylist(), scores):
            among = np.flatnonzero(rows != own)
            best = _best(line, ids, rows, among, spec.positives)
            yield [(own, int(rows[i]), int(ids[i]), _fits(line[i])) for i in best]

    return _tiles(spec, find, schema)


def _negatives(spec: HardNegatives):
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "place", "row", "vec_id", "score")])

    def find(shard, low, high, reach, anchors, batch):
        if high - low == len(shard.rows):
            return
        scores = shard.packed(0, len(shard.rows), reach).scores(anchors)
        known = batch.column("positive_scores").to_pylist()
        for own, positives, line in zip(batch.column("row").to_pylist(), known, scores):
            out = []
            for place, positive in enumerate(positives):
                least, most = -(-spec.low * positive // 100), spec.high * positive // 100
                fits = (line >= least) & (line <= most)
                fits[low:high] = False
                best = _best(line, shard.ids, shard.rows, np.flatnonzero(fits), spec.negatives)
                out += [(own, place, int(shard.rows[i]), int(shard.ids[i]), _fits(line[i])) for i in best]
            yield out

    return _tiles(spec, find, schema)


def _dealt(candidates: DataFrame, anchors: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Candidates and anchors by tile: a shard of candidates with a block of anchors.

    Candidates are copied to each block and anchors to each shard; both numbers of rows of a tile are
    bounded on average, and which rows lie in a tile hangs on hashes alone, not on labels.
    """
    def spread(own, other, n_own, n_other, tile, role):
        placed = own.withColumn("own", F.pmod(F.xxhash64("row", F.lit(role)), F.lit(n_own)))
        copied = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)).cast("array<long>")))
        return copied.withColumn("tile", tile).withColumn("role", F.lit(role)).drop("own", "other")

    left = spread(candidates, anchors, shards, blocks, F.col("own") * blocks + F.col("other"), 0)
    right = spread(anchors, candidates, blocks, shards, F.col("other") * blocks + F.col("own"), 1)
    both = left.unionByName(right, allowMissingColumns=True)
    tiles = min(shards * blocks, 100_000)
    return both.repartition(tiles, "tile").sortWithinPartitions("tile", "role", "label")


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, spec: HardNegatives = HardNegatives()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id. Rows with a null
    label, a null vector or a component that is null or not finite take no part. Every row counts by
    itself: a repeated vec_id is another row, repeated anchors give their rows once each, and an anchor
    is no positive of itself but a copy of it is. A null vec_id can't be an anchor; among equal scores it
    comes last. Vectors of unlike length are not compared with each other. An empty table gives an empty
    one. Scores are exact at any magnitude; one beyond 64 bits in the result is an error.

    All anchors meet all candidates, in tiles of bounded size; a tile sends on at most ``positives`` rows
    per anchor in the first pass and ``negatives`` per positive in the second, before anything is ranked.
    """
    base = pick(vectors, "vec_id", "embedding", "label").where(F.col("label").isNotNull() & _usable("embedding"))
    rows = materialise(
        base.select(
            F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"),
            F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long"),
            F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.size("embedding").cast("long").alias("width"),
        ),
        "negatives-rows",
    )
    widths = [r["width"] for r in rows.where("anchor").select("width").distinct().orderBy("width").collect()]
    parts = [_of_width(rows.where(F.col("width") == width), spec) for width in widths]
    if not parts:
        return _result(rows.limit(0).selectExpr(
            "row AS anchor", "row AS place", "vec_id", "row AS score", "1 AS rank", "vec_id AS anchor_id",
            "vec_id AS positive_id", "row AS positive_score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _of_width(rows: DataFrame, spec: HardNegatives) -> DataFrame:
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    shards = max(-(-n // spec.shard_rows), min(64, -(-n // 2048)), 1)
    blocks = max(1, -(-n_anchors // spec.block_anchors))
    candidates = rows.select("row", F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "embedding", "label")
    anchors = rows.where("anchor").select("row", "vec_id", "embedding", "label")
    found = _dealt(candidates, anchors, shards, blocks).mapInArrow(
        _positives(spec), "anchor long, row long, vec_id long, score long"
    )
    positives = materialise(_top(found, ["anchor"], spec.positives), "negatives-positives")
    known = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = anchors.join(known, F.col("row") == F.col("anchor")).select(
        "row", "vec_id", "embedding", "label", F.col("p.score").alias("positive_scores")
    )
    found = _dealt(candidates, asked, shards, blocks).mapInArrow(
        _negatives(spec), "anchor long, place long, row long, vec_id long, score long"
    )
    ranked = _top(found, ["anchor", "place"], spec.negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    of = positives.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return _result(ranked.join(of, ["anchor", "place"]).join(names, "anchor"))


def _result(ranked: DataFrame) -> DataFrame:
    def known(name):
        return F.when(F.col(name) != _NO_ID, F.col(name))

    return ranked.select(
        "anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        known("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def moved_labels(vectors: DataFrame) -> DataFrame:
    """The same rows, a tenth-class label moved on by one where vec_id is divisible by 7."""
    return pick(vectors, "vec_id", "embedding", "label").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )


ORACLE = """
WITH usable AS (
    SELECT vec_id, embedding,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM usable
), scaled AS (
    SELECT vec_id, label, place, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
    FROM scaled a JOIN scaled b ON a.place = b.place AND a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0 GROUP BY ALL
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
