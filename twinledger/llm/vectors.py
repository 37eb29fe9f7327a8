"""Embedding near-dedup by sorted projection passes.

Vectors are ordered lexicographically by concatenated random hyperplane hashes, once per pass with
other hyperplanes; each is compared with a bounded window of its successors. The hashes are taken from
the mean of the label, and the number of passes follows from the label's rows and spread. What the passes
find is verified on the vectors, united, and the links within the components are counted in full.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import components, pick, sized_join
from twinledger.session import materialise

BITS = 64
"""Hash bits of a pass; they are the sort key, and the window compares them before any vector."""

ROWS_PER_RANGE = 20_000
"""Sorted rows of one range partition."""


@dataclass(frozen=True)
class VectorLinks:
    """At least ``passes`` orders with ``window`` successors each, as many as make the chance to miss a
    pair that lies just at the threshold ``miss`` at most.

    A pair of cosine 0.98 whose label is spread round the origin differs in a hash bit with probability
    0.064; less its mean, a label of mean cosine 0.7 makes that 0.12, one of 0.9 makes it 0.2. Two such
    vectors among n meet in one pass if about log2(n / window) leading bits agree: 16 passes do for
    n = 60,000 round the origin, 49 for 10^6 rows of mean cosine 0.7. ``slack`` is the number of standard
    deviations by which the differing bits of two sketches may exceed their mean at the threshold before
    a window pair is passed over.
    """

    cosine: float = 0.98
    passes: int = 16
    window: int = 12
    miss: float = 0.001
    slack: float = 5.0
    block: int = 512
    seed: int = 7

    def most_bits(self) -> int:
        share = float(np.arccos(self.cosine) / np.pi)
        return int(np.ceil(BITS * share + self.slack * (BITS * share * (1 - share)) ** 0.5))

    def passes_for(self, n: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Passes for labels of ``n`` unit vectors with mean squared distance ``spread`` from their mean.

        Below twice the squared distance of the threshold most pairs of a label link, so its vectors
        hang together whichever are met; a smaller spread asks for no more passes than that one.
        """
        spread = np.maximum(spread, 2 * (1 - self.cosine))
        differ = np.arccos(1 - (1 - self.cosine) / spread) / np.pi
        met = (1 - differ) ** np.log2(np.maximum(n / self.window, 1.0))
        needed = np.log(self.miss) / np.log1p(-np.minimum(met, 1 - 1e-9))
        return np.maximum(np.ceil(needed), self.passes).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix in double precision, each scaled by the power of two that brings
    its largest component near one: cosines stay as they are, and no square over- or underflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _unit(column: pa.Array) -> np.ndarray:
    rows = _matrix(column)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_width(batch: pa.RecordBatch, at: int):
    """The rows of a batch by the length of the lists in column ``at``."""
    sizes = pa.compute.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        yield width, batch.filter(pa.array(sizes == width))


def _usable(column):
    """Neither null nor zero, and no component null or not finite."""
    value = F.col(column)
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return value.isNotNull() & ~odd & F.exists(value, lambda x: x != 0)


_SUMS = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("sum", pa.list_(pa.float64()))])


def _sum_up(batches):
    """Numbers and sums of the unit vectors of each group in a batch."""
    for batch in batches:
        for _, part in _by_width(batch, 1):
            groups, at = np.unique(part.column(0).to_numpy(), return_inverse=True)
            sums = np.zeros((len(groups), len(part.column(1)[0])))
            np.add.at(sums, at, _unit(part.column(1)))
            yield pa.RecordBatch.from_arrays([
                pa.array(groups), pa.array(np.bincount(at)), pa.array(list(sums), type=_SUMS.field(2).type),
            ], schema=_SUMS)


_CENTRES = pa.schema([("grp", pa.int64()), ("mean", pa.list_(pa.float64())), ("passes", pa.int32())])


def _plan(spec: VectorLinks):
    """The passes that each group needs, of (grp, n, mean)."""

    def run(batches):
        for batch in batches:
            norms = np.array([np.square(m.values.to_numpy()).sum() for m in batch.column(2)])
            passes = spec.passes_for(batch.column(1).to_numpy(), 1 - norms)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(passes)], schema=_CENTRES
            )

    return run


def _centres(classes: DataFrame, spec: VectorLinks) -> DataFrame:
    """(grp, mean, passes): one row per label and vector length, summed by component before a shuffle."""
    sums = classes.select("grp", "vector").mapInArrow(_sum_up, "grp long, n long, sum array<double>")
    means = (
        sums.select("grp", "n", F.posexplode("sum")).groupBy("grp", "pos")
        .agg(F.sum("n").alias("n"), (F.sum("col") / F.sum("n")).alias("m"))
        .groupBy("grp").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("m"))
        .select("grp", "n", F.col("m.m").alias("mean"))
    )
    return materialise(means.mapInArrow(_plan(spec), "grp long, mean array<double>, passes int"), "vector-centres")


_KEYS = pa.schema([
    ("id", pa.int64()), ("grp", pa.int64()), ("pass", pa.int32()), ("key", pa.int64()), ("sketch", pa.int64()),
])


def hash_bits(vectors: np.ndarray, seed: int, number: int) -> np.ndarray:
    """The signs of 64 random projections, most significant first."""
    plane = np.random.default_rng([seed, number]).standard_normal((vectors.shape[1], BITS))
    return np.packbits(vectors @ plane > 0, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def _project(spec: VectorLinks):
    """Hash keys of every pass that a row's group needs, from its mean, and a sketch of the row itself."""

    def run(batches):
        for batch in batches:
            for _, part in _by_width(batch, 2):
                vectors = _unit(part.column(2))
                means = np.stack([m.values.to_numpy() for m in part.column(3)])
                passes = part.column(4).to_numpy()
                ids, groups = part.column(0).to_numpy(), part.column(1).to_numpy()
                centred, sketch = vectors - means, hash_bits(vectors, spec.seed, 0)
                for number in range(passes.max()):
                    asked = passes > number
                    keys = hash_bits(centred[asked], spec.seed, number + 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[asked]), pa.array(groups[asked]),
                        pa.array(np.full(len(keys), number, dtype=np.int32)), pa.array(keys), pa.array(sketch[asked]),
                    ], schema=_KEYS)

    return run


def window_pairs(rows: dict[str, np.ndarray], window: int, most: int, fresh: int = 0, by: str = "key"):
    """Pairs of rows at most ``window`` apart, of one group and pass, that differ in few bits of ``by``.

    Rows before ``fresh`` were compared with each other already.
    """
    keys = rows[by].view(np.uint64)
    for step in range(1, min(window, len(keys) - 1) + 1):
        start = max(0, fresh - step)
        near = np.bitwise_count(keys[start:-step] ^ keys[start + step :]) <= most
        near &= rows["grp"][start:-step] == rows["grp"][start + step :]
        near &= rows["pass"][start:-step] == rows["pass"][start + step :]
        yield rows["id"][start:-step][near], rows["id"][start + step :][near]


_FOUND = "a long, b long, border long, tail boolean, grp long, pass int, key long, sketch long"


def _compare(spec: VectorLinks):
    """Window pairs of a sorted partition, and its first and last rows for the neighbours."""
    names = ("id", "grp", "pass", "key", "sketch")
    schema = pa.schema([
        ("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("tail", pa.bool_()),
        ("grp", pa.int64()), ("pass", pa.int32()), ("key", pa.int64()), ("sketch", pa.int64()),
    ])
    most = spec.most_bits()

    def pairs(a, b):
        empty = [pa.nulls(len(a), f.type) for f in list(schema)[2:]]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], schema=schema)

    def border(rows, at, tail):
        n = len(rows["id"])
        return pa.RecordBatch.from_arrays([
            pa.array(rows["id"]), pa.nulls(n, pa.int64()), pa.array(np.full(n, at, dtype=np.int64)),
            pa.array(np.full(n, tail)), pa.array(rows["grp"]), pa.array(rows["pass"]), pa.array(rows["key"]), pa.array(rows["sketch"]),
        ], schema=schema)

    def run(batches):
        last, number, head = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(5)[0].as_py()
            rows = {n: batch.column(i).to_numpy() for i, n in enumerate(names)}
            if head < spec.window:
                yield border({n: v[: spec.window - head] for n, v in rows.items()}, number - 1, False)
                head += len(rows["id"])
            fresh = 0
            if last is not None:
                fresh = len(last["id"])
                rows = {n: np.concatenate([last[n], v]) for n, v in rows.items()}
            for a, b in window_pairs(rows, spec.window, most, fresh, "sketch"):
                yield pairs(a, b)
            last = {n: v[-spec.window :] for n, v in rows.items()}
        if last is not None:
            yield border(last, number, True)

    return run


def _compare_border(spec: VectorLinks):
    """Pairs across the border of two range partitions."""
    most = spec.most_bits()

    def run(border):
        frame = border.to_pandas().sort_values(["tail", "pass", "grp", "key", "a"], ascending=[False, *[True] * 4])
        rows = {
            "id": frame["a"].to_numpy(), "grp": frame["grp"].to_numpy(),
            "pass": frame["pass"].to_numpy(), "sketch": frame["sketch"].to_numpy(np.int64),
        }
        found = list(window_pairs(rows, spec.window, most, int(frame["tail"].sum()), "sketch"))
        none = np.empty(0, dtype=np.int64)
        return pa.table({
            "a": np.concatenate([none, *(a for a, _ in found)]),
            "b": np.concatenate([none, *(b for _, b in found)]),
        })

    return run


def _verify(spec: VectorLinks):
    """Of (a, b, va, vb) the pairs that reach the cosine."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for _, part in _by_width(batch, 2):
                    a, b = _matrix(part.column(2)), _matrix(part.column(3))
                    cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                    yield part.filter(pa.array(cosine >= spec.cosine)).select(["a", "b"])

    return run


def _count(spec: VectorLinks):
    """Links between the vectors of the two sides of a block pair, as partial sums per vector."""

    def run(block):
        side = block.column("row_side").to_numpy(zero_copy_only=False)
        vectors = _unit(block.column("vector").combine_chunks())
        ids, copies = block.column("id").to_numpy(), block.column("copies").to_numpy()
        rows, others = np.flatnonzero(side), np.flatnonzero(~side)
        near = vectors[rows] @ vectors[others].T >= spec.cosine
        near |= ids[rows][:, None] == ids[others][None, :]
        return pa.table({"id": ids[rows], "n": near @ copies[others].astype(np.int64)})

    return run


def vector_links(
    vectors: DataFrame, spec: VectorLinks = VectorLinks(),
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Only vectors of one label (not null) and one length are compared. Null or zero vectors and such
    with a null or non-finite component link with nothing, nor do rows of a null id (component null).
    Equal vectors are one numbered class throughout, so copies in any number cost one row, and an id that
    stands for several vectors is in as many classes. A component id is the least id; repeated rows of an
    id and vector are one vector and come back as often as given.

    The sort key carries 32 bytes a vector and pass, not the vector. Rows are range partitioned by
    (pass, label, key, id), so no label and no common key fills a task. Within a component, counted in
    blocks of ``spec.block`` vectors, only sums per vector leave a task: all links are counted, whether
    a window met them or not. The work in a component is quadratic in its distinct vectors.
    """
    raw = pick(vectors, id=id_col, vector=vector_col, label=label_col)
    raw = raw.withColumn("vector", F.col("vector").cast("array<double>"))
    fit = _usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    keyed = raw.withColumn("key", F.when(fit, F.md5(F.concat_ws(
        ",", F.col("label").cast("string"), F.transform("vector", lambda x: (x + 0.0).cast("string"))
    ))))
    landed = materialise(keyed, "vectors")
    classes = materialise(
        landed.where("key IS NOT NULL").groupBy("key").agg(
            F.min("id").alias("rep"), F.countDistinct("id").alias("copies"),
            F.first("vector").alias("vector"),
            F.xxhash64(F.first("label"), F.size(F.first("vector"))).alias("grp"),
        ).withColumn("id", F.monotonically_increasing_id()),
        "vector-classes",
    )

    keys = materialise(
        sized_join(classes.select("id", "grp", "vector"), _centres(classes, spec), "grp", "inner")
        .select("id", "grp", "vector", "mean", "passes")
        .mapInArrow(_project(spec), "id long, grp long, pass int, key long, sketch long"),
        "vector-keys",
    )
    rows = keys.count()
    ordered = keys.repartitionByRange(
        max(1, -(-rows // ROWS_PER_RANGE)), "pass", "grp", "key", "id"
    ).sortWithinPartitions("pass", "grp", "key", "id")
    compared = materialise(
        ordered.select("id", "grp", "pass", "key", "sketch", F.spark_partition_id().cast("long").alias("at"))
        .mapInArrow(_compare(spec), _FOUND),
        "vector-windows",
    )
    across = compared.where("border IS NOT NULL").groupBy("border").applyInArrow(
        _compare_border(spec), "a long, b long"
    )
    pairs = compared.where("border IS NULL").select("a", "b").union(across)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    by_id = classes.select("id", "vector")
    links = (
        pairs.join(by_id.toDF("a", "va"), "a").join(by_id.toDF("b", "vb"), "b")
        .select("a", "b", "va", "vb").mapInArrow(_verify(spec), "a long, b long")
    )
    found = materialise(components(links, "vectors"), "vector-components")

    linked = classes.join(found, "id").select("id", "component_id", "copies", "vector")
    blocks = found.groupBy("component_id").agg(
        F.ceil(F.count(F.lit(1)) / spec.block).cast("int").alias("blocks")
    )
    linked = linked.join(blocks, "component_id").withColumn(
        "own", F.pmod(F.xxhash64("id"), "blocks").cast("int")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = linked.select(
        "component_id", "id", "copies", "vector", F.lit(True).alias("row_side"), F.col("own").alias("i"), each.alias("j")
    ).union(linked.select(
        "component_id", "id", "copies", "vector", F.lit(False), each, F.col("own")
    ))
    counts = (
        sides.groupBy("component_id", "i", "j").applyInArrow(_count(spec), "id long, n long")
        .groupBy("id").agg(F.sum("n").alias("n"))
    )
    found = found.select("id", F.col("component_id").alias("root"))
    least = found.join(classes.select("id", "rep"), "id").groupBy("root").agg(F.min("rep").alias("component_id"))
    reps = (
        classes.select("key", "id", "rep", "copies")
        .join(found.join(least, "root").drop("root"), "id", "left").join(counts, "id", "left")
        .select(
            "key",
            (F.coalesce("n", "copies") - 1).alias("n_links"),
            F.coalesce("component_id", "rep").alias("component_id"),
        )
    )
    return (
        landed.select("id", "key").join(reps, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
