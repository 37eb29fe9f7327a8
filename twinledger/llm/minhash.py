"""MinHash near-dedup: universal hash minima, banding, verification on full sets, components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import WordHashes, components, map_batches, mixed, pick, sized_join
from twinledger.session import materialise

BLOCK = 256
"""Documents of one group that are compared with as many others in one task."""

HASH_CHUNK = 4096
"""Shingles hashed at once; longer sets are folded chunk by chunk."""


@dataclass(frozen=True)
class NearDuplicates:
    """How alike two documents must be. ``rows`` x ``bands`` minima are kept per document.

    With 5 rows and 26 bands a pair of similarity 0.8 shares no band with probability 3e-5, one of
    0.85 with 3e-7. ``percent`` is the least similarity that links, in hundredths.
    """

    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 26
    seed: int = 1


def shingle_set(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of the whole if it has fewer words.

    Words are runs of other than space and \\x09-\\x0D; only A-Z are lower-cased.
    """
    found = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(found):
        return found
    width = min(words, len(found))
    state = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for at in range(width):
        state = mixed(state * np.uint64(0x9E3779B97F4A7C15) + found[at : at + len(state)])
    return np.unique(state)


def _parameters(spec: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(spec.seed).integers(0, 2**32, (2, spec.rows * spec.bands), dtype=np.uint64)
    return (drawn[0] | np.uint64(1)).astype(np.uint32)[:, None], drawn[1].astype(np.uint32)[:, None]


def minima(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The least value of each multiply-shift hash over a set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), HASH_CHUNK):
        least = np.minimum(least, (short[None, start : start + HASH_CHUNK] * factor + shift).min(axis=1))
    return least


_SIGNED = pa.schema([
    ("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
    ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
])
_SETS = pa.schema([("id", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sign(spec: NearDuplicates):
    def run(batches):
        factor, shift = _parameters(spec)
        hashes = WordHashes()
        for batch in batches:
            ids, sizes, keys, bands, signatures = [], [], [], [], []
            for id_, text in zip(batch.column(0), batch.column(1)):
                found = shingle_set(text.as_py() or "", spec.words, hashes)
                ids.append(id_.as_py())
                sizes.append(len(found))
                if not len(found):
                    keys.append(None)
                    bands.append(None)
                    signatures.append(None)
                    continue
                least = minima(found, factor, shift)
                band = np.arange(spec.bands, dtype=np.uint64)
                for column in least.astype(np.uint64).reshape(spec.bands, spec.rows).T:
                    band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + column)
                keys.append(_set_key(found))
                bands.append(band.view(np.int64))
                signatures.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip((ids, sizes, keys, bands, signatures), _SIGNED)],
                schema=_SIGNED,
            )

    return run


def _sets(spec: NearDuplicates):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t.as_py() or "", spec.words, hashes).view(np.int64) for t in batch.column(1)]
            keys = pa.array([_set_key(f) for f in found], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), keys, pa.array(found, type=_SETS.field(2).type)], schema=_SETS
            )

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, by their full intersection."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(spec: NearDuplicates):
    """Links found between two blocks of one group, no more than a spanning forest of them.

    A pair is verified on its full sets unless its signatures differ too much (over five standard
    deviations) or the pair hangs together already.
    """
    slots = spec.rows * spec.bands
    share = spec.percent / 100
    least = slots * share - 5 * (slots * share * (1 - share)) ** 0.5

    def run(rows):
        ids, parts = rows["id"].to_numpy(), rows["part"].tolist()
        sets = [np.asarray(s) for s in rows["shingles"]]
        sign = np.stack([np.frombuffer(s, dtype=np.uint8) for s in rows["signature"]])
        stray = rows["stray"].to_numpy()
        others = np.flatnonzero(~stray)
        parent = {c: c for c in parts}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for i in np.flatnonzero(stray):
            for j in others[(sign[others] == sign[i]).sum(axis=1) >= least]:
                if root(parts[i]) != root(parts[j]) and alike(sets[i], sets[j], spec.percent):
                    parent[root(parts[i])] = root(parts[j])
                    yield ids[i], ids[j]

    def grouped(block):
        found = list(run(block.to_pandas()))
        return pa.table({
            "a": pa.array([a for a, _ in found], type=pa.int64()),
            "b": pa.array([b for _, b in found], type=pa.int64()),
        })

    return grouped


def _linked(a: str, b: str, percent: int):
    both = F.size(F.array_intersect(a, b))
    return (100 * both) >= percent * (F.size(a) + F.size(b) - both)


def near_duplicates(docs: DataFrame, spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    1. One pass over the texts: set size, a 128-bit key of the set, minima and band keys. Equal sets
       are one numbered class from here on, however many copies there are; a document id that stands
       for several texts is in as many classes.
    2. Classes that share a band key hang on the band's least id; the components of that are the
       candidate groups, and only their texts are read again for the full sets.
    3. In each group the most central class (the one whose bands are met most) is compared with all
       others on full sets, by an equi join that splits if a group is hot.
    4. Members not alike to it (strays) are compared with the whole group in blocks of ``BLOCK``:
       signatures first, then full sets, and only links that join two parts leave a task.
    5. Links become components by alternating large-star and small-star.

    No pair is capped: steps 3 and 4 reach each pair of a group of which one is a stray; any other two
    are both linked with the centre. Null and empty texts have no set and link with nothing; rows of
    a null doc_id likewise (component null, kept). Repeated rows come back as often as given.
    """
    spark = docs.sparkSession
    schema = "id long, n_shingles long, set_key binary, bands array<long>, signature binary"
    signed = materialise(pick(docs, "doc_id", "text").transform(map_batches, _sign(spec), schema), "minhash")
    usable = signed.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = materialise(
        usable.groupBy("set_key").agg(F.min("id").alias("rep")).withColumn("cls", F.monotonically_increasing_id()),
        "minhash-classes",
    )
    banded = (
        usable.join(classes.withColumnRenamed("rep", "id"), ["id", "set_key"])
        .select(F.col("cls").alias("id"), F.explode("bands").alias("band"))
    )
    shared = materialise(
        banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1"),
        "minhash-bands",
    )
    met = materialise(sized_join(banded, shared, "band", "inner").select("id", "n", "least"), "minhash-met")
    groups = components(met.select(F.col("id").alias("a"), F.col("least").alias("b")), "minhash-groups")
    weight = met.groupBy("id").agg(F.sum("n").alias("met"))
    members = materialise(
        groups.join(weight, "id").select("id", F.col("component_id").alias("grp"), "met"), "minhash-members"
    )
    centres = members.groupBy("grp").agg(
        F.max(F.struct("met", (-F.col("id")).alias("id"))).alias("top"), F.count(F.lit(1)).alias("n")
    ).select("grp", (-F.col("top.id")).alias("centre"), "n")
    members = materialise(
        members.join(centres, "grp").select(F.col("id").alias("cls"), "grp", "centre", "n")
        .join(classes.select("cls", F.col("rep").alias("id"), "set_key"), "cls"),
        "minhash-centred",
    )

    texts = sized_join(
        pick(docs, "text", id="doc_id"), members, "id", "left_semi"
    ).transform(map_batches, _sets(spec), "id long, set_key binary, shingles array<long>")
    sets = materialise(
        sized_join(texts, members, ["id", "set_key"], "inner").dropDuplicates(["cls"])
        .select(F.col("cls").alias("id"), "grp", "centre", "n", "set_key", "shingles"),
        "minhash-sets",
    )
    hubs = sets.where("id = centre").select("centre", F.col("shingles").alias("hub"))
    judged = materialise(
        sets.where("id <> centre").join(hubs, "centre")
        .select("id", "centre", "grp", "n", _linked("shingles", "hub", spec.percent).alias("near")),
        "minhash-judged",
    )
    starred = judged.where("near").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    links = starred.union(_stray_links(spec, signed, sets, judged))
    found = materialise(components(links, "minhash"), "minhash-components")

    found = found.select(F.col("id").alias("cls"), F.col("component_id").alias("root"))
    least = found.join(classes, "cls").groupBy("root").agg(F.min("rep").alias("component_id"))
    reps_of = classes.join(found.join(least, "root").drop("root"), "cls", "left").select(
        "set_key", F.coalesce("component_id", "rep").alias("component_id")
    )
    return (
        signed.select("id", "n_shingles", "set_key")
        .join(reps_of, "set_key", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _stray_links(spec, signed: DataFrame, sets: DataFrame, judged: DataFrame) -> DataFrame:
    """Step 4: strays against their whole group, block by block."""
    strays = judged.where("NOT near").groupBy("grp").agg(F.count(F.lit(1)).alias("n_stray"), F.max("n").alias("n"))
    strays = materialise(
        strays.where("n > 2").select(
            "grp",
            F.ceil(F.col("n_stray") / BLOCK).cast("int").alias("stray_blocks"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("all_blocks"),
        ),
        "minhash-strays",
    )
    near = judged.where("near").select("id", F.lit(True).alias("near"))
    rows = (
        sized_join(sets, strays, "grp", "inner")
        .join(near, "id", "left")
        .withColumn("stray", F.col("near").isNull() & (F.col("id") != F.col("centre")))
        .withColumn("part", F.when(F.col("stray"), F.col("id")).otherwise(F.col("centre")))
    )
    signatures = signed.select("set_key", "signature").where("set_key IS NOT NULL").dropDuplicates(["set_key"])
    rows = rows.join(signatures, "set_key")
    columns = ["id", "grp", "shingles", "signature", "part"]
    spread = F.xxhash64("id")
    as_stray = rows.where("stray").select(
        *columns, F.lit(True).alias("stray"),
        F.pmod(spread, "stray_blocks").cast("int").alias("left"),
        F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("right"),
    )
    as_other = rows.select(
        *columns, F.lit(False).alias("stray"),
        F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("left"),
        F.pmod(spread, "all_blocks").cast("int").alias("right"),
    )
    return as_stray.union(as_other).groupBy("grp", "left", "right").applyInArrow(
        _block_links(spec), "a long, b long"
    )
