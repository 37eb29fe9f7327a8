"""Packing documents into sequences: first-fit decreasing in randomised groups of documents.

Whole sequences of a long document go by themselves; what is left of each document is packed first-fit
decreasing, where a tournament tree of bin capacities names the leftmost bin with room. The bins that
stay open are then levelled: the emptiest ones are cut to fill the others.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, pick
from twinledger.llm.tokens import PRE_TOKEN
from twinledger.session import materialise

COMMON_TEXT = re.compile("[\x00-ɏ‐-‧€]*", re.DOTALL)
"""Texts whose letter classes every Unicode version agrees on; only these take the faster encoder."""


@dataclass(frozen=True)
class Packing:
    """Sequences of ``capacity`` tokens, groups of ``group_docs`` documents on average.

    ``end_id`` closes every document. ``tokenizer`` is the path of a ``tokenizers`` file that Spark can
    read; None is the installed 50k byte-level vocabulary.
    """

    capacity: int = 1024
    group_docs: int = 16_384
    end_id: int = 0
    seed: int = 3
    tokenizer: str | None = None


def read_tokenizer(spark: SparkSession, path: str | None = None) -> str:
    """The tokenizer file (a few MB), read by Spark and sent along with the tasks."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    source = f"file://{path}" if path.startswith("/") else path
    return bytes(spark.read.format("binaryFile").load(source).first()["content"]).decode()


def _printable(byte: int) -> bool:
    return 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174


class Encoder:
    """Ids of a text by ``tokenizers``, without added special tokens.

    Byte-level vocabularies without a normaliser have an equal encoder that is several times faster; it
    takes texts of ``COMMON_TEXT``. All others are encoded by ``tokenizers`` itself.
    """

    def __init__(self, definition: str):
        import tokenizers

        self.exact = tokenizers.Tokenizer.from_str(definition)
        self.fast = self._fast(json.loads(definition))

    @staticmethod
    def _fast(definition: dict):
        split = definition.get("pre_tokenizer") or {}
        model = definition["model"]
        plain = (
            not definition.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex")
            and not split.get("add_prefix_space") and model.get("type") == "BPE"
            and not model.get("ignore_merges") and not model.get("dropout")
        )
        if not plain:
            return None
        import tiktoken

        others = (b for b in range(256) if not _printable(b))
        shown = {chr(b): b for b in range(256) if _printable(b)}
        shown |= {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in definition["added_tokens"]}
        ranks = {bytes(map(shown.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
        encoding = tiktoken.Encoding("pack", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: encoding.encode(text, allowed_special="all", disallowed_special=())

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and COMMON_TEXT.fullmatch(text):
            return self.fast(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def planes(ids: np.ndarray) -> bytes:
    """Ids as all their lower halves, then all their upper ones, which compress to nothing."""
    return ids.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes()


def from_planes(stored) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(stored, dtype="<u2").reshape(2, -1).T).view("<u4").ravel()


def _encode(definition: str, end_id: int):
    def run(batches):
        encoder = Encoder(definition)
        for batch in batches:
            ids = [
                planes(np.array([*encoder(text or ""), end_id])) for text in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["row", "doc_id", "doc_tokens", "ids"],
            )

    return run


def tokenised(docs: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """(row, doc_id, doc_tokens, ids) of every row, written once; the ids as ``planes``."""
    spark = docs.sparkSession
    base = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = dict(base.dtypes)["doc_id"]
    definition = read_tokenizer(spark, spec.tokenizer)
    encoded = map_batches(
        base, _encode(definition, spec.end_id), f"row long, doc_id {kind}, doc_tokens long, ids binary"
    )
    return materialise(encoded, "pack-tokens")


class CapacityTree:
    """A tournament of bins by what room they have left; each node knows the most below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Take ``need`` from the leftmost bin that has it; the bin's number."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        placed = node - self.leaves
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return placed


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; larger ones are placed first, equal ones in the order given."""
    tree = CapacityTree(len(sizes), capacity)
    bins = np.zeros(len(sizes), dtype=np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        bins[item] = tree.place(int(sizes[item]))
    return bins


def _level(open_bins: list[list[tuple]], capacity: int) -> list[list[tuple]]:
    """Fill the fullest open bins with cuts of the emptiest; what remains in powers of two.

    A piece is (document, start, length). No token is left out and no padding is left: the remainder
    of fewer than ``capacity`` tokens becomes one sequence per bit of its size.
    """
    fill = [sum(piece[2] for piece in pieces) for pieces in open_bins]
    order = sorted(range(len(open_bins)), key=lambda i: (-fill[i], i))
    total = sum(fill)
    full = total // capacity
    spare = [piece for i in order[full:] for piece in open_bins[i]][::-1]

    def take(need: int) -> list[tuple]:
        taken = []
        while need:
            doc, start, length = spare.pop()
            part = min(length, need)
            taken.append((doc, start, part))
            if part < length:
                spare.append((doc, start + part, length - part))
            need -= part
        return taken

    levelled = [open_bins[i] + take(capacity - fill[i]) for i in order[:full]]
    rest = total - full * capacity
    sizes = [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]
    return levelled + [take(size) for size in sizes]


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pieces of one group's documents as arrays (document, start, length, sequence, offset).

    Sequences are numbered from 0 within the group; pieces are in order of document and start.
    """
    whole = sizes // capacity
    docs = np.repeat(np.arange(len(sizes)), whole)
    first = np.cumsum(whole) - whole
    starts = (np.arange(len(docs)) - first[docs]) * capacity
    parts = [(docs, starts, np.full(len(docs), capacity), np.arange(len(docs)), np.zeros(len(docs), dtype=np.int64))]
    tails = np.flatnonzero(sizes % capacity)
    left = sizes[tails] % capacity
    bins: dict[int, list[tuple]] = {}
    room: dict[int, int] = {}
    for tail, size, at in zip(tails.tolist(), left.tolist(), first_fit_decreasing(left, capacity).tolist()):
        bins.setdefault(at, []).append((tail, int(whole[tail]) * capacity, size))
        room[at] = room.get(at, capacity) - size
    done = [pieces for at, pieces in bins.items() if not room[at]]
    number = len(docs)
    rows = []
    for pieces in done + _level([pieces for at, pieces in bins.items() if room[at]], capacity):
        offset = 0
        for doc, start, length in pieces:
            rows.append((doc, start, length, number, offset))
            offset += length
        number += 1
    parts.append(tuple(np.array(rows, dtype=np.int64).reshape(-1, 5).T))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


_PLACED = "row long, start array<long>, length array<long>, sequence_id array<long>, offset array<long>"


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        sizes = group.column("doc_tokens").to_numpy().astype(np.int64)
        docs, *columns = pack_group(sizes, capacity)
        columns[2] = columns[2] + (group.column("grp")[0].as_py() << 32)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(sizes)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]
        return pa.Table.from_arrays(
            [group.column("row"), *lists], names=["row", "start", "length", "sequence_id", "offset"]
        )

    return run


def _cut(names):
    """Rows with lists of pieces as one row per piece with its ids."""

    def run(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(3, 7)]
            pieces = [c.flatten() for c in lists]
            parent = pa.compute.list_parent_indices(lists[0])
            starts, lengths = (pieces[i].to_numpy() for i in range(2))
            texts = batch.column(2)
            cut, seen, ids = [], None, None
            for at, start, length in zip(parent.to_numpy().tolist(), starts.tolist(), lengths.tolist()):
                if at != seen:
                    seen, ids = at, from_planes(texts[at].as_buffer())
                cut.append(ids[start : start + length].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(parent), pieces[0], pieces[1], batch.column(1).take(parent),
                 pieces[2], pieces[3], pa.array(cut, pa.binary())], names=names,
            )

    return run


def pack(docs: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """Pieces: (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every document.

    ``ids`` are little-endian 32-bit integers.
    Each token lies in exactly one piece; offsets in a sequence are gapless from 0. A sequence holds
    ``capacity`` tokens, or a lesser power of two of which each group has one per size at most, so
    none needs padding. ``sequence_id`` is the group's number times 2^32 plus a number in the group.

    Every row is a document of its own, repeated rows and rows of a null doc_id too; a null or empty
    text has the end token alone. Other columns are ignored; an empty table gives an empty table.
    Groups are drawn by a hash of the written row, so copies and long documents spread evenly, and a
    lost task packs the same group again. Only sizes are grouped; ids meet their places by row.
    """
    written = tokenised(docs, spec)
    groups = max(1, round(written.count() / spec.group_docs))
    sizes = written.select(
        "row", "doc_tokens", F.pmod(F.xxhash64("row", F.lit(spec.seed)), F.lit(groups)).alias("grp")
    )
    placed = materialise(sizes.groupBy("grp").applyInArrow(_pack(spec.capacity), _PLACED), "pack-places")
    joined = written.join(placed, "row").select(
        "doc_id", "doc_tokens", "ids", "start", "length", "sequence_id", "offset"
    )
    kind = dict(written.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return map_batches(
        joined, _cut(names),
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, documents, ids): the sequences themselves, ready to be written."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.transform("parts", lambda p: p["doc_id"]).alias("documents"),
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )
