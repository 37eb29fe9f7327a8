"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only round edits."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import WORD_CACHE, map_batches, pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern that belongs to that vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LEAF = 32
"""Pre-tokens of a leaf when a tree is built; a leaf that edits fill beyond eight times that is split."""

CONTEXT = 2
"""Whole pre-tokens before an edit that are read again: where one ends hangs on the next one at most."""


class Counter(dict):
    """Tokens of a pre-token, kept for up to ``WORD_CACHE`` of them."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if b}
        self.encode = tiktoken.Encoding(
            "counter", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.pattern = regex.compile(PRE_TOKEN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < WORD_CACHE:
            self[piece] = n
        return n


@dataclass
class Tree:
    """Sums over pre-tokens in heap order: node i is the sum of nodes 2i and 2i + 1; leaves come last.

    ``sums`` has the rows characters, pre-tokens and tokens; node 1 is the document.
    """

    sums: np.ndarray

    @classmethod
    def of_leaves(cls, leaves: np.ndarray) -> Tree:
        width = 1 << max(0, leaves.shape[1] - 1).bit_length()
        sums = np.zeros((3, 2 * width), dtype=np.int64)
        sums[:, width : width + leaves.shape[1]] = leaves
        while width > 1:
            level = sums[:, width : 2 * width]
            sums[:, width // 2 : width] = level[:, 0::2] + level[:, 1::2]
            width //= 2
        return cls(sums)

    @classmethod
    def build(cls, text: str, counter: Counter) -> Tree:
        return cls.of_leaves(_leaves(counter.pattern.findall(text), counter))

    @property
    def width(self) -> int:
        return self.sums.shape[1] // 2

    @property
    def tokens(self) -> int:
        return int(self.sums[2, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; the last one at the end of the text."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.sums[0, 2 * node])
            if place < start + left or not self.sums[0, 2 * node + 1]:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.width, start

    def put(self, leaf: int, values) -> None:
        """Set a leaf and add up the nodes above it."""
        node = leaf + self.width
        self.sums[:, node] = values
        node //= 2
        while node:
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]
            node //= 2

    def edit(self, text: str, start: int, end: int, insert: str, counter: Counter) -> tuple[str, int]:
        """The text with ``text[start:end]`` replaced, and how many characters were encoded again.

        Reading starts at a leaf border at least ``CONTEXT`` pre-tokens before the edit and stops at the
        first old leaf border behind it that is a border of pre-tokens again: the pattern looks ahead
        only, so all that follows is as it was.
        """
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        changed = text[:start] + insert + text[end:]
        moved = len(changed) - len(text)
        first, begin = self.leaf_at(start)
        leaves = self.sums[:, self.width :]
        before = 0
        while first > 0 and before < CONTEXT:
            first -= 1
            begin -= int(leaves[0, first])
            before += int(leaves[1, first])
        last, border = first, begin
        pieces, place = [], begin
        for found in counter.pattern.finditer(changed, begin):
            while last < self.width and (border < end or border + moved < place):
                border += int(leaves[0, last])
                last += 1
            if border >= end and border + moved == place and place >= start + len(insert):
                break
            pieces.append(found.group())
            place = found.end()
        else:
            last = self.width
        fresh = np.array(
            [sum(map(len, pieces)), len(pieces), sum(map(counter.__getitem__, pieces))], dtype=np.int64
        )
        if len(pieces) > 8 * LEAF:
            parts = [leaves[:, :first], _leaves(pieces, counter), leaves[:, last:]]
            kept = np.concatenate(parts, axis=1)
            self.sums = Tree.of_leaves(kept[:, kept[0] > 0] if (kept[0] > 0).any() else kept[:, :1]).sums
        else:
            self.put(first, fresh)
            for leaf in range(first + 1, last):
                if leaves[0, leaf]:
                    self.put(leaf, 0)
        return changed, int(fresh[0])


def _leaves(pieces: list[str], counter: Counter) -> np.ndarray:
    if not pieces:
        return np.zeros((3, 1), dtype=np.int64)
    starts = np.arange(0, len(pieces), LEAF)
    chars = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    tokens = np.fromiter(map(counter.__getitem__, pieces), dtype=np.int64, count=len(pieces))
    sizes = np.diff(np.append(starts, len(pieces)))
    return np.stack([np.add.reduceat(chars, starts), sizes, np.add.reduceat(tokens, starts)])


_TREE = pa.list_(pa.int32())


def _pack(trees: list[Tree]) -> pa.Array:
    return pa.array([t.sums.astype(np.int32).ravel() for t in trees], type=_TREE)


def _build(vocabulary: bytes):
    def run(batches):
        counter = Counter(vocabulary)
        for batch in batches:
            trees = [Tree.build(t.as_py() or "", counter) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t.tokens for t in trees], type=pa.int64()), _pack(trees)],
                names=[*batch.schema.names, "n_tokens", "tree"],
            )

    return run


def _apply(vocabulary: bytes):
    def run(batches):
        counter = Counter(vocabulary)
        for batch in batches:
            texts, counts, again, trees = [], [], [], []
            for text, tree, edits in zip(batch.column("text"), batch.column("tree"), batch.column("edits")):
                body = text.as_py() or ""
                tree = Tree(np.asarray(tree.values).astype(np.int64).reshape(3, -1))
                read = 0
                for edit in edits.as_py() or ():
                    if edit is not None:
                        body, n = tree.edit(body, edit["start"] or 0, edit["end"] or 0, edit["insert"] or "", counter)
                        read += n
                texts.append(body)
                counts.append(tree.tokens)
                again.append(read)
                trees.append(tree)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), pa.array(texts, type=pa.string()),
                 pa.array(counts, type=pa.int64()), pa.array(again, type=pa.int64()), _pack(trees)],
                names=["doc_id", "n_tokens", "text", "n_tokens_edited", "n_reencoded", "tree"],
            )

    return run


def read_vocabulary(spark, path: str = VOCABULARY) -> bytes:
    """The vocabulary file (under 1 MB), read by Spark and sent along with the tasks."""
    return bytes(spark.read.format("binaryFile").load(f"file://{path}" if path.startswith("/") else path).first()["content"])


def count_tokens(docs: DataFrame, vocabulary: bytes) -> DataFrame:
    """``docs`` (doc_id, text, edits if there are any) with ``n_tokens`` and the document's ``tree``.

    A null or empty text has no tokens and a tree of one empty leaf. Rows are counted one by one, so
    repeated rows give the same figures; there is no shuffle.
    """
    chosen = ["doc_id", "text", *(["edits"] if "edits" in docs.columns else [])]
    base = pick(docs, *chosen)
    schema = ", ".join(f"{n} {t}" for n, t in base.dtypes)
    return base.transform(map_batches, _build(vocabulary), f"{schema}, n_tokens long, tree array<int>")


def apply_edits(counted: DataFrame, vocabulary: bytes) -> DataFrame:
    """(doc_id, n_tokens, text, n_tokens_edited, n_reencoded, tree) after ``edits``.

    ``edits`` is an array of (start, end, insert) in code points, applied one after another, each to the
    text that the former ones left; places outside the text are moved to its ends. Only pre-tokens
    round an edit are encoded again (``n_reencoded`` characters in all) and only sums above them change.
    """
    return counted.select("doc_id", "text", "edits", "n_tokens", "tree").transform(map_batches,
        _apply(vocabulary),
        "doc_id long, n_tokens long, text string, n_tokens_edited long, n_reencoded long, tree array<int>",
    )


def hashed_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with two edits each whose places follow from the id: 40 characters go, a mark comes in."""
    base = pick(docs, "doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    cut = F.pmod(F.crc32(name.cast("binary")), size).cast("int")
    mark = F.pmod(F.crc32(F.concat(F.lit("mark:"), name).cast("binary")), size).cast("int")
    return base.withColumn("edits", F.array(
        F.struct(cut.alias("start"), (cut + 40).alias("end"), F.lit("").alias("insert")),
        F.struct(mark.alias("start"), mark.alias("end"), F.lit(" [edited] ").alias("insert")),
    ))
