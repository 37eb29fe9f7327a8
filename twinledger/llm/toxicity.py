"""Toxicity: a classifier whose score may not depend on which group a sentence names."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import WORD_CACHE, map_batches, pick
from twinledger.llm.linear import Rows, evidence, fit, sigmoid

#: Words that name a group, by kind and language; a term is swapped within its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "trans"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)

FEATURES = 1 << 18
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicitySpec:
    """``labelled_rows`` bounds the labelled documents a model is fitted on (toxic and others up to half
    of it each, more if there are fewer of the other, chosen by hash). A feature ``deviations`` or more
    off the mean counts in full, others by the square of their part of that.
    """

    labelled_rows: int = 12_000
    counterfactual: float = 10.0
    toxic_weight: float = 3.0
    l2: float = 1e-4
    steps: int = 400
    deviations: float = 5.0
    seed: int = 11


def word_features(word: str) -> tuple[int, ...]:
    """A word and its first four and five characters, which hold its stem, hashed."""
    return tuple(
        xxhash.xxh3_64_intdigest(mark + part.encode("utf-8", "surrogatepass")) % FEATURES
        for mark, part in ((b"w", word), (b"4", word[:4]), (b"5", word[:5]))
    )


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swapped(words: set[str]) -> set[str] | None:
    """The words with every identity term replaced by the next one of its kind; None if there is none."""
    following = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
    if not any(w in following for w in words):
        return None
    return {following.get(w, w) for w in words}


def _extract(batches):
    for batch in batches:
        rows, twins = [], []
        for text in batch.column(0):
            words = _words(text.as_py() or "")
            other = swapped(words)
            rows.append(np.array(sorted(f for w in words for f in word_features(w)), dtype=np.int32))
            twins.append(None if other is None else np.array(
                sorted(f for w in other for f in word_features(w)), dtype=np.int32
            ))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, type=kind), pa.array(twins, type=kind), batch.column(1)],
            names=["features", "twin", "label"],
        )


def train(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> tuple[np.ndarray, float]:
    """Fit on documents (doc_id, text) that labels (doc_id, toxic) name; the sample is broadcast by its bound.

    Each sampled text with an identity term gets a twin in which the terms are swapped; the squared
    change of the logit is a penalty beside the loss, so the terms themselves end up with equal weights
    and what is said about a group decides. Features are regularised by their evidence: the less their
    documents' share of toxic ones is off the mean, the smaller their value, so a long text's many rare
    words speak low, but those met in toxic documents only are heard from the first one on. Rare toxic
    documents are all sampled; the rows' weights make up for that. Of a repeated id one text, the least,
    is learnt from.
    """
    named = (
        pick(labels, "toxic", id="doc_id").where("id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("id").agg(F.max("toxic").cast("double").alias("label"))
    )
    n = {bool(r["bad"]): r["count"] for r in named.groupBy((F.col("label") > 0.5).alias("bad")).count().collect()}
    bad, rest = n.get(True, 0), n.get(False, 0)
    half = spec.labelled_rows // 2
    most = {True: min(bad, max(half, spec.labelled_rows - rest)), False: min(rest, max(half, spec.labelled_rows - bad))}
    part = {kind: n.get(kind, 0) / max(1, most[kind]) for kind in most}
    chosen = [
        named.where((F.col("label") > 0.5) == F.lit(kind))
        .orderBy(F.xxhash64(F.lit(spec.seed), "id"), "id").limit(most[kind])
        for kind in most
    ]
    sample = chosen[0].union(chosen[1])
    rows = (
        pick(docs, "text", id="doc_id").join(F.broadcast(sample), "id")
        .groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .select("text", "label").transform(map_batches, _extract, "features array<int>, twin array<int>, label double")
        .toArrow()
    )
    features = [np.asarray(x.values) for x in _lists(rows.column("features"))]
    twins = [(i, x.values.to_numpy()) for i, x in enumerate(_lists(rows.column("twin"))) if x.is_valid]
    labels_ = rows.column("label").to_numpy()
    seen = evidence(features, labels_, FEATURES)
    return fit(
        Rows.of(features), labels_, FEATURES, 0.0, spec.l2, spec.steps,
        weights=(1 + (spec.toxic_weight - 1) * labels_) * np.where(labels_ > 0.5, part[True], part[False]),
        active=seen > 0, scale=np.minimum(1.0, seen / spec.deviations) ** 2,
        twins=(np.array([i for i, _ in twins], dtype=np.int64), Rows.of([x for _, x in twins])),
        twin_penalty=spec.counterfactual,
    )


def _lists(column):
    return [x for chunk in column.chunks for x in chunk]


def _score(weights: np.ndarray, bias: float):
    weights = weights.astype(np.float32)

    class Shares(dict):
        def __missing__(self, word):
            value = float(sum(weights[f] for f in word_features(word)))
            if len(self) < WORD_CACHE:
                self[word] = value
            return value

    def run(batches):
        shares = Shares()
        for batch in batches:
            totals = [
                sum(map(shares.__getitem__, sorted(_words(text.as_py() or "")))) + bias
                for text in batch.column(batch.num_columns - 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sigmoid(np.array(totals, dtype=np.float64)))],
                names=[*batch.schema.names[:-1], "score"],
            )

    return run


def toxicity_scores(
    docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """(the columns to keep, score) per row: a map over the texts, with the 2^18 weights in the task.

    Null and empty texts have no words and get the score of the bias alone; a long text's distinct
    words all count, once each.
    """
    base = pick(docs, *keep, _scored="text")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in base.dtypes[:-1])
    return base.transform(map_batches, _score(*model), f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec(), folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learnt from labels of other folds only.

    A row is held out if crc32 of its id as text is divisible by ``folds``; a null id is not held out.
    Without any labels all scores are 0.5.
    """
    learnt = pick(labels, "doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    scored = toxicity_scores(docs, train(docs, learnt, spec))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
