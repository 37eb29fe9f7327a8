"""Key search by a trigram index: postings narrow the rows, the scan's own filter decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.operators.align import ROW_ID
from twinledger.operators.report import filter_results

GRAM = 3
RAREST = 3
"""Postings that are intersected; the filter settles what the other trigrams would have told."""


def _postings(batches):
    """(gram, n, rows) of each batch: the rows whose text holds the gram, as row ids."""
    for batch in batches:
        filled = batch.filter(pc.fill_null(pc.greater_equal(pc.utf8_length(batch.column(1)), GRAM), False))
        if not filled.num_rows:
            continue
        lengths = pc.utf8_length(filled.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(filled.column(1).to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = owner[: -(GRAM - 1)] == owner[GRAM - 1 :]
        codes = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside]
        grams, place = np.unique(codes, return_inverse=True)
        pairs = np.unique(place * len(lengths) + owner[: -(GRAM - 1)][inside])
        counts = np.bincount(pairs // len(lengths), minlength=len(grams))
        rows = filled.column(0).take(pa.array(pairs % len(lengths)))
        texts = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams.tolist()]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows)],
            names=["gram", "n", "rows"],
        )


def write_key_index(results: DataFrame, path: str) -> DataFrame:
    """(gram, n, rows): per trigram lists of the rows that hold it, of all key texts.

    A list is made of one batch of rows where they lie, so nothing is shuffled and no trigram's list is
    whole in one place. Every file is in the order of trigrams, so a search reads the pages of its own.
    """
    keys = results.select(F.col(ROW_ID).cast("bigint").alias(ROW_ID), "key_values")
    postings = keys.mapInArrow(_postings, "gram string, n long, rows array<long>")
    postings.sortWithinPartitions("gram").write.parquet(path)
    return results.sparkSession.read.parquet(path)


def search_grams(search: str) -> list[str]:
    """Trigrams that every match of a pattern holds: those of its literal parts."""
    parts = re.split("[%_]", search)
    return sorted({part[i : i + GRAM] for part in parts for i in range(len(part) - GRAM + 1)})


def search_indexed(results: DataFrame, index: DataFrame, search: str) -> DataFrame:
    """The rows ``filter_results`` finds for ``search``, by the index of the same results.

    The postings of the rarest trigrams are intersected by row id and met by a semi join; rows that share an
    id may come through it and are left to the filter. A pattern
    whose literal parts have no trigram, or with the escape character, is answered by the scan.
    """
    grams = search_grams(search)
    if not grams or "\u0001" in search:
        return filter_results(results, search=search)
    asked = index.where(F.col("gram").isin(grams))
    counts = {r["gram"]: r["n"] for r in asked.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    rarest = sorted(grams, key=lambda gram: (counts.get(gram, 0), gram))[:RAREST]
    hits = (
        index.where(F.col("gram").isin(rarest)).select(F.explode("rows").alias("_hit")).groupBy("_hit")
        .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= len(rarest))
    )
    found = results.join(hits, F.col(ROW_ID).eqNullSafe(F.col("_hit")), "left_semi")
    return filter_results(found, search=search)
