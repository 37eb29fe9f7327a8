"""Benchmark decontamination over a positional inverted index of the training texts.

Postings (term, row, positions) are stored for the terms of the test; the lists of a window's terms
are intersected after shifting each by the term's offset, from the rarest term up.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, pick
from twinledger.session import materialise

ITEM_BLOCK_BYTES = 4 << 20
"""Text of test items that one pass over the documents asks for; more items take more passes."""

# Every other byte than 0-9, a-z and those from 0x80 up parts words.
_SEPARATORS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Contamination:
    """``words`` consecutive words of an item are a window; an item of fewer words is one window.

    ``rare`` terms of a window must occur within ``near`` words for a proximity match.
    """

    words: int = 10
    rare: int = 3
    near: int = 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split()


def _count_terms(vocabulary: frozenset[bytes]):
    def run(batches):
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(filter(vocabulary.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), type=pa.binary()), pa.array(list(counts.values()), type=pa.int64())],
            names=["term", "n"],
        )

    return run


@dataclass
class Query:
    """The windows of a block of items: what to look up first, and what must stand where."""

    terms: dict[bytes, int]
    company: dict[int, set[tuple[int, ...]]]
    by_anchor: dict[int, list[tuple]]


def plan(items: list[tuple[int, list[bytes]]], counts: dict[bytes, int], spec: Contamination) -> Query:
    """Windows by their rarest term; those with a term that no document has cannot occur."""
    terms = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    company: dict[int, set[tuple[int, ...]]] = defaultdict(set)
    by_anchor = defaultdict(list)
    for number, words in items:
        width = min(spec.words, len(words))
        for start in range(len(words) - width + 1 if width else 0):
            order = sorted(range(start, start + width), key=lambda i: (counts.get(words[i], 0), words[i], i))
            if not counts.get(words[order[0]]):
                continue
            anchor, *rest = [(terms[words[i]], i - start) for i in order]
            company[anchor[0]].add(tuple(term for term, _ in rest[: spec.rare - 1]))
            by_anchor[anchor[0]].append((number, width, anchor[1], rest))
    return Query(terms, dict(company), dict(by_anchor))


_STORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("terms", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
])


def _within(places: list[int], place: int, near: int) -> bool:
    at = bisect.bisect_right(places, place - near)
    return at < len(places) and places[at] < place + near


def _post(query: Query, spec: Contamination):
    """Postings of a text: terms of the test round places where a window's rare terms meet.

    Wherever a window occurs, its rarest term stands with the next rarest ones near it; terms farther
    from all such places than a match reaches are in none and aren't stored.
    """
    reach = max(spec.words, spec.near) - 1
    asked = set(query.company) | {t for sets in query.company.values() for others in sets for t in others}
    rare = {word: i for word, i in query.terms.items() if i in asked}

    def meeting(words):
        places = defaultdict(list)
        for at, word in enumerate(words):
            if word in rare:
                places[rare[word]].append(at)
        found = set()
        for term in places.keys() & query.company.keys():
            for others in query.company[term]:
                lists = [places[t] for t in others if t in places]
                if len(lists) == len(others):
                    found.update(p for p in places[term] if all(_within(x, p, reach + 1) for x in lists))
        return sorted(found)

    def run(batches):
        for batch in batches:
            sizes, terms, places = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                sizes.append(len(words))
                kept, last = [], 0
                for place in meeting(words):
                    begin = max(last, place - reach)
                    last = max(begin, min(len(words), place + reach + 1))
                    kept.extend(i for i in range(begin, last) if words[i] in query.terms)
                terms.append([query.terms[words[i]] for i in kept] or None)
                places.append(kept or None)
            made = [pa.array(c, type=f.type) for c, f in zip((sizes, terms, places), list(_STORED)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=_STORED)

    return run


def _nearest(lists: list[list[int]], place: int, near: int) -> tuple[int, int] | None:
    """A stretch of ``near`` words round ``place`` with a member of every list."""
    for begin in range(place - near + 1, place + 1):
        found = [bisect.bisect_left(x, begin) for x in lists]
        if all(i < len(x) and x[i] < begin + near for i, x in zip(found, lists)):
            stand = [place, *(x[i] for i, x in zip(found, lists))]
            return min(stand), max(stand) + 1
    return None


def find(postings: dict[int, list[int]], query: Query, spec: Contamination):
    """(item number, kind, start, end) in one text: exact windows, else rare terms near each other."""
    sets = {term: set(places) for term, places in postings.items()}
    none: set[int] = set()
    near = set()
    for term, places in postings.items():
        for number, width, offset, rest in query.by_anchor.get(term, ()):
            starts = [p - offset for p in places]
            for other, shift in rest:
                have = sets.get(other, none)
                starts = [s for s in starts if s + shift in have]
                if not starts:
                    break
            for s in starts:
                yield number, "phrase", s, s + width
            if not starts:
                lists = [postings.get(other, []) for other, _ in rest[: spec.rare - 1]]
                for place in places if all(lists) else ():
                    found = _nearest(lists, place, spec.near)
                    if found and (number, *found) not in near:
                        near.add((number, *found))
                        yield number, "near", *found


def _match(query: Query, spec: Contamination):
    def run(batches):
        for batch in batches:
            rows, numbers, kinds, starts, ends = [], [], [], [], []
            for row, lists in zip(batch.column(0), batch.column(1)):
                postings = {x["term"]: sorted(x["places"]) for x in lists.as_py()}
                for number, kind, start, end in find(postings, query, spec):
                    rows.append(row.as_py())
                    numbers.append(number)
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, type=pa.int64()), pa.array(numbers, type=pa.int64()), pa.array(kinds, type=pa.string()),
                 pa.array(starts, type=pa.int64()), pa.array(ends, type=pa.int64())],
                names=["row", "item_id", "kind", "start", "end"],
            )

    return run


def benchmark_matches(
    docs: DataFrame, items: DataFrame, spec: Contamination = Contamination()
) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): (row, doc_id, n_words) per document row, and (row, item_id, kind, start, end).

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters; ``start`` and ``end`` count
    words. Kind ``phrase`` is an exact window, ``near`` a window's rarest terms within ``near`` words.

    One pass counts the terms of the test in all documents, a second one writes their postings; both
    hold the test items of one block, at most ``ITEM_BLOCK_BYTES`` of text. Postings that no match can
    touch aren't written. The index is range partitioned by (term, row), so the list of a term that
    every document has is split. Null texts have no words; items without words or without id are none.
    """
    base = pick(docs, "doc_id", "text")
    asked = pick(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BLOCK_BYTES))
    base = base.withColumn("row", F.monotonically_increasing_id())
    if blocks > 1:  # every pass must number the rows alike
        base = materialise(base, "decontaminate-rows")
    rows, found = None, []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        wanted = [(r["item_id"], words_of(r["text"])) for r in part]
        vocabulary = frozenset(w for _, ws in wanted for w in ws)
        counts = {
            bytes(r["term"]): r["n"] for r in base.select("text")
            .transform(map_batches, _count_terms(vocabulary), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        }
        query = plan(wanted, counts, spec)
        stored = materialise(
            base.select("row", "doc_id", "text").transform(map_batches,
                _post(query, spec), "row long, doc_id long, n_words long, terms array<int>, places array<int>"
            ),
            "postings",
        )
        rows = rows or stored.select("row", "doc_id", "n_words")
        single = stored.where("terms IS NOT NULL").select("row", F.explode(F.arrays_zip("terms", "places")).alias("x"))
        index = materialise(
            single.groupBy(F.col("x.terms").alias("term"), "row").agg(F.collect_list("x.places").alias("places"))
            .repartitionByRange("term", "row").sortWithinPartitions("term", "row"),
            "inverted-index",
        )
        texts = index.groupBy("row").agg(F.collect_list(F.struct("term", "places")).alias("lists"))
        found.append(texts.transform(map_batches,
            _match(query, spec), "row long, item_id long, kind string, start long, end long"
        ))
    matches = found[0]
    for more in found[1:]:
        matches = matches.union(more)
    return rows, materialise(matches, "matches")


def contamination(docs: DataFrame, items: DataFrame, spec: Contamination = Contamination()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    ``n_hit`` counts the words inside any exact window. More: ``n_near``, the items of proximity
    matches. Repeated rows come back as often as given; a document without words has no hit.
    """
    rows, matches = benchmark_matches(docs, items, spec)
    phrase = F.col("kind") == "phrase"
    per_row = matches.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(phrase, F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(phrase, F.col("item_id").cast("string")))).alias("items"),
        F.count_distinct(F.when(~phrase, F.col("item_id"))).alias("n_near"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("until"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["until"], x["end"]).alias("until"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["until"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    nothing = F.array().cast("array<string>")
    return (
        rows.join(per_row.withColumn("n_hit", covered), "row", "left")
        .withColumn("items", F.coalesce("items", nothing))
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        )
    )


ORACLE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), asked AS (
    SELECT item_id, k, array_to_string(ws[s : s + k - 1], ' ') AS gram
    FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s
          FROM items WHERE len(ws) > 0)
), grams AS (
    SELECT r, k, s, array_to_string(ws[s : s + k - 1], ' ') AS gram
    FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS s
          FROM docs, (SELECT DISTINCT k FROM asked) WHERE len(ws) >= k)
), hits AS (SELECT r, s, k, item_id FROM grams JOIN asked USING (gram, k)),
hit_words AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(s, s + k)) AS p FROM hits) GROUP BY r),
hit_items AS (
    SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS listed
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words w USING (r) LEFT JOIN hit_items i USING (r)
"""
