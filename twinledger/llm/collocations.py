"""Phrase collocations by SETM: relational mining over sorted occurrence relations.

The relation of a length holds where each frequent group of words stands, sorted by piece and position
and clustered by document. The next length is a merge-join of a relation with itself at adjacent
positions of one piece, a group-count, and a semi-join of the occurrences with the groups that are
frequent; only what survives is extended.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, mixed, pick
from twinledger.session import materialise

HELD = 1 << 20
"""Occurrences (or words) that a task counts before it hands its counts on."""

PROBES = 4


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``longest`` words seen at least ``least`` times in a language.

    ``inside`` is the share (per cent) of a phrase's occurrences from which a longer candidate that holds
    it stands for it. ``top`` phrases are reported per language. ``filter_bits`` is the size of the
    filter that carries the frequent groups to the occurrences; a greater one prunes more, the result
    is the same. ``seed`` is that of the words' 64-bit codes.
    """

    least: int = 10
    longest: int = 3
    inside: int = 50
    top: int = 2000
    scale: int = 1_000_000
    filter_bits: int = 1 << 26
    seed: int = 11


# What ends a piece, as one mark that stands for itself among the words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"."
_TABLE = bytes.maketrans(_ENDS + b"\t", _MARK * len(_ENDS) + b" ")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, and a mark between pieces."""
    return text.lower().translate(_TABLE).replace(_MARK, b" . ").split(b" ")


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _count_words(batches):
    """(lang, word, n) as counted so far, whenever enough different words are held."""
    held: dict[str, Counter] = {}

    def counts():
        langs = [lang for lang, seen in held.items() for _ in seen]
        words = [word for seen in held.values() for word in seen]
        numbers = [n for seen in held.values() for n in seen.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())],
            names=["lang", "word", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
            seen = held.setdefault(lang, Counter())
            seen.update(words_of(text))
            del seen[_MARK], seen[b""]
            if sum(map(len, held.values())) > HELD:
                yield counts()
                held.clear()
    if held:
        yield counts()


class Codes(dict):
    """64-bit codes of the words of one language that the filter lets through, 0 for all others.

    Words of a batch that are new are looked up together; beyond a bounded number all are forgotten.
    """

    def __init__(self, lang: str, seed: int, frequent: Filter):
        super().__init__()
        self.salt, self.seed, self.frequent = lang.encode() + b"\0", seed, frequent

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > HELD:
            self.clear()
        new = [word for word in words if word not in self]
        codes = np.array([word_code(self.salt + word, self.seed) for word in new], dtype=np.uint64)
        self.update(zip(new, np.where(self.frequent.holds(codes), codes, 0).tolist()))
        self[_MARK] = 0


def word_code(name: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(name, seed=seed) or 1


@dataclass
class Filter:
    """A Bloom filter of groups: may let a rare one through, never stops a frequent one."""

    words: np.ndarray

    @staticmethod
    def places(codes: np.ndarray, bits: int) -> list[np.ndarray]:
        step = mixed(codes) | np.uint64(1)
        return [mixed(codes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]

    def holds(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), dtype=bool)
        for place in self.places(codes, 64 * len(self.words)):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def group_code(parts: list[np.ndarray]) -> np.ndarray:
    """One code of a group of word codes; only for the filter, groups are counted by all their parts."""
    return reduce(lambda a, b: mixed(a * np.uint64(3) + b), parts)


def _filter(groups: DataFrame, width: int, bits: int):
    """The filter of all ``groups`` (c1 .. c_width), as a broadcast of ``bits`` / 8 bytes.

    Tasks turn groups into (word of the filter, bits); Spark unites them before the driver lays them out.
    """
    def run(batches):
        for batch in batches:
            parts = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(width)]
            places = np.unique(np.concatenate(Filter.places(group_code(parts), bits)))
            at = (places >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], names=["at", "bits"]
            )

    set_bits = groups.select(*[f"c{i + 1}" for i in range(width)]).mapInArrow(run, "at long, bits long")
    united = set_bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[united.column("at").to_numpy()] = united.column("bits").to_numpy().view(np.uint64)
    return groups.sparkSession.sparkContext.broadcast(words)


def _occurrences(seed: int, shared):
    """The relation of single words: per document the codes in order, 0 where a piece ends or a rare word stands."""

    def run(batches):
        frequent = Filter(shared.value)
        codes: dict[str, Codes] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [[w for w in words_of(text) if w] for text in _texts(batch.column(1))]
            for lang in set(langs):
                known = codes.setdefault(lang, Codes(lang, seed, frequent))
                known.learn(set().union(*[words for own, words in zip(langs, texts) if own == lang]))
            lists = [
                np.fromiter(map(codes[lang].__getitem__, words), dtype=np.uint64, count=len(words))
                for lang, words in zip(langs, texts)
            ]
            yield _clustered(lists, [np.flatnonzero(c) for c in lists])

    return run


def _clustered(codes: list[np.ndarray], starts: list[np.ndarray]) -> pa.RecordBatch:
    def lists(arrays, kind):
        ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
        flat = np.concatenate(arrays) if arrays else np.zeros(0)
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind))).cast(
            pa.list_(pa.from_numpy_dtype(kind))
        )

    views = [c.view(np.int64) for c in codes]
    return pa.RecordBatch.from_arrays([lists(views, np.int64), lists(starts, np.int32)], names=["codes", "starts"])


_RELATION = "codes array<long>, starts array<int>"


def _read(batch: pa.RecordBatch):
    """A batch as flat arrays: codes, starts as places in them, and the bounds of the documents."""
    codes, starts = batch.column(0), batch.column(1)
    flat = codes.flatten().to_numpy().view(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(codes).to_numpy())]).astype(np.int64)
    parent = pa.compute.list_parent_indices(starts).to_numpy()
    return flat, starts.flatten().to_numpy().astype(np.int64) + bounds[parent], bounds, parent


def extend(starts: np.ndarray) -> np.ndarray:
    """Merge-join of a sorted relation with itself: starts whose next position is a start as well.

    A rare word or the end of a piece takes up a position of its own, so neighbours lie in one piece.
    """
    return starts[:-1][starts[1:] == starts[:-1] + 1] if len(starts) else starts


def _joined(flat, starts, bounds, width):
    """Starts of groups of ``width`` words that begin and end in one document."""
    if width == 1:
        return starts
    found = extend(starts)
    return found[np.searchsorted(bounds, found, "right") == np.searchsorted(bounds, found + width - 1, "right")]


def _count_groups(width: int):
    """(c1 .. c_width, n) of the groups that the merge-join of the shorter relation gives."""
    names = [*[f"c{i + 1}" for i in range(width)], "n"]

    def counted(held):
        parts = [np.concatenate(part) for part in zip(*held)]
        known, places = np.unique(np.concatenate(parts), return_inverse=True)
        n = len(parts[0])
        order = np.lexsort([places[i * n : (i + 1) * n] for i in range(width)][::-1])
        rows = [places[i * n : (i + 1) * n][order] for i in range(width)]
        new = np.concatenate([[True], reduce(np.logical_or, [np.diff(r) != 0 for r in rows])])
        first = np.flatnonzero(new)
        columns = [pa.array(known[r[first]].view(np.int64)) for r in rows]
        numbers = np.diff(np.concatenate([first, [n]]))
        return pa.RecordBatch.from_arrays([*columns, pa.array(numbers.astype(np.int64))], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            flat, starts, bounds, _ = _read(batch)
            at = _joined(flat, starts, bounds, width)
            held.append(tuple(flat[at + i] for i in range(width)))
            size += len(at)
            if size > HELD:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    return run, ", ".join(f"{n} long" for n in names)


def _keep_frequent(width: int, shared):
    """The relation of ``width``: occurrences of the merge-join whose group the filter holds."""

    def run(batches):
        frequent = Filter(shared.value)
        for batch in batches:
            flat, starts, bounds, _ = _read(batch)
            at = _joined(flat, starts, bounds, width)
            at = at[frequent.holds(group_code([flat[at + i] for i in range(width)]))]
            kept = np.zeros(len(flat), dtype=bool)
            for i in range(width):
                kept[at + i] = True
            codes = np.where(kept, flat, 0).astype(np.uint64)
            parts = np.searchsorted(at, bounds)
            yield _clustered(
                [codes[a:b] for a, b in zip(bounds, bounds[1:])],
                [at[a:b] - start for a, b, start in zip(parts, parts[1:], bounds)],
            )

    return run


def _coded(words: DataFrame, seed: int) -> DataFrame:
    """(lang, word, f, c1) of frequent words; a code that two of them share fails the query."""

    def run(batches):
        for batch in batches:
            names = [
                lang.encode() + b"\0" + word
                for lang, word in zip(batch.column(0).to_pylist(), _texts(batch.column(1)))
            ]
            codes = np.array([word_code(name, seed) for name in names], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=["lang", "word", "f", "c1"])

    return words.mapInArrow(run, "lang string, word string, f long, c1 long")


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(19,0)")


def _cut_score(a: str, left: str, right: str, scale: int) -> Column:
    """floor(scale * a * a / (l * r)) in whole numbers; the quotient is at most ``scale``."""
    return F.expr(
        f"(CAST({a} AS DECIMAL(19,0)) * CAST({a} AS DECIMAL(19,0)) * CAST({scale} AS DECIMAL(7,0)))"
        f" DIV (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))"
    )


def frequent_groups(docs: DataFrame, spec: Collocations = Collocations()) -> tuple[DataFrame, dict[int, DataFrame], DataFrame]:
    """(frequent words with codes, frequent groups by length as (c1 .. ck, f), words per language)."""
    base = pick(docs, "lang", "text").where("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialise(
        map_batches(base, _count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f")),
        "setm-words",
    )
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    seed = spec.seed
    while True:
        coded = materialise(_coded(words.where(F.col("f") >= spec.least), seed), "setm-coded")
        if coded.groupBy("c1").count().where("count > 1").isEmpty():
            break
        seed += 1
    groups = {1: coded.select("c1", "f")}
    shared = _filter(groups[1], 1, spec.filter_bits)
    relation = materialise(map_batches(base, _occurrences(seed, shared), _RELATION), "setm-1")
    for width in range(2, spec.longest + 1):
        run, schema = _count_groups(width)
        keys = [f"c{i + 1}" for i in range(width)]
        counted = relation.transform(map_batches, run, schema).groupBy(*keys).agg(F.sum("n").alias("f"))
        groups[width] = materialise(counted.where(F.col("f") >= spec.least), f"setm-groups-{width}")
        if width < spec.longest:
            shared = _filter(groups[width], width, spec.filter_bits)
            relation = materialise(
                relation.transform(map_batches, _keep_frequent(width, shared), _RELATION), f"setm-{width}"
            )
    return coded, groups, totals


def _with_count(rows: DataFrame, groups: dict[int, DataFrame], first: int, width: int, name: str) -> DataFrame:
    """``rows`` with the count of their words ``first`` to ``first + width - 1``, every one of which is frequent."""
    part = groups[width].select(*[F.col(f"c{i + 1}").alias(f"c{first + i}") for i in range(width)], F.col("f").alias(name))
    return rows.join(part, [f"c{first + i}" for i in range(width)])


def collocations(docs: DataFrame, spec: Collocations = Collocations()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases.

    Texts are split into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs. A
    phrase's score is that of its lowest cut into two parts (the first of several). Phrases that a
    longer candidate stands for go. A null text is empty, a null language is ``und``; repeated rows and
    rows of any doc_id count each; other columns are ignored; an empty table gives an empty table.

    Rare words never reach the counting of pairs, rare pairs never that of triples. Counts are added up
    in the tasks before they are shuffled by group, so a frequent phrase is a row per task.
    """
    coded, groups, totals = frequent_groups(docs, spec)
    ranked = None
    for width in range(2, spec.longest + 1):
        rows = groups[width].withColumnRenamed("f", "a")
        cuts = []
        for k in range(1, width):
            rows = _with_count(rows, groups, 1, k, f"l{k}")
            rows = _with_count(rows, groups, k + 1, width - k, f"r{k}")
            cuts.append(F.struct(
                _cut_score("a", f"l{k}", f"r{k}", spec.scale).alias("score"), F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"),
            ))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        rows = rows.select(*[f"c{i + 1}" for i in range(width)], "a", best.alias("best"))
        for longer in range(width + 1, spec.longest + 1):
            inner = F.array(*[
                F.struct(*[F.col(f"c{at + i}").alias(f"c{i}") for i in range(1, width + 1)]) for at in range(longer - width + 1)
            ])
            most = groups[longer].select(F.explode(inner).alias("g"), "f").groupBy("g").agg(F.max("f").alias("most"))
            most = most.select("g.*", "most")
            keys = [f"c{i + 1}" for i in range(width)]
            rows = rows.join(most, keys, "left").where(
                F.coalesce(_exact("most") * 100 < _exact("a") * spec.inside, F.lit(True))
            ).drop("most")
        for i in range(width):
            named = coded.select(F.col("c1").alias(f"c{i + 1}"), F.col("word").alias(f"w{i + 1}"), *(["lang"] if not i else []))
            rows = rows.join(named, f"c{i + 1}")
        phrase = F.concat_ws(" ", *[f"w{i + 1}" for i in range(width)])
        rows = rows.select("lang", phrase.alias("phrase"), "a", "best.l", "best.r", "best.score")
        ranked = rows if ranked is None else ranked.union(rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.top)
    return best.join(F.broadcast(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
numbered AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM lists WHERE len(w) > 0),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
g1 AS (SELECT lang, w[p] AS w1, CAST(count(*) AS BIGINT) AS f FROM numbered GROUP BY ALL),
g2 AS (SELECT lang, w[p] AS w1, w[p + 1] AS w2, CAST(count(*) AS BIGINT) AS f FROM numbered
       WHERE p < len(w) GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, w[p] AS w1, w[p + 1] AS w2, w[p + 2] AS w3, CAST(count(*) AS BIGINT) AS f FROM numbered
       WHERE p + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
    SELECT g2.lang, g2.w1 || ' ' || g2.w2 AS phrase, g2.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.w1 = g2.w1 JOIN g1 y ON y.lang = g2.lang AND y.w1 = g2.w2
    WHERE NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.w1 = g2.w1 AND g3.w2 = g2.w2 AND 100 * g3.f >= 50 * g2.f)
      AND NOT EXISTS (SELECT 1 FROM g3 WHERE g3.lang = g2.lang AND g3.w2 = g2.w1 AND g3.w3 = g2.w2 AND 100 * g3.f >= 50 * g2.f)
    UNION ALL
    SELECT g3.lang, g3.w1 || ' ' || g3.w2 || ' ' || g3.w3, g3.f, 1, x.f, y.f
    FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.w1 = g3.w1
    JOIN g2 y ON y.lang = g3.lang AND y.w1 = g3.w2 AND y.w2 = g3.w3
    UNION ALL
    SELECT g3.lang, g3.w1 || ' ' || g3.w2 || ' ' || g3.w3, g3.f, 2, x.f, y.f
    FROM g3 JOIN g2 x ON x.lang = g3.lang AND x.w1 = g3.w1 AND x.w2 = g3.w2
    JOIN g1 y ON y.lang = g3.lang AND y.w1 = g3.w3
), scored AS (
    SELECT *, CAST((1000000 * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
