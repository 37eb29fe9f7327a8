"""Line dedup: content-defined chunks and long runs of lines, of which the first one everywhere stays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.common import map_batches, mixed, pick, sized_join
from twinledger.operators.rownum import number_by
from twinledger.session import materialise


@dataclass(frozen=True)
class LineChunks:
    """``window`` lines enter a rolling hash. A chunk ends after a line whose rolling hash is below both
    neighbours' (so a chunk has two lines at least, three on average), after ``most_lines`` lines, and
    round each line of ``long_words`` words or more, which is a chunk by itself. Lines that no repeated
    chunk takes are cut as well where they repeat for ``long_words`` words or more.
    """

    window: int = 2
    most_lines: int = 64
    long_words: int = 50


def _line_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=np.uint64, count=len(lines)
    )


def chunk_lines(text: str, spec: LineChunks = LineChunks()) -> tuple[list[str], list[tuple[int, int, bool]]]:
    """The lines of a text and its chunks (first line, end, whether removable).

    Boundaries hang on the lines next to them alone, so lines put in before a passage don't move those
    inside it. A chunk may be removed if it has two lines that aren't blank, or one long line.
    """
    lines = text.split("\n")
    n = len(lines)
    hashes = _line_hashes(lines)
    rolling = np.zeros(n, dtype=np.uint64)
    for back in range(spec.window - 1, -1, -1):
        moved = np.concatenate([np.zeros(back, dtype=np.uint64), hashes[: n - back]]) if back else hashes
        rolling = mixed(rolling * np.uint64(0x9E3779B97F4A7C15) + moved[:n])
    ends = np.zeros(n, dtype=bool)
    if n > 2:
        ends[1:-1] = (rolling[1:-1] < rolling[:-2]) & (rolling[1:-1] < rolling[2:])
    long_ = np.fromiter(
        (x.count(" ") + 1 >= spec.long_words and len(x.split()) >= spec.long_words for x in lines), dtype=bool, count=n
    )
    ends |= long_
    ends[:-1] |= long_[1:]
    ends[-1] = True
    chunks, start = [], 0
    for end in np.flatnonzero(ends) + 1:
        for first in range(start, end, spec.most_lines):
            last = min(int(end), first + spec.most_lines)
            solid = sum(1 for x in lines[first:last] if x.strip())
            chunks.append((first, last, solid >= 2 or (last - first == 1 and bool(long_[first]))))
        start = int(end)
    return lines, chunks


_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _sums(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, factor: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the lines first..end, by differences of running sums."""
    powers = np.ones(len(hashes) + 1, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(len(hashes), factor, dtype=np.uint64))
    back = np.ones(len(hashes) + 1, dtype=np.uint64)
    back[1:] = np.cumprod(np.full(len(hashes), pow(factor, -1, 1 << 64), dtype=np.uint64))
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    return mixed((running[end] - running[first]) * back[first] + (end - first).astype(np.uint64))


def line_windows(lines: list[str], spec: LineChunks = LineChunks()) -> tuple[np.ndarray, ...]:
    """(first, end, hi, lo) of the shortest runs of lines that reach ``long_words`` words.

    They start at a line that isn't blank or end at one. So the windows inside any run of lines of that
    many words cover the run (but for blank lines at its edges), wherever it starts and ends. Single
    lines are left out if they are chunks by themselves.
    """
    words = np.fromiter((len(x.split()) for x in lines), dtype=np.int64, count=len(lines))
    total = np.concatenate([[0], np.cumsum(words)])
    solid = np.flatnonzero(words)
    end = np.searchsorted(total, total[solid] + spec.long_words, "left")
    first = np.searchsorted(total, total[solid + 1] - spec.long_words, "right") - 1
    ahead, back = end <= len(lines), first >= 0
    size = len(lines) + 1
    runs = np.unique(np.concatenate([(solid * size + end)[ahead], (first * size + solid + 1)[back]]))
    first, end = runs // size, runs % size
    single = np.fromiter(
        (e == f + 1 and lines[f].count(" ") + 1 >= spec.long_words for f, e in zip(first, end)), dtype=bool, count=len(runs)
    )
    first, end = first[~single], end[~single]
    if not len(first):
        return first, end, first, first
    hashes = _line_hashes(lines)
    hi, lo = (_sums(h, first, end, f).view(np.int64) for h, f in zip((hashes, mixed(~hashes)), _FACTORS))
    return first, end, hi, lo


def _taken(text: str, numbers, spec: LineChunks) -> tuple[list[str], np.ndarray]:
    """The lines of a text, and which of them go with the chunks of these numbers."""
    if not numbers:
        lines = text.split("\n")
        return lines, np.zeros(len(lines), dtype=bool)
    lines, chunks = chunk_lines(text, spec)
    gone = np.zeros(len(lines), dtype=bool)
    for number in numbers:
        if number < len(chunks):
            gone[chunks[number][0] : chunks[number][1]] = True
    return lines, gone


def _bodies(text: str, spec: LineChunks):
    lines, chunks = chunk_lines(text, spec)
    for number, (first, last, removable) in enumerate(chunks):
        if removable:
            yield number, "\n".join(lines[first:last]).encode("utf-8", "surrogatepass")


_HASHED = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32())])


def _hash_of(body: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(body)
    return tuple(int.from_bytes(x, "big", signed=True) for x in (digest[:8], digest[8:]))


def _hash_chunks(spec: LineChunks):
    def run(batches):
        for batch in batches:
            rows = [
                (*_hash_of(body), id_.as_py(), number)
                for id_, text in zip(batch.column(0), batch.column(1))
                for number, body in _bodies(text.as_py(), spec)
            ]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _HASHED)], schema=_HASHED
            )

    return run


def _bodies_of(spec: LineChunks):
    """(hi, lo, doc_id, chunk, first, body) of the chunks that a document is asked for."""
    schema = pa.schema([*_HASHED, ("first", pa.bool_()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for id_, text, asked in zip(batch.column(0), batch.column(1), batch.column(2)):
                wanted = {x["chunk"]: x for x in asked.as_py()}
                for number, body in _bodies(text.as_py(), spec):
                    if number in wanted:
                        x = wanted[number]
                        rows.append((x["hi"], x["lo"], id_.as_py(), number, x["first"], body))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return run


_WINDOWS = pa.schema([
    ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("left", pa.bool_())
])


def _hash_windows(spec: LineChunks):
    """The windows of (doc_id, text, cuts); ``left`` if no line of it goes with a chunk."""

    def run(batches):
        for batch in batches:
            parts = [[np.empty(0, dtype=f.type.to_pandas_dtype())] for f in _WINDOWS]
            for id_, text, cuts in zip(batch.column(0), batch.column(1), batch.column(2)):
                lines, gone = _taken(text.as_py(), cuts.as_py(), spec)
                first, end, hi, lo = line_windows(lines, spec)
                before = np.concatenate([[0], np.cumsum(gone)])
                ids = np.full(len(first), id_.as_py(), dtype=np.int64)
                for part, column in zip(parts, (hi, lo, ids, first, end, before[first] == before[end])):
                    part.append(column)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(p).astype(f.type.to_pandas_dtype()), type=f.type) for p, f in zip(parts, _WINDOWS)],
                schema=_WINDOWS,
            )

    return run


def _bodies_of_windows(spec: LineChunks):
    """(hi, lo, doc_id, first, end, source, body) of the windows that a document is asked for."""
    schema = pa.schema([*list(_WINDOWS)[:5], ("source", pa.bool_()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for id_, text, asked in zip(batch.column(0), batch.column(1), batch.column(2)):
                lines = text.as_py().split("\n")
                own = set(zip(*(x.tolist() for x in line_windows(lines, spec))))
                for x in asked.as_py():
                    if (x["first"], x["end"], x["hi"], x["lo"]) not in own:
                        continue
                    body = "\n".join(lines[x["first"] : x["end"]]).encode("utf-8", "surrogatepass")
                    rows.append((x["hi"], x["lo"], id_.as_py(), x["first"], x["end"], x["source"], body))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return run


def _cut_runs(lines: list[str], gone: np.ndarray, windows, spec: LineChunks) -> int:
    """Mark in ``gone`` the lines that repeated windows hold for long enough; the number of such runs.

    Blank lines neither end a run nor go at its edges.
    """
    held = np.zeros(len(lines), dtype=bool)
    for x in windows:
        held[x["first"] : x["end"]] = True
    held &= ~gone
    runs, run, words = 0, [], 0
    for at in range(len(lines) + 1):
        if at < len(lines) and held[at]:
            run.append(at)
            words += len(lines[at].split())
        elif at == len(lines) or gone[at] or lines[at].strip():
            if run and words >= spec.long_words:
                gone[run[0] : run[-1] + 1] = True
                runs += 1
            run, words = [], 0
    return runs


def _cutter(spec: LineChunks):
    @F.pandas_udf("text string, n int")
    def cut(texts: pd.Series, cuts: pd.Series, windows: pd.Series) -> pd.DataFrame:
        def left(text, numbers, windows):
            if text is None or numbers is None and windows is None:
                return None, 0
            numbers = [] if numbers is None else [int(x) for x in numbers]
            lines, gone = _taken(text, numbers, spec)
            runs = 0 if windows is None else _cut_runs(lines, gone, windows, spec)
            return "\n".join(line for line, out in zip(lines, gone) if not out), len(numbers) + runs

        return pd.DataFrame([left(*x) for x in zip(texts, cuts, windows)], columns=["text", "n"])

    return cut


def repeated_chunks(docs: DataFrame, spec: LineChunks = LineChunks()) -> DataFrame:
    """(doc_id, cuts): numbers of the chunks that an earlier document, or place in it, holds as well.

    Chunks meet by a 128-bit hash in a pre-aggregated count. The texts of those that repeat are then
    read again and compared byte by byte with the first one's; a chunk of other bytes stays. Joins on
    the hash are plain equi joins, so a passage that a third of the documents share is split.
    """
    base = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    chunks = materialise(
        base.transform(map_batches, _hash_chunks(spec), "hi long, lo long, doc_id long, chunk int"), "line-chunks"
    )
    place = F.struct("doc_id", "chunk")
    repeated = materialise(
        chunks.groupBy("hi", "lo").agg(F.min(place).alias("from"), F.max(place).alias("to")).where("from <> to")
        .select("hi", "lo", "from"),
        "line-repeated",
    )
    asked = materialise(
        sized_join(chunks, repeated, ["hi", "lo"], "inner")
        .select("doc_id", F.struct("chunk", "hi", "lo", (F.col("from") == place).alias("first")).alias("ask"))
        .groupBy("doc_id").agg(F.collect_set("ask").alias("asked")),
        "line-asked",
    )
    bodies = materialise(
        sized_join(base, asked, "doc_id", "inner").select("doc_id", "text", "asked").transform(map_batches,
            _bodies_of(spec), "hi long, lo long, doc_id long, chunk int, first boolean, body binary"
        ),
        "line-bodies",
    )
    firsts = bodies.where("first").select("hi", "lo", F.col("body").alias("original")).dropDuplicates(["hi", "lo"])
    same = (
        bodies.where("NOT first").join(firsts, ["hi", "lo"]).where("body = original").select("doc_id", "chunk")
    )
    return materialise(same.groupBy("doc_id").agg(F.collect_set("chunk").alias("cuts")), "line-cuts")


def repeated_windows(docs: DataFrame, cuts: DataFrame, spec: LineChunks = LineChunks()) -> DataFrame:
    """(doc_id, windows): runs of lines beside the cut chunks that an earlier document, or an earlier
    place in it that they don't touch, holds as well, as structs (first, end).

    As with the chunks, 128-bit hashes meet in a pre-aggregated count and texts are compared after. Only
    windows that the chunks left whole are asked for, so few texts are read a second time.
    """
    base = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    windows = materialise(
        sized_join(base, cuts, "doc_id", "left").select("doc_id", "text", "cuts").transform(map_batches,
            _hash_windows(spec), "hi long, lo long, doc_id long, first int, end int, left boolean"
        ),
        "line-windows",
    )
    place = F.struct("doc_id", "first")
    apart = (F.col("from.doc_id") < F.col("doc_id")) | (F.col("from.first") + F.col("end") - F.col("first") < F.col("first"))
    repeated = materialise(
        windows.groupBy("hi", "lo").agg(F.min(place).alias("from"), F.max(F.when(F.col("left"), place)).alias("to"))
        .where("from < to").select("hi", "lo", "from"),
        "line-windows-repeated",
    )
    asked = materialise(
        sized_join(windows, repeated, ["hi", "lo"], "inner").where((F.col("left") & apart) | (F.col("from") == place))
        .select("doc_id", F.struct("first", "end", "hi", "lo", (F.col("from") == place).alias("source")).alias("ask"))
        .groupBy("doc_id").agg(F.collect_set("ask").alias("asked")),
        "line-windows-asked",
    )
    bodies = materialise(
        sized_join(base, asked, "doc_id", "inner").select("doc_id", "text", "asked").transform(map_batches,
            _bodies_of_windows(spec), "hi long, lo long, doc_id long, first int, end int, source boolean, body binary"
        ),
        "line-windows-bodies",
    )
    sources = bodies.where("source").select("hi", "lo", F.col("body").alias("original")).dropDuplicates(["hi", "lo"])
    same = bodies.where("NOT source").join(sources, ["hi", "lo"]).where("body = original")
    return materialise(
        same.groupBy("doc_id").agg(F.collect_set(F.struct("first", "end")).alias("windows")), "line-windows-cut"
    )


def _text_keys(keyed: DataFrame) -> DataFrame:
    """``keyed`` (with doc_id and text in ``_cut_id`` and ``_cut_text``) with a number per document.

    The number is doc_id as long as each stands for one text. Where one has several, every text of every
    doc_id gets a number of its own, in order of doc_id, so that nothing found in one is cut from another.
    """
    own = [F.xxhash64("_cut_text"), F.xxhash64(F.lit(1), "_cut_text")]
    texts = keyed.where("_cut_id IS NOT NULL AND _cut_text IS NOT NULL").select(
        F.col("_cut_id").alias("_id"), own[0].alias("_a"), own[1].alias("_b")
    )
    several = texts.groupBy("_id").agg(F.min("_a").alias("least"), F.max("_a").alias("most")).where("least <> most")
    if several.isEmpty():
        return keyed
    numbers = number_by(texts.distinct(), ["_id", "_a", "_b"], "_number")
    met = (F.col("_cut_id") == F.col("_id")) & (own[0] == F.col("_a")) & (own[1] == F.col("_b"))
    numbered = keyed.join(numbers, met, "left").drop("_cut_id", "_id", "_a", "_b")
    return materialise(numbered.withColumnRenamed("_number", "_cut_id"), "line-documents")


def dedup_lines(docs: DataFrame, spec: LineChunks = LineChunks()) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with ``text`` cut and ``n_cut`` chunks and runs of
    lines removed (a column n_cut of ``docs`` is replaced).

    Repeated chunks go, and of the lines left then those that repeat for ``spec.long_words`` words or
    more in one piece. So no run of whole lines of that length is left that stands in an earlier
    document; fewer words of a passage may stay at its edges, where the chunks hold other lines too. The
    first occurrence, by doc_id and place, stays, and so does a run that adjoins it (one line over and
    over). Null texts, texts without a repeat and rows of a null doc_id
    come back as they are, with n_cut 0; a text may be empty afterwards. Rows of one doc_id and one text
    are one document and lose the same lines; rows of one doc_id with other texts are other documents.
    """
    own, text = _exact(docs, "doc_id"), _exact(docs, "text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = _text_keys(plain.withColumn("_cut_id", F.col(f"c{own}")).withColumn("_cut_text", F.col(f"c{text}")))
    given = keyed.select(F.col("_cut_id").alias("doc_id"), F.col("_cut_text").alias("text"))
    chunks = repeated_chunks(given, spec)
    cuts = materialise(
        chunks.join(repeated_windows(given, chunks, spec), "doc_id", "full")
        .select(F.col("doc_id").alias("_cut_id"), F.col("cuts").alias("_cuts"), F.col("windows").alias("_windows")),
        "line-cuts-all",
    )
    joined = sized_join(keyed.drop("_cut_text"), cuts, "_cut_id", "left")
    touched = F.col("_cuts").isNotNull() | F.col("_windows").isNotNull()
    changed = _cutter(spec)(F.when(touched, F.col(f"c{text}")), F.col("_cuts"), F.col("_windows"))
    joined = joined.withColumn("_new", changed)
    columns = [
        (F.coalesce("_new.text", f"c{i}") if i == text else F.col(f"c{i}")).alias(name)
        for i, name in enumerate(docs.columns) if name.lower() != "n_cut"
    ]
    return joined.select(*columns, F.col("_new.n").alias("n_cut"))


def _exact(df: DataFrame, name: str) -> int:
    lower = [c.lower() for c in df.columns]
    return df.columns.index(name) if name in df.columns else lower.index(name)
