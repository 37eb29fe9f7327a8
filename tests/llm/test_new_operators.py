"""Packing, hard negatives and collocations against brute-force versions, and their edge cases."""

import collections
import functools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import EDGES, frame
from twinledger.llm import collocations, lines, negatives, packing, vectors
from twinledger.llm.minhash import near_duplicates
from twinledger.llm.queries import LLM_QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    """The edge rows with extra columns whose names clash with results and with ``text``."""
    df = frame(spark, EDGES)
    for name in ("TEXT", "row", "ids", "start", "offset", "f", "word", "rank", "codes"):
        df = df.select("*", df["n_chars"].alias(name))
    return df


# --- packing --------------------------------------------------------------------------------


@functools.cache
def _encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as file:
        return packing.Encoder(file.read())


@pytest.fixture(scope="module")
def exact():
    return tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(
    st.characters(max_codepoint=0x24F), st.sampled_from(" \t\n\r'’—€<|>sdt"), st.characters(codec="utf-8"))))
def test_encoder_gives_the_ids_of_tokenizers(text):
    encoder = _encoder()
    assert list(encoder(text)) == encoder.exact.encode(text, add_special_tokens=False).ids


def test_encoder_takes_every_common_character_and_the_special_token():
    encoder = _encoder()
    assert encoder.fast is not None
    for code in range(0x250):
        text = f"a{chr(code)} {chr(code)}{chr(code)}b <|endoftext|>{chr(code)}"
        assert list(encoder(text)) == encoder.exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=60))
def test_first_fit_decreasing_by_plain_search(sizes):
    bins, room = [], []
    for size in sorted(sizes, reverse=True):
        at = next((i for i, left in enumerate(room) if left >= size), len(room))
        if at == len(room):
            room.append(70)
        room[at] -= size
        bins.append((size, at))
    placed = packing.first_fit_decreasing(np.array(sizes), 70)
    assert collections.Counter(zip(sizes, placed.tolist())) == collections.Counter(bins)


def check_pieces(rows, documents, capacity):
    """Each id once, offsets gapless, sequences full or a power of two."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, total, sequence, offset, ids in rows:
        by_sequence[sequence].append((offset, length))
        by_doc[doc, total].append((start, length, ids))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    found = collections.Counter()
    for (doc, total), parts in by_doc.items():
        copies = sum(length for _, length, _ in parts) // total
        assert sum(length for _, length, _ in parts) == copies * total
        if copies == 1:
            parts.sort()
            assert [s for s, _, _ in parts] == [sum(p[1] for p in parts[:i]) for i in range(len(parts))]
            found[doc, b"".join(ids for _, _, ids in parts)] += 1
        else:
            found[doc, None] += copies
    for (doc, ids), n in documents.items():
        assert found[doc, ids] == n or found[doc, None] >= n
    return by_sequence


def test_packing_query_loses_no_id(spark, exact):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter()
    tokens = {}
    for doc, text in docs:
        tokens[doc] = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[doc, tokens[doc].tobytes()] += 1
    pieces = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"))
    check_pieces([tuple(r) for r in pieces.collect()], want, 1024)
    for row in LLM_QUERIES["op11_packing"](spark, SMALL).collect():
        ids = tokens[row.doc_id]
        assert row.doc_tokens == len(ids)
        assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())


def test_packing_edges_and_sequences(spark, edges, exact):
    spec = packing.Packing(capacity=100, group_docs=3)
    pieces = packing.pack(edges, spec)
    rows = [tuple(r) for r in pieces.collect()]
    want = collections.Counter(
        (doc, np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
        for doc, text, *_ in EDGES
    )
    sequences = check_pieces(rows, want, 100)
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert set(whole) == set(sequences)
    for number, parts in sequences.items():
        assert whole[number].n_tokens == sum(n for _, n in parts) == len(whole[number].ids) // 4
    first = {(s, o): ids for _, _, _, _, s, o, ids in rows}
    for number, row in whole.items():
        assert bytes(row.ids) == b"".join(bytes(first[number, o]) for o, _ in sorted(sequences[number]))
    assert packing.pack(frame(spark, [])).collect() == []


# --- hard negatives ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, spec, anchor):
    """The contract over whole rows, in Python integers."""
    good = []
    for number, (name, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        good.append((number, name, label, [int(np.floor(float(x) * spec.scale)) for x in vector]))
    out = []
    for number, name, label, vector in good:
        if name is None or not anchor(name):
            continue
        others = [
            (sum(a * b for a, b in zip(vector, v)), other, n, own)
            for n, other, own, v in good if n != number and len(v) == len(vector)
        ]
        others.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        for score, positive, _, _ in [x for x in others if x[3] == label][: spec.positives]:
            fits = [x for x in others if x[3] != label and spec.low * score <= 100 * x[0] <= spec.high * score]
            out += [(name, positive, i + 1, x[1], score, x[0]) for i, x in enumerate(fits[: spec.negatives])]
    return collections.Counter(out)


def found(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_hard_negatives_with_ties_nulls_copies_and_widths(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(60)]
    rows += [(1, [1.0, 1.0, 1.0, 1.0], 0), (10, rows[10][1], rows[10][2]), (10, rows[10][1], rows[10][2])]
    rows += [(70, None, 1), (80, [1.0, None, 0.0, 0.0], 1), (90, [1.0, float("nan"), 0.0, 0.0], 1)]
    rows += [(91, [0.5] * 4, None), (None, [1.0] * 4, 2), (100, [1.0, 0.5], 1), (101, [1.0, 0.25], 1), (102, [0.5, 0.5], 2)]
    rows += [(110, [], 1), (111, [], 2), (120, [0.0] * 4, 1)]
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("row"), F.lit("x").alias("LABEL_1"), F.lit(2).alias("tile"))
    spec = negatives.HardNegatives(shard_rows=16, block_anchors=3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, spec)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == plain_negatives(rows, spec, lambda i: i % 10 == 0)


def test_hard_negatives_of_empty_tables(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(3, [1.0], 1)], VECTORS)
    assert negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).collect() == []


def test_scores_of_great_components_are_exact(spark):
    rows = [(i, [3e6 + i, -2e5 * i, 5e5], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found(negatives.hard_negatives(df, F.col("vec_id") < 6)) == plain_negatives(
        rows, negatives.HardNegatives(), lambda i: i < 6
    )


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(1, 1 << 45), st.randoms(use_true_random=False))
def test_packed_products(n, width, size, rng):
    rows = np.array([[rng.randint(-size, size) for _ in range(width)] for _ in range(n)], dtype=np.int64)
    anchors = np.array([[rng.randint(-size, size) for _ in range(width)] for _ in range(5)], dtype=np.int64)
    packed = negatives.PackedCandidates(rows, int(abs(anchors).astype(object).sum(axis=1).max()))
    want = anchors.astype(object) @ rows.astype(object).T
    assert (packed.scores(anchors).astype(object) == want).all()


# --- collocations -------------------------------------------------------------------------------


def plain_collocations(rows, spec):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, spec.longest + 1):
                counts.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {g: n for g, n in counts.items() if len(g) > 2 and n >= spec.least}
    gone = set()
    for longer, n in candidates.items():
        for k in range(2, len(longer) - 1):
            for i in range(1, len(longer) - k + 1):
                inner = (longer[0], *longer[i : i + k])
                if 100 * n >= spec.inside * candidates.get(inner, 1 << 60):
                    gone.add(inner)
    scored = collections.defaultdict(list)
    for g, a in candidates.items():
        if g in gone:
            continue
        cuts = []
        for k in range(2, len(g)):
            left, right = counts[g[:k]], counts[(g[0], *g[k:])]
            cuts.append((spec.scale * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        scored[g[0]].append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return {
        (lang, i + 1, p.decode(), -a, l, r, totals[lang], -s)
        for lang, found in scored.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[: spec.top])
    }


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_by_plain_counting(spark, longest):
    rng = random.Random(longest)
    words = ["a", "B", "c", "é", "Été", "x\x0b", "it's", "..", "d,", "\t", "\n", " ", "e\x00f"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", None, "und", "fr"]), "s", 1) for i in range(150)]
    rows += [(3, "new york city " * 40, "en", "s", 1), (3, "new york city " * 40, "en", "s", 1), (None, "york new", "en", None, None)]
    spec = collocations.Collocations(longest=longest, top=25, filter_bits=1 << 10)
    got = collocations.collocations(frame(spark, rows), spec).collect()
    want = plain_collocations([(r[2], r[1]) for r in rows], spec)
    assert len(got) == len(want) > 20 and {tuple(r) for r in got} == want


def test_collocation_edges(spark, edges):
    got = {tuple(r) for r in collocations.collocations(edges).collect()}
    assert got == plain_collocations([(r[2], r[1]) for r in EDGES], collocations.Collocations())
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None, None), (2, "", "en", "s", 0)])).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 3_000_000_000
    df = spark.createDataFrame([(n, n + 1, n + 7)], "a long, l long, r long")
    assert df.select(collocations._cut_score("a", "l", "r", 1_000_000)).first()[0] == 10**6 * n * n // ((n + 1) * (n + 7))


# --- line dedup: one doc_id with several texts ---------------------------------------------------


def test_one_id_with_two_texts_loses_nothing_unique(spark):
    shared = "\n".join(f"shared line {i} " + "w " * 30 for i in range(12))
    unique = "\n".join(f"unique line {i} " + f"v{i} " * 30 for i in range(12))
    rows = [(1, shared), (2, shared), (2, unique), (2, unique), (3, unique + "\nend"), (None, unique), (4, None)]
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in rows]).select("*", F.lit(1).alias("_cut_id_1"), F.lit(2).alias("_a"))
    got = collections.Counter((r.doc_id, r.text, r.n_cut > 0) for r in lines.dedup_lines(df).collect())
    assert got == {
        (1, shared, False): 1, (2, "", True): 1, (2, unique, False): 2, (None, unique, False): 1, (4, None, False): 1,
        (3, "end", True): 1,
    }


def test_near_copies_of_one_id_with_two_texts(spark):
    """Row 5 stands twice, once near 1 and once near 7: each row has the component of its own text."""
    base = [[f"{name}{i}" for i in range(80)] for name in "pq"]
    rows = [(1, base[0]), (5, [*base[0], "end"]), (5, [*base[1], "end"]), (7, base[1])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(1, 76, 1, True), (5, 77, 1, False), (5, 77, 5, True), (7, 76, 5, False)]


def test_pipeline_stages_judge_rows(spark):
    """One text of an id may go while the other stays, and rows without an id are judged as well."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 80").first().text
    base = [[f"{name}{i}" for i in range(80)] for name in "pqr"]
    rows = [
        (1, base[0]), (5, [*base[0], "end"]), (5, base[1]), (7, [*base[1], "end"]),
        (None, [*base[1], "close"]), (None, base[2]), (None, base[2]),
    ]
    rows = [(d, " ".join(w), "en", "s", 0) for d, w in rows]
    df = spark.createDataFrame([*rows, (None, f"before {item} after", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, df, SMALL)
    texts = sorted((r.doc_id or -1, r.text.split()[0]) for r in kept.collect())
    assert texts == [(-1, "before"), (-1, "r0"), (1, "p0"), (5, "q0")]
    left = corpus_pipeline.drop_contaminated(spark, kept, SMALL)
    assert sorted(r.text.split()[0] for r in left.collect()) == ["p0", "q0", "r0"]


def test_vector_links_of_extreme_components_and_shared_ids(spark):
    rows = [
        (1, [1e200, 1e200, 0.0], 0), (2, [1e200, 1.0001e200, 0.0], 0),
        (3, [1e-200, 1e-201, 0.0], 1), (4, [1.0, 0.36, 0.0], 1), (5, [1e-310, 1.001e-311, 0.0], 1),
        (6, [0.0, 0.0, 1.0], 2), (7, [0.0, 1.0, 0.0], 2), (7, [0.0, 0.1, 1.0], 2), (8, [0.0, 1.0, 0.01], 2),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.vector_links(df).collect())
    assert got == [
        (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 0, 4), (5, 1, 3), (6, 1, 6), (7, 1, 6), (7, 1, 7), (8, 1, 7),
    ]


def test_planned_passes_find_pairs_far_from_the_origin():
    """100,000 vectors of mean cosine 0.7: of planted pairs just above the threshold, 99 % are met."""
    rng, spec, n, width = np.random.default_rng(3), vectors.VectorLinks(), 100_000, 64
    rows = rng.standard_normal((n, width)) * np.sqrt(0.3 / width)
    rows[:, 0] += np.sqrt(0.7)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    other = rng.standard_normal((1000, width))
    other -= (other * unit[:1000]).sum(axis=1, keepdims=True) * unit[:1000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    unit[-1000:] = 0.982 * unit[:1000] + np.sqrt(1 - 0.982**2) * other
    mean = unit.mean(axis=0)
    passes = int(spec.passes_for(np.array([n]), np.array([1 - mean @ mean]))[0])
    met = np.zeros(1000, dtype=bool)
    for number in range(passes):
        place = np.empty(n, dtype=np.int64)
        place[np.argsort(vectors.hash_bits(unit - mean, spec.seed, number + 1))] = np.arange(n)
        met |= np.abs(place[:1000] - place[-1000:]) <= spec.window
    assert 20 < passes < 60 and met.mean() >= 0.99
