"""The pipeline's stages against brute force, each on its own input, and on edge cases."""

import re

import pytest
from test_operators import EDGES, brute_hits, brute_lines, brute_near, frame

import corpus_pipeline
from twinledger.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay(stages):
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for df in stages[:5])
    for before, after in zip(stages[:5], stages[1:5]):
        assert 0 < after.count() <= before.count()


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = rows_of(stages[0]), rows_of(stages[1])
    bad = {d for d in before if labels.get(d) == 1}
    assert len(bad & set(after)) <= 0.1 * len(bad)
    clean = {d for d in before if labels.get(d) == 0}
    assert len(clean - set(after)) <= 0.02 * len(clean)


def test_lines_are_cut(stages):
    before = rows_of(stages[1])
    want = {d: t for d, t in brute_lines(before.items()).items() if t.strip() or not before[d].strip()}
    assert rows_of(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if r.text != before[r.doc_id])


def test_one_of_each_group_stays(stages):
    before = rows_of(stages[2])
    _, _, comp = brute_near(before.items(), 5, 80)
    assert set(rows_of(stages[3])) == {d for d, c in comp.items() if d == c}


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [(i, re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", t.lower()).strip()) for i, t in items]
    grams = {" ".join(w[s : s + 10]) for _, t in texts for w in [t.split()] for s in range(max(1, len(w) - 9))}
    plain = {d: re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", (t or "").lower()) for d, t in rows_of(stages[3]).items()}
    maybe = {d for d, t in plain.items() if any(g in t for g in grams)}
    hit = {d for d in maybe if brute_hits(rows_of(stages[3])[d], items)[1]}
    assert set(rows_of(stages[4])) == set(plain) - hit


def test_all_that_is_left_is_scheduled(stages):
    assert {r.doc_id for r in stages[5].collect()} == {d for d, t in rows_of(stages[4]).items() if (t or "").strip()}


def test_edges_and_nothing(spark):
    for rows in (EDGES, []):
        docs = frame(spark, rows)
        docs = docs.selectExpr("*", "n_chars AS TEXT", "n_chars AS score", "n_chars AS n_cut", "n_chars AS row")
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, f"edge-{name}")
            stage(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
            if rows and name != "mixing":
                assert {None, 1, 2, 3} <= {r.doc_id for r in docs.collect()}
        assert bool(rows) == (docs.count() > 0)
