"""Versions of a result store: empty ones, unfinished ones, writers at once, pages over many parts."""

import random

import pytest

from twinledger.operators import report
from twinledger.session import scratch_path
from twinledger.sources import sinks
from twinledger.sources import store as store_module
from twinledger.sources.store import RESULT_SCHEMA, ResultStore


def results(spark, rows):
    return spark.createDataFrame(
        [(i, s, f'{{"k":"{k}"}}', "{}", None, "[]", "both") for i, s, k in rows], RESULT_SCHEMA
    )


def test_empty_and_cleared_stores_can_be_read(spark):
    store = ResultStore(spark, scratch_path(spark, "store"))
    assert store.version() is None and store.versions() == []
    with pytest.raises(ValueError):
        store.read()
    store.clear()
    assert store.read().count() == 0 and store.read().columns == results(spark, []).columns
    assert store.page().count() == 0 and {r.n_rows for r in store.counts().collect()} == {0}
    first = store.append(results(spark, [(1, "match", "a")]))
    store.append(results(spark, []))
    store.clear()
    assert store.read().count() == 0 and store.read(first).count() == 1
    path = scratch_path(spark, "plain")
    sinks.clear_results(results(spark, []), path)
    assert sinks.load_results(spark, path).count() == 0


def test_unfinished_manifests_and_rival_writers(spark):
    store = ResultStore(spark, scratch_path(spark, "store"))
    store.append(results(spark, [(1, "match", "a")]))
    assert store.files.create("versions/000000000002.json", '{"parts": ["lost')
    assert store.version().number == 1 and store.read().count() == 1
    rival = ResultStore(spark, store.path)
    taken = store.files.create

    def late(name, text):
        store.files.create = taken
        rival.append(results(spark, [(2, "match", "b")]))
        return taken(name, text)

    store.files.create = late
    store.append(results(spark, [(3, "mismatch", "c")]))
    assert sorted(r.row_id for r in store.read().collect()) == [1, 2, 3]
    assert store.versions() == [1, 3, 4]
    with pytest.raises(ValueError):
        store.append(results(spark, [(4, "match", "d")]).drop("side"))


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_over_parts_with_ties(spark, seed):
    rng = random.Random(seed)
    store = ResultStore(spark, scratch_path(spark, "store"), rows_per_file=7)
    rows = []
    for _ in range(3):
        part = [(rng.randrange(40), rng.choice(["match", "mismatch"]), rng.randrange(99)) for _ in range(rng.randrange(1, 60))]
        rows += part
        store.append(results(spark, part))
    for status in (None, "mismatch"):
        want = sorted((i, s, f'{{"k":"{k}"}}') for i, s, k in rows if status in (None, s))
        for page in (1, 2, 4, 9):
            got = [tuple(r)[:3] for r in store.page(page, 11, status).collect()]
            assert got == want[(page - 1) * 11 : page * 11]


def test_small_blocks_make_no_small_files(spark):
    rows = [(i if i % 9 else None, "match" if i % 2 else "mismatch", i % 5) for i in range(3_000)]
    store = ResultStore(spark, scratch_path(spark, "store"), rows_per_file=10)
    store.append(results(spark, rows[:2_000]).repartition(4))
    store.append(results(spark, rows[2_000:]))
    assert len(store.read().inputFiles()) <= 32
    for status in (None, "mismatch"):
        kept = [(i, s, f'{{"k":"{k}"}}') for i, s, k in rows if status in (None, s)]
        want = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        for page, size in ((1, 100), (2, 150), (5, 100), (1, 5_000), (9, 400)):
            opened = store.page(page, size, status)
            assert [tuple(r)[:3] for r in opened.collect()] == want[(page - 1) * size : page * size]


def test_wide_pages_of_a_store_stay_distributed(spark, monkeypatch):
    for module in (report, store_module):
        monkeypatch.setattr(module, "SHALLOW_ROWS", 50)
    monkeypatch.setattr(report.cut_page, "__defaults__", (50,))
    rows = [(i, "match", i) for i in range(900)]
    store = ResultStore(spark, scratch_path(spark, "store"), rows_per_file=10)
    store.append(results(spark, rows[::2]))
    store.append(results(spark, rows[1::2]))
    page = store.page(2, 300)
    assert [r.row_id for r in page.collect()] == list(range(300, 600))
    assert "Limit" not in page._jdf.queryExecution().executedPlan().toString()
