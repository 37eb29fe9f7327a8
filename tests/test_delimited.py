"""Delimited text in splits against a plain reader, with quotes on the borders of the splits."""

import csv
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinledger.plans.spec import SourceSpec
from twinledger.sources import delimited, load
from twinledger.sources.delimited import LineStates, states_before


def plain_state(line: bytes, inside: int, sep: int) -> int:
    """Character by character: a quote opens only at the beginning of a field."""
    at, begin = 0, not inside
    while at < len(line):
        byte = line[at]
        if inside:
            if byte == 34:
                if line[at + 1 : at + 2] == b'"':
                    at += 1
                else:
                    inside = 0
            begin = False
        elif byte == sep:
            begin = True
        else:
            inside = 1 if byte == 34 and begin else 0
            begin = False
        at += 1
    return int(bool(inside))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='",;a \r', max_size=14))
def test_line_states_by_characters(text):
    line = text.encode()
    want = tuple(plain_state(line, start, 44) for start in (0, 1))
    assert LineStates(",").after(line) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([(0, 0), (0, 1), (1, 0), (1, 1)]), max_size=12), st.integers(0, 1))
def test_states_are_composed_in_order(functions, start):
    states = [start]
    for function in functions:
        states.append(function[states[-1]])
    assert states_before(np.array(functions, dtype=np.int64).reshape(-1, 2), start).tolist() == states


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_quotes_on_split_borders(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    texts = ["", "a", "b;c", 'q"q', "two\nlines", '\n"\n', ";\n;", "é\n\n\nü", " "]
    want = []
    for number in range(3):
        rows = [[str(i), rng.choice(texts), rng.choice(texts)] for i in range(rng.randrange(40, 90))]
        out = io.StringIO()
        writer = csv.writer(out, delimiter=";", lineterminator=end)
        writer.writerows([["id", "x", "y"], *rows])
        (tmp_path / f"{number}.csv").write_bytes(out.getvalue().encode())
        want += [tuple(v or None for v in row) for row in rows]
    small_splits(101)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    source = SourceSpec("csv", str(tmp_path), csv_separator=";")
    got = load.load_numbered(spark, source, "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(want) + 1))
    assert [tuple(r)[:3] for r in got] == want


def test_rows_are_skipped_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"\nkey;v\n1;a\n\n2;b\n')
    (tmp_path / "b.csv").write_text('title\n1;x\n\nkey;v\n3;c\n')
    (tmp_path / "c.csv").write_text("only\n")
    source = SourceSpec("csv", str(tmp_path), csv_separator=";", skip_rows=2)
    got = load.load_source(spark, source)
    assert got.columns == ["key", "v"]
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_separator_is_voted_by_all_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a;b;c\n" * 60 + "x,y\n" * 70 + '"p;q;r",z\n' * 5)
    assert load.detect_separator(spark, str(tmp_path)) == ","
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.txt").write_text("word\nother word\n")
    assert load.detect_separator(spark, str(tmp_path / "b")) == ","


def test_states_by_expression_equal_the_characters(spark):
    rng = random.Random(5)
    for separator in ",|\t;":
        texts = ["".join(rng.choice(f'"{separator}a \r\u00e9') for _ in range(rng.randrange(12))) for _ in range(400)]
        texts += ['"' + 'x""' * 2_000, "a" * 3_000]
        lines = spark.createDataFrame([(t,) for t in texts], "value string")
        shown = lines.select("value", *delimited._line_states(F.col("value"), separator, True)).collect()
        for row in shown:
            line = row.value.encode()
            if len(line) > delimited.SHORT_LINE and '"' in row.value:
                assert row.after_0 is None and row.after_1 is None
            else:
                assert (row.after_0, row.after_1) == tuple(plain_state(line, start, ord(separator)) for start in (0, 1))
            assert row.wanted == bool(line.strip())


def test_many_small_splits_share_tasks(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"x\n""{"y" * (i % 7 * 300)}""\n"\n' for i in range(600)))
    small_splits(2_000)
    splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    lines = delimited.scanned_lines(spark, str(tmp_path), ",")
    assert len(lines.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism < splits
    assert lines.select("file", "block").distinct().count() > 100
    got = load.load_numbered(spark, SourceSpec("csv", str(tmp_path)), "n").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(str(i), f'x\n"{"y" * (i % 7 * 300)}"\n', i + 1) for i in range(600)]
