import os

import pytest
from pyspark.sql import functions as F

from twinledger.plans.run import run_compare
from twinledger.plans.spec import MISSING_TOKENS, CompareSpec, SourceSpec, TransformRule
from twinledger.session import scratch_path
from twinledger.sources import jdbc, load, mapping, sinks


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_is_all_text_with_safe_names(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id;1st name;na me;na-me\n01;"x;y";"say ""hi""";\n')
    assert load.detect_separator(spark, path) == ";"
    df = load.load_source(spark, SourceSpec(file_path=path, csv_separator=";"))
    assert df.columns == ["id", "col_1st_name", "na_me", "na_me_2"]
    assert rows(df) == [("01", "x;y", 'say "hi"', None)]


def test_csv_options(spark, tmp_path):
    path = write(tmp_path, "b.csv", "note\nmore,\nid,v\n1,NA\n2,é\n", "latin-1")
    source = SourceSpec("csv", path, csv_encoding="latin-1", skip_rows=2, null_tokens=MISSING_TOKENS)
    assert sorted(rows(load.load_source(spark, source))) == [("1", None), ("2", "é")]
    bare = write(tmp_path, "c.csv", "1,a\n2,b\n")
    df = load.load_source(spark, SourceSpec("csv", bare, has_header=False))
    assert (df.columns, rows(df)) == (["col_0", "col_1"], [("1", "a"), ("2", "b")])
    broken = write(tmp_path, "d.csv", 'id,v\n1,"two\nlines"\n')
    df = load.load_source(spark, SourceSpec("csv", broken, multi_line=True))
    assert rows(df) == [("1", "two\nlines")]


def test_header_only_source_is_an_empty_table(spark, tmp_path):
    df = load.load_source(spark, SourceSpec("csv", write(tmp_path, "e.csv", "id,v\n")))
    assert (df.columns, df.count()) == (["id", "v"], 0)


def test_unknown_sources_are_refused(spark):
    with pytest.raises(ValueError):
        load.load_source(spark, SourceSpec(file_path="x.doc"))


def test_columnar_table_and_sql_sources(spark):
    data = spark.createDataFrame([(1, "a")], "id int, `v w` string")
    for fmt in ("parquet", "orc", "json"):
        path = scratch_path(spark, fmt)
        data.write.format(fmt).save(path)
        assert load.load_source(spark, SourceSpec(fmt, path)).select("v_w").first() == ("a",)
    data.createOrReplaceTempView("some_rows")
    assert load.load_source(spark, SourceSpec("table", table_name="some_rows")).count() == 1
    query = SourceSpec("sql", custom_query="SELECT id + 1 AS id FROM some_rows")
    assert rows(load.load_source(spark, query)) == [(2,)]


def test_jdbc_options():
    link = {"host": "h", "port": 1, "database": "d", "username": "u", "password": "p"}
    pg = SourceSpec("postgres", schema_name='s"x', table_name="t", pg_connection_inline=link)
    options = jdbc.jdbc_options(pg)
    assert options["url"] == "jdbc:postgresql://h:1/d" and options["dbtable"] == '"s""x"."t"'
    my = SourceSpec(
        "mysql", schema_name="s", table_name="t", pg_connection_inline=link,
        partition_column="id", lower_bound="0", upper_bound="9", num_partitions=3,
    )
    options = jdbc.jdbc_options(my)
    assert options["dbtable"] == "`s`.`t`" and options["numPartitions"] == "3"
    custom = SourceSpec("postgres", custom_query="SELECT 1", use_custom_query=True)
    assert jdbc.relation(custom) == "(SELECT 1) AS _q"
    with pytest.raises(ValueError):
        jdbc.jdbc_options(SourceSpec("postgres", table_name="t", partition_column="id"))
    assert "'pg_toast'" in jdbc.schemas_query("postgres")
    assert "'o''k'" in jdbc.columns_query("o'k", "t")


def test_mapping_without_header(spark, tmp_path):
    path = write(tmp_path, "m.csv", "﻿A, x ,1\n ,lost,2\nA\nB,,\nB,y,,z\n")
    columns, found = mapping.read_mapping(spark, path)
    assert columns == ["col_0", "col_1", "col_2"]
    assert sorted(rows(found)) == [("A", "x", "1", ""), ("B", "y", "", "z")]
    columns, found = mapping.read_mapping(spark, path, ["p"])
    assert (columns, sorted(rows(found))) == (["p"], [("A", "x"), ("B", "y")])


def test_mapping_header_is_one_row_only(spark, tmp_path):
    path = write(tmp_path, "h.csv", "Nilai_Kiri,p,q\nA,x,1\n")
    assert mapping.read_mapping(spark, path)[0] == ["p", "q"]
    path = write(tmp_path, "k.csv", "left_value,seg\nA,x\nkiri,y\nB,z\n")
    columns, found = mapping.read_mapping(spark, path)
    assert (columns, sorted(rows(found))) == (["seg"], [("A", "x"), ("B", "z"), ("kiri", "y")])


def test_preview_profile_and_catalog(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    assert load.preview(df, 1).count() == 1 and load.preview(df, None).count() == 2
    assert sorted(rows(load.column_profile(df, "left"))) == [("id", 2), ("v", 1)]
    assert "default" in load.catalog_schemas(spark)


def test_exports_keep_spaces_and_shard(spark):
    results = spark.createDataFrame(
        [(i, "match", f'{{"k":" {i}"}}', "{}", "{}", "[]") for i in range(10)],
        "row_id long, status string, key_values string, left_data string, right_data string, diff_columns string",
    )
    path = scratch_path(spark, "export")
    sinks.export_results(results, path, sheet_rows=4)
    back = load.load_source(spark, SourceSpec("csv", path))
    assert back.count() == 10 and back.where("row_id = '3'").first().key_values == '{"k":" 3"}'
    store = scratch_path(spark, "store")
    sinks.save_results(results, store)
    sinks.clear_results(sinks.load_results(spark, store), scratch_path(spark, "cleared"))
    assert sinks.load_results(spark, store).where("status = 'match'").count() == 10


def test_expected_export_opens_with_a_byte_order_mark(spark):
    expected = spark.createDataFrame([(2, "b"), (1, "a")], "row_id long, k string")
    path = scratch_path(spark, "expected")
    sinks.export_expected(expected.coalesce(1), path)
    files = [f for f in os.listdir(path) if f.endswith(".csv")]
    data = b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(files))
    assert data.startswith(b"\xef\xbb\xbfk\na\n") and b"b\n" in data


def test_run_compare_from_files(spark, tmp_path):
    left = write(tmp_path, "l.csv", "id,v\n1,a\n2,b\n3,c\n")
    right = write(tmp_path, "r.csv", "key;w\n1;S-a\n2;x\n4;d\n")
    spec = CompareSpec.from_dict({
        "left_source": {"source_type": "csv", "file_path": left},
        "right_source": {"source_type": "csv", "file_path": right, "csv_separator": ";"},
        "key_columns": [{"left_col": "id", "right_col": "key"}],
        "compare_columns": [{"left_col": "v", "right_col": "w"}],
    })
    rule = TransformRule("v", "left", "prefix", {"text": "S-"})
    result = run_compare(spark, spec, rules=[rule])
    assert result.summary() == {
        "total_rows": 4, "match": 1, "mismatch": 1, "missing_left": 1, "missing_right": 1,
        "duplicate_key": 0, "_left_rows": 3, "_right_rows": 3,
    }
    assert result.page(1, 2).count() == 2
    assert {r.row_id: r.status for r in result.results.where("side <> 'right'").collect()} == {
        1: "match", 2: "mismatch", 3: "missing_right",
    }
