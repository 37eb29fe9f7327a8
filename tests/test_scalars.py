import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from twinledger.functions.dates import format_date, parse_date
from twinledger.functions.normalise import lower_text, normalise, trim_text
from twinledger.functions.numbers import canonical_double, fixed_point, parse_double
from twinledger.functions.text import bind
from twinledger.plans.spec import CompareOptions, TransformRule

DATES = [
    "2024-01-05", "2024/1/5", "24-01-05", "5-01-05", "12024-01-05", "2024 01 05", "2024\\01\\05",
    "2024-01-05 10:11", "2024-01-05 10:11:12.5", "2024-01-05T10:11:12Z", "2024-01-05 10:11:12+07",
    " 2024-01-05 ", "2024-01-05 x", "2024-01-05 25:00", "2024-01-05 10", "2024-1-5 1:2:3",
    "2024-01/05", "2024-001-05", "-2024-01-05", "0000-01-01", "2024-13-01", "2023-02-29",
    "2024-01-05T", "2024-01-05 10:11:", "2024-01-05 10:11:12 UTC", "2024-01-05 10:11:12z", "2024-01-05 10:11:12 utc", "2024-01-05 10:11:12utc", "+2024-01-05", "\t2024-01-05",
    "14/01/2021", "20240105", "2024", "12345", "2024-02-30", "2024-01", "2024-01-05abc",
    " 024-01-05", "epoch", " EPOCH", "infinity", "-INF", "2024-01-05 24:00:00", "1582-10-10", "", None, "abc",
]
NUMBERS = [
    "1e3", " 12.345 ", "1d", "1f", "1,000", ".5", "+5", "abc", "", "5.", "1_000", "1__0", "_1",
    "0x10", "nan", "NaN", "inf", "-inf", "Infinity", "1e400", "1e-400", "-0.001", "-0", "1E5",
    "1e", "1.2.3", "--5", "2.675", "0.125", "1e22", "1e23", "\t5", "1 2", "true", "1_0.5_5",
    "9007199254740993.5", "4503599627370496.5", "1L", ".", "+.5e1", "-.5", "0.005", "0.015",
    "1.005", "1.115", "0.5", "1.5", "2.5", "-2.5", "9.995", "1e18", "9.3e18", "0.0001", None,
    "12345678.125", "12345678.135", "-0.125", "-0.5", "0.045", "123456789012.345",
]


@pytest.fixture(scope="module")
def db():
    return duckdb.connect()


def evaluate(spark, values, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", *[F.expr(e).alias(f"c{k}") for k, e in enumerate(expressions)])
    return [tuple(r)[1:] for r in sorted(rows.collect())]


def expected(db, values, *expressions):
    inner = ", ".join(expressions)
    return [db.execute(f"SELECT {inner} FROM (SELECT ?::VARCHAR AS s)", [v]).fetchall()[0] for v in values]


def test_parsed_dates(spark, db):
    words = ("epoch", " EPOCH", "infinity", "-INF")
    dates = [d for d in DATES if d not in words]
    patterns = ["%Y-%m-%d", "%d/%m/%y %b %B %a %A %j %H:%M:%S %f %p %I %-d %-m %% %w %u"]
    ours = evaluate(
        spark, dates, *[bind(parse_date("s"), "d", format_date("d", p)) for p in patterns]
    )
    theirs = expected(db, dates, *[f"TRY(STRFTIME(TRY_CAST(s AS DATE), '{p}'))" for p in patterns])
    assert ours == theirs


def test_fixed_point_numbers(spark, db):
    rng = random.Random(5)
    values = NUMBERS + [repr(rng.uniform(-1000, 1000)) for _ in range(300)]
    values += [f"{rng.randint(0, 10**7) / 1000}5" for _ in range(300)]
    values += [
        repr(x)
        for x in (struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(300))
        if abs(x) < 9e37
    ]
    v = parse_double("s")
    ours = evaluate(spark, values, *[bind(v, "v", fixed_point("v", p)) for p in (2, 0, 5)])
    theirs = expected(
        db, values, *[f"TRY(PRINTF('%.{p}f', TRY_CAST(s AS DOUBLE)))" for p in (2, 0, 5)]
    )
    assert ours == theirs


def test_canonical_doubles_below_1e16(spark, db):
    values = ["1e7", "1.5e15", "0.0001", "0.00015", "1e-5", "123456789.125", "0.001", "0",
              "nan", "inf", "-inf", "12345678.9", "1e16", "1e100", "1e-100", "-0.00012", None]
    ours = evaluate(spark, values, bind("CAST(s AS DOUBLE)", "v", canonical_double("v")))
    assert ours == expected(db, values, "CAST(CAST(s AS DOUBLE) AS VARCHAR)")


def any_doubles(rng):
    """Random bit patterns, powers of two, decimals of all lengths, the ends of the range."""
    values = [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(800)]
    values += [2.0**k for k in range(-1074, 1024, 3)]
    values += [float(f"{rng.randint(1, 10 ** rng.randint(1, 17))}E{rng.randint(-320, 290)}") for _ in range(800)]
    values += [5e-324, 1e-323, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
               2e23, 8.41e21, 9e22, 1e16, 9.999e-5, 0.0, -0.0, 2.0**126]
    return [v for v in values if v == v]


def test_shortest_texts_of_any_double(spark):
    values = any_doubles(random.Random(11))
    ours = evaluate(spark, [repr(v) for v in values], bind("CAST(s AS DOUBLE)", "v", canonical_double("v")))
    assert [o[0] for o in ours] == [repr(v) for v in values]


def test_fixed_point_of_any_double(spark):
    values = any_doubles(random.Random(12)) + [1e308, -1e308, 9e37, 1e38, 2.0**63, 2.0**1023]
    ours = evaluate(
        spark, [repr(v) for v in values], *[bind("CAST(s AS DOUBLE)", "v", fixed_point("v", p)) for p in (2, 0)]
    )
    assert ours == [(f"{v:.2f}", f"{v:.0f}") for v in values]


@pytest.mark.parametrize("options", [
    CompareOptions(),
    CompareOptions(normalize_date=True, date_format="%d.%m.%Y"),
    CompareOptions(normalize_number=True),
    CompareOptions(ignore_case=True, normalize_date=True, normalize_number=True, date_format="%Y"),
    CompareOptions(trim_whitespace=False, treat_empty_as_null=False, normalize_number=True),
])
def test_normaliser_folds_its_steps_in_order(spark, db, options):
    e = "TRIM(s)" if options.trim_whitespace else "s"
    if options.treat_empty_as_null:
        e = f"NULLIF({e}, '')"
    if options.ignore_case:
        e = f"LOWER({e})"
    if options.normalize_date:
        e = f"COALESCE(TRY(STRFTIME(TRY_CAST({e} AS DATE), '{options.date_format}')), {e})"
    if options.normalize_number:
        e = f"COALESCE(TRY(PRINTF('%.2f', TRY_CAST({e} AS DOUBLE))), {e})"
    values = DATES + NUMBERS
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    ours = [(r[1],) for r in sorted(df.select("i", normalise("s", options)).collect())]
    assert ours == expected(db, values, e)


def test_default_normaliser_is_idempotent(spark):
    values = DATES + NUMBERS
    df = spark.createDataFrame([(v,) for v in values], "s string")
    once = df.select(normalise("s", CompareOptions()).alias("s"))
    twice = once.select("s", normalise("s", CompareOptions()).alias("t"))
    assert twice.where("NOT (s <=> t)").count() == 0


def test_trim_and_lower_follow_unicode(spark, db):
    values = ["  a ", "\ta ", " a　 ", "ÄİI", "ΑΣ", "ß", "Ǆ", "​a", ""]
    ours = evaluate(spark, values, trim_text("s"), lower_text("s"))
    assert ours == expected(db, values, "TRIM(s)", "LOWER(s)")


def test_rules_with_hostile_text(spark):
    df = spark.createDataFrame([("a'b\\c",), (None,)], "s string")
    keep_empty = CompareOptions(treat_empty_as_null=False)

    def run(kind, **params):
        rule = TransformRule("s", "both", kind, params)
        return [r[0] for r in df.select(normalise("s", keep_empty, [rule])).collect()]

    assert run("prefix", text="x'\\") == ["x'\\a'b\\c", "x'\\"]
    assert run("suffix", text="%") == ["a'b\\c%", "%"]
    assert run("strip_chars", chars="'\\") == ["abc", None]
    assert run("replace", old="'", new="\\") == ["a\\b\\c", None]
    assert run("replace", old="", new="z") == ["a'b\\c", None]
    assert run("lpad", length=0) == ["a", None]
    assert run("substring", start=-3, length="2") == ["a'", None]
    assert run("no_such_rule") == ["a'b\\c", None]


def test_unknown_date_token_is_an_error():
    with pytest.raises(ValueError):
        format_date("d", "%Q")
