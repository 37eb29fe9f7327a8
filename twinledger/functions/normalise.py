"""The value normaliser: an ordered fold of SQL expressions, no Python per row.

Order: text cast, trim, transform rules, empty to NULL, lower case, date text, number text.
"""

from __future__ import annotations

from typing import Any, Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

from twinledger.functions.dates import (
    format_common_date,
    format_date,
    iso_date,
    maybe_date,
    parse_date,
)
from twinledger.functions.numbers import (
    canonical_double,
    fixed_point,
    fixed_point_integer,
    looks_numeric,
    parse_double,
    short_decimal,
)
from twinledger.functions.text import bind, literal, quoted
from twinledger.plans.spec import CompareOptions, TransformRule

# The Unicode space separators a trim removes; tabs and newlines stay.
SPACE_SEPARATORS = (
    " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)
# Words the date parser knows; an endless date has the same text in any format.
_EPOCH = literal(r"(?i)^\s*-?epoch\s*$")
_ENDLESS = literal(r"(?i)^-?inf(?:inity)?$")
# Codes of the first characters that a date or number text may have besides digits in
# the case of dates: white space, signs, the point, and the letters of epoch, inf and nan.
_WHITE = "9, 10, 11, 12, 13, 32"
_DATE_STARTS = f"{_WHITE}, 43, 45, 69, 73, 101, 105"
_NUMBER_STARTS = f"{_WHITE}, 43, 45, 46, 73, 78, 105, 110, {', '.join(str(c) for c in range(48, 58))}"
_NEVER_SPACED = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)


def as_text(x: str, data_type: DataType | None = None) -> str:
    """Any value as canonical text; doubles keep one spelling at every magnitude."""
    if isinstance(data_type, DoubleType):
        return canonical_double(x)
    return f"CAST({x} AS STRING)"


def _ascii(text: str) -> str:
    return f"octet_length({text}) = char_length({text})"


def trim_text(text: str) -> str:
    """Trim every Unicode space; ASCII values take the plain trim, which is far cheaper."""
    wide = f"trim(BOTH {literal(SPACE_SEPARATORS)} FROM {text})"
    return f"CASE WHEN {_ascii(text)} THEN trim({text}) ELSE {wide} END"


def lower_text(text: str) -> str:
    """Per-character lower case: the two letters with contextual forms are mapped first."""
    plain = f"lower(translate({text}, 'İΣ', 'iσ'))"
    return f"CASE WHEN {_ascii(text)} THEN lower({text}) ELSE {plain} END"


def _prefix(text: str, params: dict[str, Any]) -> str:
    return f"concat_ws('', {literal(str(params.get('text', '')))}, {text})"


def _suffix(text: str, params: dict[str, Any]) -> str:
    return f"concat_ws('', {text}, {literal(str(params.get('text', '')))})"


def _pad(function: str, default: str) -> Callable[[str, dict], str]:
    def apply(text: str, params: dict[str, Any]) -> str:
        length = max(1, int(params.get("length", 10)))
        filler = str(params.get("pad_char", default))[:1] or default
        return f"{function}({text}, {length}, {literal(filler)})"

    return apply


def _strip_chars(text: str, params: dict[str, Any]) -> str:
    unwanted = str(params.get("chars", ""))
    return f"translate({text}, {literal(unwanted)}, '')" if unwanted else text


def _replace(text: str, params: dict[str, Any]) -> str:
    old = str(params.get("old", ""))
    new = literal(str(params.get("new", "")))
    return f"replace({text}, {literal(old)}, {new})" if old else text


def _substring(text: str, params: dict[str, Any]) -> str:
    start, length = (max(1, int(params.get(k, d))) for k, d in (("start", 1), ("length", 10)))
    return f"substring({text}, {start}, {length})"


TRANSFORMS: dict[str, Callable[[str, dict], str]] = {
    "prefix": _prefix,
    "suffix": _suffix,
    "lpad": _pad("lpad", "0"),
    "rpad": _pad("rpad", " "),
    "strip_chars": _strip_chars,
    "replace": _replace,
    "substring": _substring,
}


def apply_rule(text: str, rule: TransformRule) -> str:
    """One transform; an unknown kind leaves the value as it is."""
    transform = TRANSFORMS.get(rule.transform_type)
    return transform(text, rule.params) if transform and rule.enabled else text


def normalise_date(text: str, pattern: str) -> str:
    """Dates as formatted text, anything else unchanged; ISO dates take the short way."""
    common = format_common_date(f"try_cast(substring({text}, 1, 10) AS DATE)", pattern)
    loose = bind(parse_date("nd"), "nf", format_date("nf", pattern))
    epoch = format_common_date("DATE'1970-01-01'", pattern)
    dashed = f"substring({text}, 5, 1) = '-' AND {iso_date(text)}"
    dated = (
        f"WHEN {dashed} THEN coalesce({common}, {text}) "
        f"WHEN {maybe_date(text)} THEN {bind(text, 'nd', f'coalesce({loose}, nd)')}"
    )
    return (
        f"CASE WHEN ascii({text}) BETWEEN 48 AND 57 THEN CASE {dated} ELSE {text} END "
        f"WHEN ascii({text}) NOT IN ({_DATE_STARTS}) THEN {text} {dated} "
        f"WHEN {text} RLIKE {_EPOCH} THEN {epoch} "
        f"WHEN {text} RLIKE {_ENDLESS} THEN regexp_replace(lower({text}), 'inf.*', 'infinity') "
        f"ELSE {text} END"
    )


def normalise_number(text: str, places: int) -> str:
    """Numbers as fixed-point text, anything else unchanged; short decimals need no double."""
    plain, rounded = short_decimal(text, places)
    number = bind(parse_double("nt"), "nv", fixed_point("nv", places))
    return (
        f"CASE WHEN ascii({text}) NOT IN ({_NUMBER_STARTS}) THEN {text} "
        f"WHEN {plain} THEN {rounded} "
        f"WHEN {looks_numeric(text)} THEN {bind(text, 'nt', f'coalesce({number}, nt)')} "
        f"ELSE {text} END"
    )


def _typed(x: str, options: CompareOptions, data_type: DataType | None) -> str | None:
    """Shortcut for columns whose type already settles the date or number step."""
    if isinstance(data_type, (DateType, TimestampType, TimestampNTZType)):
        if options.normalize_date:
            text = format_date(f"CAST({x} AS DATE)", options.date_format)
            if options.normalize_number:
                text = bind(text, "ty", normalise_number("ty", options.decimal_places))
            return text
    elif isinstance(data_type, IntegralType):
        if options.normalize_number:
            return fixed_point_integer(x, options.decimal_places)
        return f"CAST({x} AS STRING)"
    elif isinstance(data_type, DoubleType):
        if options.normalize_number:
            return fixed_point(x, options.decimal_places)
        return canonical_double(x)
    return None


def normalise_steps(
    x: str,
    options: CompareOptions,
    rules: Iterable[TransformRule] = (),
    data_type: DataType | None = None,
) -> tuple[str, list[Callable[[str], str]]]:
    """Cleaning of the SQL expression ``x`` of the given type: a first expression and the steps after.

    A step names its input several times, so each is meant to read a column that holds the last one's
    result. Applied as projections one after another, the text grows with the number of steps.
    """
    if isinstance(data_type, FloatType):
        x, data_type = f"CAST(CAST({x} AS STRING) AS DOUBLE)", DoubleType()
    rules = [r for r in rules if r.enabled]
    shortcut = None if rules else _typed(x, options, data_type)
    if shortcut is not None:
        return shortcut, []
    text = as_text(x, data_type)
    if options.trim_whitespace and not isinstance(data_type, _NEVER_SPACED):
        text = trim_text(text)
    for rule in rules:
        text = apply_rule(text, rule)
    steps: list[Callable[[str], str]] = []
    if options.treat_empty_as_null:
        text = f"nullif({text}, '')"
    if options.ignore_case:
        steps.append(lower_text)
    if options.normalize_date:
        steps.append(lambda t: normalise_date(t, options.date_format))
    if options.normalize_number:
        steps.append(lambda t: normalise_number(t, options.decimal_places))
    return text, steps


def normalise_expression(
    x: str,
    options: CompareOptions,
    rules: Iterable[TransformRule] = (),
    data_type: DataType | None = None,
) -> str:
    """The same as one expression, each step evaluated once under a name."""
    text, steps = normalise_steps(x, options, rules, data_type)
    for number, step in enumerate(steps):
        text = bind(text, f"v{number}", step(f"v{number}"))
    return text


def normalise_columns(
    df: DataFrame,
    kept: list[Column],
    columns: list[tuple[str, str, Iterable[TransformRule]]],
    options: CompareOptions,
) -> DataFrame:
    """``kept`` columns and, for each (name, alias, rules), the cleaned value under its alias.

    One projection per step: a step that reads its input more than once keeps Catalyst from pasting
    the steps together, so each value is worked out once per step.
    """
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    plans = [
        (alias, *normalise_steps(quoted(name), options, rules, types.get(name.lower())))
        for name, alias, rules in columns
    ]
    out = df.select(*kept, *[F.expr(first).alias(alias) for alias, first, _ in plans])
    others = [quoted(c) for c in out.columns[: len(kept)]]
    for number in range(max((len(steps) for *_, steps in plans), default=0)):
        out = out.select(*map(F.expr, others), *[
            F.expr(steps[number](quoted(alias)) if number < len(steps) else quoted(alias)).alias(alias)
            for alias, _, steps in plans
        ])
    return out


def normalise(
    name: str,
    options: CompareOptions,
    rules: Iterable[TransformRule] = (),
    data_type: DataType | None = None,
) -> Column:
    """The cleaned value of a column, by its name."""
    return F.expr(normalise_expression(quoted(name), options, rules, data_type))


def normalise_mapping_value(name: str, options: CompareOptions) -> Column:
    """Mapping cells get trim, empty to NULL and case only — never rules, dates or numbers."""
    plain = CompareOptions(
        trim_whitespace=options.trim_whitespace,
        treat_empty_as_null=options.treat_empty_as_null,
        ignore_case=options.ignore_case,
    )
    return normalise(name, plain)


def key_text(name: str, data_type: DataType | None = None) -> Column:
    """Keys are only cast and trimmed, whatever the options say."""
    text = as_text(quoted(name), data_type)
    return F.expr(text if isinstance(data_type, _NEVER_SPACED) else trim_text(text))
