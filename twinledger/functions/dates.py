"""Guarded date parsing and strftime-style formatting as SQL expressions."""

from __future__ import annotations

import re

from twinledger.functions.text import bind, literal

_TIME = (
    r"(?:T|[ ]+)(?:(?:[01]?\d|2[0-3]):[0-5]?\d(?::(?:[0-5]?\d(?:\.\d*)?)?)?|24:00(?::00)?)"
    r"(?:Z|[ ]*[+-]\d{1,2}(?::?\d{2})?|[ ]+(?i:UTC|Z))?"
)
_DATE = literal(rf"^\s*(-?\d+)([-/ \\])(\d{{1,2}})\2(\d{{1,2}})(?:{_TIME})?\s*$")
_MAYBE_DATE = literal(r"^\s*-?\d+[-/ \\]\d")
_ISO_DATE = literal(
    r"^(?!0000)\d{4}-\d\d-\d\d(?:[ T](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?)?$"
)
_MARK = "\u0001"


def maybe_date(text: str) -> str:
    return f"{text} RLIKE {_MAYBE_DATE}"


def iso_date(text: str) -> str:
    """Test for an ISO date, alone or with a full time; its first ten characters then cast."""
    return f"{text} RLIKE {_ISO_DATE}"


def parse_date(text: str) -> str:
    """Date from year-month-day text with one repeated separator and an optional valid time."""
    wide = f"regexp_replace(substring(dm, 2, 40), {literal(r'^(-?)(\d{1,3})-')}, '$1000$2-')"
    iso = f"regexp_replace({wide}, {literal(r'^(-?)0+(\d{4,})-')}, '$1$2-')"
    marked = f"regexp_replace({text}, {_DATE}, '{_MARK}$1-$3-$4')"
    return bind(
        marked, "dm", f"CASE WHEN startswith(dm, '{_MARK}') THEN try_cast({iso} AS DATE) END"
    )


def _year(day: str) -> str:
    size = f"abs(year({day}))"
    return (
        f"concat(CASE WHEN year({day}) < 0 THEN '-' ELSE '' END, "
        f"CASE WHEN {size} < 1000 THEN lpad({size}, 4, '0') ELSE CAST({size} AS STRING) END)"
    )


def _token(day: str, token: str) -> str:
    # The supported tokens; a date has no time of day.
    constants = {
        "%H": "00", "%M": "00", "%S": "00", "%f": "000000", "%g": "000", "%I": "12",
        "%p": "AM", "%-H": "0", "%-M": "0", "%-S": "0", "%-I": "12", "%%": "%",
    }
    pieces = {
        "%Y": _year(day),
        "%y": f"lpad(abs(year({day})) % 100, 2, '0')",
        "%m": f"lpad(month({day}), 2, '0')",
        "%d": f"lpad(day({day}), 2, '0')",
        "%j": f"lpad(dayofyear({day}), 3, '0')",
        "%b": f"date_format({day}, 'MMM')",
        "%B": f"date_format({day}, 'MMMM')",
        "%a": f"date_format({day}, 'EEE')",
        "%A": f"date_format({day}, 'EEEE')",
        "%w": f"CAST(dayofweek({day}) - 1 AS STRING)",
        "%u": f"CAST(weekday({day}) + 1 AS STRING)",
        "%-m": f"CAST(month({day}) AS STRING)",
        "%-d": f"CAST(day({day}) AS STRING)",
        "%-j": f"CAST(dayofyear({day}) AS STRING)",
        "%-y": f"CAST(abs(year({day})) % 100 AS STRING)",
    }
    if token in constants:
        return literal(constants[token])
    if token not in pieces:
        raise ValueError(f"unsupported date format token {token!r}")
    return pieces[token]


# Format tokens and their date_format letters, for four-digit years.
_LETTERS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%j": "DDD", "%b": "MMM", "%B": "MMMM",
    "%a": "EEE", "%A": "EEEE", "%-m": "M", "%-d": "d",
}


def _pieces(pattern: str) -> list[tuple[bool, str]]:
    """The pattern as (is token, text) pieces."""
    found = re.findall(r"%-?.|[^%]+|%$", pattern, re.DOTALL)
    return [(piece.startswith("%"), piece) for piece in found]


def format_date(day: str, pattern: str) -> str:
    """strftime of a date; an unknown token is an error instead of silent text."""
    parts = [_token(day, p) if token else literal(p) for token, p in _pieces(pattern)]
    known = f"CASE WHEN {day} IS NOT NULL THEN '' END"
    return f"concat({', '.join([known, *parts])})"


def format_common_date(day: str, pattern: str) -> str:
    """The same for years 1 to 9999, as one date_format call where every token has letters."""
    pieces = _pieces(pattern)
    if any(token and p not in _LETTERS for token, p in pieces):
        return bind(day, "fd", format_date("fd", pattern))
    letters = [
        _LETTERS[p] if token else "'" + p.replace("'", "''") + "'" for token, p in pieces
    ]
    return f"date_format({day}, {literal(''.join(letters))})"
