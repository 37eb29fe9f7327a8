"""Building blocks for SQL expression text.

Value rules are written as SQL expressions and handed to Spark whole: a deep expression then
costs one parse instead of a driver round trip per node, which matters for wide tables.
"""

from __future__ import annotations


def quoted(name: str) -> str:
    """A column reference by its literal name."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    """A string literal, whatever the text holds."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(expression: str, variable: str, body: str) -> str:
    """Evaluate an expression once and use it in ``body`` under a name."""
    return f"transform(array({expression}), {variable} -> {body})[0]"
