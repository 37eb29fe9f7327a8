"""JSON text of keys, rows and difference lists."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def json_object(fields: dict[str, Column]) -> Column:
    """``{"name":"value",…}`` with NULLs kept; ``{}`` for no fields."""
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), _KEEP_NULLS)


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def any_differs(pairs: list[tuple[Column, Column]]) -> Column:
    found = F.lit(False)
    for left, right in pairs:
        found = found | differs(left, right)
    return found


def json_names(flags: dict[str, Column]) -> Column:
    """JSON array of the names whose flag holds, joined from literals without an array."""
    if not flags:
        return F.lit("[]")
    quoted = [
        F.when(flag, F.lit(json.dumps(name, ensure_ascii=False))) for name, flag in flags.items()
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))
