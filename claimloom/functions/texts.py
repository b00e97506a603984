"""Text building and tolerant parsing as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(column: Column) -> Column:
    """The trimmed text, NULL when blank."""
    return F.nullif(F.trim(column), F.lit(""))


def filled(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` parts; NULL parts make the text NULL."""
    pieces = re.split(r"\{(\w+)\}", template)
    columns = [F.lit(p) if i % 2 == 0 else parts[p].cast("string") for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*columns)


def chosen(table: dict[str, Column | str], key: Column, default: Column | None = None) -> Column:
    """The table's entry for ``key``; a chain of conditions, so entries may be columns."""
    out = default if default is not None else F.lit(None).cast("string")
    for name, value in reversed(list(table.items())):
        out = F.when(key == name, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def looked_up(table: dict[str, str], key: Column) -> Column:
    """The entry of a literal map; NULL when absent."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(literal, key)


def service_date(text: Column) -> Column:
    """The first of year-first, day-first and month-first that fits, with ``-``, ``.`` or ``/``."""
    dashed = F.translate(F.trim(text), "./", "--")
    return F.coalesce(*[F.try_to_date(dashed, p) for p in ("yyyy-M-d", "d-M-yyyy", "M-d-yyyy")])
