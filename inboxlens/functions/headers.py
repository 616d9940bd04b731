"""Header look-up over ``ARRAY<STRUCT<name, value>>``.

Built from ``array_join`` / ``split`` / ``array_position`` / ``get`` so the
look-up stays in generated code (no interpreted array lambda per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# header names are printable ASCII, so this separator never occurs inside one
_SEP = "\u0001"


def header_names_lower(headers: Column | str) -> Column:
    """Lower-cased header names, position for position (null names become '')."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.split(F.lower(F.array_join(h["name"], _SEP, "")), _SEP)


def header_value(headers: Column | str, name: str, default: str | None = "",
                 names_lower: Column | str | None = None) -> Column:
    """Value of the first header whose name equals ``name`` ignoring case.

    A missing array or no match gives ``default``. Pass ``names_lower``
    (see :func:`header_names_lower`) when several headers are read from the
    same array, so the names are lower-cased once.
    """
    h = F.col(headers) if isinstance(headers, str) else headers
    if names_lower is None:
        names = header_names_lower(h)
    else:
        names = F.col(names_lower) if isinstance(names_lower, str) else names_lower
    pos = F.array_position(names, F.lit(name.lower()))      # 1-based, 0 when absent
    return F.coalesce(F.get(h["value"], pos.cast("int") - 1), F.lit(default))
