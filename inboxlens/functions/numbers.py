"""Percentages without division errors (ANSI mode raises on ``/ 0``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def percentage(value: Column | str, total: Column | str) -> Column:
    """``value / total * 100`` as DOUBLE; 0.0 when the total is 0 or null."""
    v = _c(value).cast("double")
    t = _c(total).cast("double")
    return F.coalesce(F.try_divide(v, t) * F.lit(100.0), F.lit(0.0))


def percentage_text(value: Column | str, total: Column | str) -> Column:
    """Display form with one decimal and a percent sign, e.g. ``33.3%``.

    Halves are judged on the exact binary value and exact ties go to the even
    digit, as Python's ``%.1f`` does. The fraction is taken as a whole number
    of 2**-58, which is exact wherever a half can be, so integers decide.
    """
    p = percentage(value, total)
    unit = 1 << 58
    part = ((p - F.floor(p)) * float(unit)).cast("long")
    tenth = F.call_function("div", part * 10, F.lit(unit))
    over = part * 20 - (tenth * 2 + 1) * unit
    tenths = F.floor(p) * 10 + tenth + F.when((over > 0) | ((over == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))
