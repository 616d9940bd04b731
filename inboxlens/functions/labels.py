"""Label membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_label(labels: Column | str, label: str) -> Column:
    """True when ``label`` is among the message labels; a missing list is empty."""
    c = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(F.array_contains(c, F.lit(label)), F.lit(False))
