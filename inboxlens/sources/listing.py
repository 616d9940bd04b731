"""Bounded mailbox listing: the first ``max_emails`` ids that pass a label filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlens.schemas import LABEL_TRASH


def bounded_listing(mailbox: DataFrame, max_emails: int,
                    include_labels: Iterable[str] = (),
                    exclude_labels: Iterable[str] = (LABEL_TRASH,)) -> DataFrame:
    """Newest-first ids of ``mailbox(id, ts, labelIds)``, never more than ``max_emails``.

    The limit is the feature (the audit size); Spark plans it as a
    TakeOrderedAndProject, a per-partition top-n merged on one task, so at
    most ``max_emails`` rows per partition ever move.
    """
    if max_emails <= 0:
        raise ValueError("max_emails must be a positive number")
    cond = F.lit(True)
    labels = F.coalesce(F.col("labelIds"), F.array().cast("array<string>"))
    for lab in include_labels:
        cond = cond & F.array_contains(labels, F.lit(lab))
    for lab in exclude_labels:
        cond = cond & ~F.array_contains(labels, F.lit(lab))
    return (mailbox.where(cond)
            .orderBy(F.col("ts").desc_nulls_last(), F.col("id").asc())
            .limit(max_emails)
            .select("id", "ts"))
