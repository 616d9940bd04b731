"""From raw cache rows to the message table (listing join + extraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inboxlens.functions.dates import age_days_from_ts, with_date_ts
from inboxlens.functions.headers import header_names_lower, header_value
from inboxlens.functions.labels import has_label
from inboxlens.schemas import FLAG_LABELS, HEADER_DEFAULTS
from inboxlens.sources.cache import response_of


def unwrap(cache: DataFrame) -> DataFrame:
    """``(id, fetched_at, msg)`` with ``msg`` the message in either item layout."""
    return cache.select("id", "fetched_at", response_of().alias("msg"))


def extract(cache: DataFrame, as_of=None, keep: list[str] | None = None,
            subject_default: str = HEADER_DEFAULTS["Subject"]) -> DataFrame:
    """The 12 message columns from cache rows (no listing join).

    Staged projections: headers are looked up once, the Date header is parsed
    once, and only then ages and flags are derived. ``keep`` carries extra
    cache columns through to the end. The sender -> subjects map of the cache
    uses ``subject_default=""`` (the message table uses "No Subject").
    """
    keep = list(keep or [])
    m = cache.select("id", response_of().alias("msg"), *keep)
    m = m.select("id", F.col("msg.payload.headers").alias("_h"), F.col("msg.labelIds").alias("_l"),
                 F.col("msg.snippet").alias("_s"), *keep)
    m = m.withColumn("_hn", header_names_lower("_h"))
    base = m.select(
        "id",
        *[has_label("_l", lab).alias(name) for name, lab in FLAG_LABELS.items()],
        header_value("_h", "From", HEADER_DEFAULTS["From"], "_hn").alias("from"),
        header_value("_h", "Subject", subject_default, "_hn").alias("subject"),
        header_value("_h", "Date", HEADER_DEFAULTS["Date"], "_hn").alias("date"),
        F.coalesce(F.col("_s"), F.lit("")).alias("snippet"),
        *keep,
    )
    dated = with_date_ts(base, "date", "_ts")
    return dated.select("id", *FLAG_LABELS, "from", "subject", "date",
                        age_days_from_ts("_ts", as_of).alias("age_days"), "snippet", *keep)


def message_ts(messages: DataFrame) -> DataFrame:
    """Adds the absolute time ``ts`` parsed from the Date header."""
    return with_date_ts(messages, "date", "ts")


def process_messages(cache: DataFrame, listing: DataFrame, as_of=None) -> DataFrame:
    """Listed messages that are in the cache, as message rows.

    An inner equi-join on ``id``: ids missing from the cache are skipped;
    duplicate listing ids stay duplicated, as listed. Both sides shuffle on
    ``id`` (or the listing is broadcast when AQE sees it is small).
    """
    return extract(cache.join(listing.select("id"), "id", "inner"), as_of)


def drop_undated(messages: DataFrame) -> DataFrame:
    """Messages whose Date header gave an age (the aggregation input)."""
    return messages.where(F.col("age_days").isNotNull())
