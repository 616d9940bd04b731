"""Column expressions: everything here returns a ``Column`` built from Spark
built-ins, so it stays inside whole-stage code generation."""

from inboxlens.functions.dates import age_days, age_days_from_ts, is_stale, rfc2822_timestamp, with_date_ts
from inboxlens.functions.headers import header_value
from inboxlens.functions.labels import has_label
from inboxlens.functions.numbers import percentage, percentage_text
from inboxlens.functions.text import (
    clean_text,
    common_words_filtered,
    keyword_tokens,
    subject_class,
    words,
)
from inboxlens.functions.tiers import engagement_tier, tier_name, tier_rank

__all__ = [
    "age_days", "age_days_from_ts", "is_stale", "rfc2822_timestamp", "with_date_ts", "words", "header_value",
    "has_label",
    "percentage", "percentage_text", "clean_text", "common_words_filtered", "keyword_tokens",
    "subject_class", "engagement_tier", "tier_name", "tier_rank",
]
