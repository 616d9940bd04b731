"""Table schemas and the fixed values that define the audit semantics.

The values under "Fixed values" must stay exactly as listed: thresholds, label
names, keyword lists and tier names decide which rows land where.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

RESPONSE = T.StructType([
    T.StructField("snippet", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("payload", T.StructType([
        T.StructField("headers", T.ArrayType(HEADER)),
    ])),
])

# One row per cached message. ``response`` holds the wrapped (current) format;
# the legacy flat format keeps snippet / labelIds / payload at the top level.
CACHE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("response", RESPONSE),
    T.StructField("snippet", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("payload", RESPONSE["payload"].dataType),
])

# The legacy single-object cache file: {id: item}.
CACHE_MAP = T.MapType(T.StringType(), T.StructType([f for f in CACHE.fields if f.name != "id"]))

LISTING = T.StructType([T.StructField("id", T.StringType())])

MESSAGES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("unread", T.BooleanType()),
    T.StructField("starred", T.BooleanType()),
    T.StructField("important", T.BooleanType()),
    T.StructField("social", T.BooleanType()),
    T.StructField("updates", T.BooleanType()),
    T.StructField("promotions", T.BooleanType()),
    T.StructField("from", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("age_days", T.LongType()),
    T.StructField("snippet", T.StringType()),
])

SENDERS = T.StructType([
    T.StructField("from", T.StringType()),
    T.StructField("total_volume", T.LongType()),
    T.StructField("unread_count", T.LongType()),
    T.StructField("starred_count", T.LongType()),
    T.StructField("important_count", T.LongType()),
    T.StructField("social_count", T.LongType()),
    T.StructField("updates_count", T.LongType()),
    T.StructField("promotions_count", T.LongType()),
    T.StructField("avg_recency_days", T.DoubleType()),
    T.StructField("open_rate", T.DoubleType()),
    T.StructField("ignorance_score", T.DoubleType()),
])

GAZETTEER = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("surface", T.StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the audited tool's constants)
# ---------------------------------------------------------------------------

LABEL_UNREAD = "UNREAD"
LABEL_STARRED = "STARRED"
LABEL_IMPORTANT = "IMPORTANT"
LABEL_SOCIAL = "CATEGORY_SOCIAL"
LABEL_UPDATES = "CATEGORY_UPDATES"
LABEL_PROMOTIONS = "CATEGORY_PROMOTIONS"
LABEL_TRASH = "TRASH"

# message column -> label that sets it
FLAG_LABELS = {
    "unread": LABEL_UNREAD,
    "starred": LABEL_STARRED,
    "important": LABEL_IMPORTANT,
    "social": LABEL_SOCIAL,
    "updates": LABEL_UPDATES,
    "promotions": LABEL_PROMOTIONS,
}

HIGH_THRESHOLD = 80
MEDIUM_THRESHOLD = 50
LOW_THRESHOLD = 1

DEFAULT_MAX_EMAILS = 2000
DEFAULT_CACHE_TTL_DAYS = 7

HEADER_DEFAULTS = {"From": "Unknown", "Subject": "No Subject", "Date": "Unknown"}

# category columns in report order
EMAIL_CATEGORIES = ["updates_count", "promotions_count", "social_count", "important_count"]

TIER_NAMES = {
    "high": "High Engagement (80-100%)",
    "medium": "Medium Engagement (50-79%)",
    "low": "Low Engagement (1-49%)",
    "zero": "Zero Engagement (0%)",
}
TIER_ORDER = ["high", "medium", "low", "zero"]

# subject classes: checked in this order, case-insensitive substring match
VALUABLE_KEYWORDS = [
    "credit score", "score changed", "score update", "fico", "spending category",
    "top spending", "transaction", "deposit", "pending transaction", "balance",
    "account", "cash back", "rewards", "savings account", "alert", "security",
    "login", "password", "bill", "payment",
]
PROMOTIONAL_KEYWORDS = [
    "loan", "mortgage", "insurance", "car insurance", "advisor", "financial advisor",
    "credit card", "intro apr", "interest rate", "approved fast", "heloc", "refinance",
    "high-yield", "comparison", "rate", "offer", "deal", "apply", "application",
    "survey", "feedback", "review", "newsletter", "tips", "guide",
]

# dropped from snippet keywords (with every word of two letters or fewer)
KEYWORD_STOP_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "an", "a"]

# dropped by filter_common_words (with every word of three letters or fewer)
COMMON_WORDS = [
    "with", "from", "your", "this", "that", "have", "been", "will", "they", "their",
    "there", "here", "when", "where", "what", "which", "then", "than", "into", "onto",
    "over", "under", "after", "before", "while", "since", "until", "through", "during",
    "between", "among", "within",
]

# intent keyword lists; dict order is also the tie order
INTENT_KEYWORDS = {
    "promotional": ["buy", "sale", "discount", "offer", "deal", "save", "free", "limited",
                    "exclusive", "subscribe", "newsletter", "marketing", "advertisement",
                    "promotion", "coupon"],
    "transactional": ["receipt", "invoice", "payment", "order", "confirmation", "shipping",
                      "delivered", "purchase", "billing", "account", "transaction", "charged",
                      "refund"],
    "informational": ["update", "news", "alert", "notification", "report", "summary", "status",
                      "announcement", "reminder", "schedule", "meeting", "event"],
    "social": ["friend", "connect", "follow", "like", "share", "comment", "post", "message",
               "invite", "group", "community", "network"],
}
INTENT_ORDER = list(INTENT_KEYWORDS)
MONEY_BONUS = 2
NEWSLETTER_BONUS = 2

ENTITY_LABELS = ["ORG", "PERSON", "GPE", "MONEY", "DATE", "PRODUCT", "EVENT"]

# health score bands (lower bound, name), checked top-down
HEALTH_BANDS = [(90, "Excellent"), (80, "Good"), (70, "Moderate"), (60, "Poor"), (0, "Critical")]
