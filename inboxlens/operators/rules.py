"""Intent x engagement recommendations as a rule table joined to senders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.functions.tiers import engagement_tier

# Fixed values: (intent, tier, action) from the published cleanup guidance.
ACTION_RULES = [
    ("promotional", "high", "Keep, but consider digest mode"),
    ("promotional", "low", "Unsubscribe immediately"),
    ("promotional", "zero", "Unsubscribe immediately"),
    ("transactional", "high", "Keep with auto-archive after 30 days"),
    ("transactional", "low", "Archive immediately"),
    ("informational", "high", "Keep in inbox"),
    ("informational", "low", "Move to digest folder"),
    ("social", "high", "Keep in inbox"),
    ("social", "low", "Review monthly"),
]
# intent-wide advice, whatever the tier
INTENT_LABELS = [("transactional", "Label as \"Transactions\"")]
KIND_ADVICE = [("informational", "Newsletters: Consider weekly digest"), ("social", "Personal: Always keep")]
#: promotional senders below this open rate go, also those between the tiers
UNSUBSCRIBE_BELOW = ("promotional", 50, "Unsubscribe immediately")
HIGH_VOLUME_FILTER = ("promotional", 20, "Create filters to skip inbox")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTION_RULES, "intent string, tier string, action string")


def recommend_actions(senders: DataFrame, top_intent: DataFrame) -> DataFrame:
    """``(from, total_volume, open_rate, tier, intent, action, kind_advice, label_advice, filter_advice)``.

    ``top_intent`` holds one ``(from, intent)`` row per sender. The rule table
    has a fixed handful of rows, so it is broadcast.
    """
    spark = senders.sparkSession
    rules = rule_table(spark)
    labels = spark.createDataFrame(INTENT_LABELS, "intent string, label_advice string")
    s = senders.select("from", "total_volume", "open_rate", engagement_tier("open_rate").alias("tier"))
    j = s.join(top_intent.select("from", "intent"), "from", "left")
    j = j.join(F.broadcast(rules), ["intent", "tier"], "left").join(F.broadcast(labels), "intent", "left")
    intent, at_least, advice = HIGH_VOLUME_FILTER
    flt = F.when((F.col("intent") == intent) & (F.col("total_volume") >= at_least), F.lit(advice))
    gone, below, act = UNSUBSCRIBE_BELOW
    action = F.coalesce("action", F.when((F.col("intent") == gone) & (F.col("open_rate") < below), F.lit(act)))
    kind = F.coalesce(*[F.when(F.col("intent") == i, F.lit(text)) for i, text in KIND_ADVICE])
    return j.select("from", "total_volume", "open_rate", "tier", "intent", action.alias("action"),
                    kind.alias("kind_advice"), "label_advice",
                    flt.alias("filter_advice"))
