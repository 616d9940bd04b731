"""Mail-shaped views over the shared test tables.

The test tables are not mail, so each view maps one of them onto the message
model (see FIXTURES.md, part 2):

* ``mail_orders`` (V1): one message per order, flags from status and priority.
* ``mail_events`` (V2): one message per event with templated subject and
  snippet carrying intent words and amounts.
* ``mail_docs``   (V3): one message per document with real multilingual text.
* ``mail_cache``  (V4): the raw nested cache built from orders, with mixed
  header case, unparsable dates and both the wrapped and the flat item layout.

Every view reads its whole table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inboxlens.functions.dates import age_days_from_ts
from inboxlens.schemas import CACHE

# The "now" each view is audited at.
ORDERS_AS_OF = "2001-09-01 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"
# refresh scenario over orders: mail before this date was deleted from the mailbox ...
MAILBOX_SINCE = "1996-01-01"
# ... and the cache was filled before mail of this date arrived
CACHED_BEFORE = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _flags_from_orders():
    pr = F.col("o_orderpriority")
    return [
        (F.col("o_orderstatus") != "F").alias("unread"),
        (pr == "1-URGENT").alias("starred"),
        pr.isin("1-URGENT", "2-HIGH").alias("important"),
        (pr == "5-LOW").alias("social"),
        (pr == "3-MEDIUM").alias("updates"),
        (pr == "4-NOT SPECIFIED").alias("promotions"),
    ]


def _order_sender():
    return F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("@example.com"))


def _order_id():
    return F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))


def mail_orders(spark: SparkSession, sf_dir: str, as_of: str = ORDERS_AS_OF) -> DataFrame:
    """V1 messages: id, from, six flags, ts, age_days."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        _order_id().alias("id"), _order_sender().alias("from"), *_flags_from_orders(),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    ).withColumn("age_days", age_days_from_ts("ts", as_of))


def mail_events(spark: SparkSession, sf_dir: str, as_of: str = EVENTS_AS_OF) -> DataFrame:
    """V2 messages with subject and snippet text; ``signup`` has an empty snippet."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    subject = (F.when(et == "purchase", "Your receipt").when(et == "view", "Weekend deals")
                .when(et == "click", "New comment").when(et == "signup", "Account balance update")
                .otherwise("Status report"))
    amount = F.floor(F.col("value")).cast("long").cast("string")
    snippet = (F.when(et == "purchase", F.concat(F.lit("Your order is on its way. Payment of $"), amount,
                                                  F.lit(" received. Invoice attached.")))
                .when(et == "view", F.lit("Buy now and save on our limited offer! Subscribe to our "
                                          "newsletter for exclusive deals."))
                .when(et == "click", F.lit("A friend left a comment on your post. Follow the group."))
                .when(et == "signup", F.lit(""))
                .otherwise(F.lit("Update: status report and event summary.")))
    unread = et.isin("error", "signup")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("from"),
        unread.alias("unread"), F.lit(False).alias("starred"), F.lit(False).alias("important"),
        (et == "click").alias("social"), et.isin("error", "signup").alias("updates"),
        (et == "view").alias("promotions"),
        ts.alias("ts"), subject.alias("subject"), snippet.alias("snippet"),
    ).withColumn("age_days", age_days_from_ts("ts", as_of))


def mail_docs(spark: SparkSession, sf_dir: str, whole_subject: bool = False) -> DataFrame:
    """V3 messages: whole document text as snippet, its first line (or all of it) as subject."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.col("source"), F.lit("@example.com")).alias("from"),
        F.col("text").alias("snippet"),
        (F.col("text") if whole_subject else F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("subject"),
        F.col("doc_id").alias("ord"),
    )


def mail_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 messages: one per customer, whose snippet names a person, a place, a firm, a product, an event, amounts
    and dates in several forms, and words that only begin like a month."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = (F.col("c_custkey") % 28 + 1).cast("string")
    snippet = F.concat(
        F.col("c_name"), F.lit(" of "), F.initcap("n_name"), F.lit(" met Supplier#"),
        F.lpad(F.col("c_nationkey").cast("string"), 9, "0"), F.lit(" and took Brand#"),
        (F.col("c_nationkey") + 1).cast("string"), F.lit(" for "), F.floor(F.abs("c_acctbal")).cast("string"),
        F.lit(" Dollars at the "), F.initcap("c_mktsegment"), F.lit(" trade fair of the year on "), day, F.lit(" March 2024"),
        F.lit(". Market 24 and decision 3 cost USD "), F.col("c_custkey").cast("string"),
        F.lit(",000, $1.2 million, 5k EUR or 30 pounds by the "), (F.col("c_custkey") % 10 + 4).cast("string"),
        F.lit("th of May 2024, Sept. "), day, F.lit(" or June 2025"))
    return c.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("id"),
                    F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("from"), snippet.alias("snippet"))


def customer_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the tables under every gazetteer label, entries of six words among them, and one unknown label."""
    t = lambda name, label, surface: table(spark, sf_dir, name).select(
        F.lit(label).alias("label"), surface.alias("surface"))
    g = t("customer", "PERSON", F.col("c_name")).unionByName(t("nation", "GPE", F.initcap("n_name")))
    g = g.unionByName(t("supplier", "ORG", F.col("s_name"))).unionByName(t("part", "PRODUCT", F.col("p_brand")))
    fair = F.concat(F.initcap("c_mktsegment"), F.lit(" trade fair of the year"))
    return g.unionByName(t("customer", "EVENT", fair)).unionByName(t("customer", "OTHER", fair)).dropDuplicates()


def _labels_from_orders():
    pr = F.col("o_orderpriority")
    cand = [
        F.when(F.col("o_orderstatus") != "F", F.lit("UNREAD")),
        F.when(pr == "1-URGENT", F.lit("STARRED")),
        F.when(pr.isin("1-URGENT", "2-HIGH"), F.lit("IMPORTANT")),
        F.when(pr == "5-LOW", F.lit("CATEGORY_SOCIAL")),
        F.when(pr == "3-MEDIUM", F.lit("CATEGORY_UPDATES")),
        F.when(pr == "4-NOT SPECIFIED", F.lit("CATEGORY_PROMOTIONS")),
    ]
    return F.filter(F.array(*cand), lambda x: x.isNotNull())


def _headers_from_orders():
    key = F.col("o_orderkey")
    from_name = F.when(key % 2 == 0, F.lit("From")).otherwise(F.lit("FROM"))
    date_value = F.when(key % 50 == 0, F.lit("Unknown")).otherwise(
        F.date_format(F.col("o_orderdate"), "EEE, d MMM yyyy HH:mm:ss '+0000'"))
    return F.array(
        F.struct(from_name.alias("name"), _order_sender().alias("value")),
        F.struct(F.lit("Date").alias("name"), date_value.alias("value")),
    )


def _response_from_orders():
    return F.struct(F.lit("").alias("snippet"), _labels_from_orders().alias("labelIds"),
                    F.struct(_headers_from_orders().alias("headers")).alias("payload"))


def cache_rows(orders: DataFrame) -> DataFrame:
    """V4 rows for the given orders.

    Keys divisible by 3 are old flat items without a fetch stamp; the rest are
    wrapped items fetched 2 or 31 days before :data:`ORDERS_AS_OF`.
    """
    key = F.col("o_orderkey")
    legacy = key % 3 == 0
    fetched_at = (F.when(legacy, F.lit(None).cast("string"))
                   .when(key % 3 == 1, F.lit("2001-08-30T00:00:00+00:00"))
                   .otherwise(F.lit("2001-08-01T00:00:00+00:00")))
    resp = _response_from_orders()
    return orders.select(
        _order_id().alias("id"),
        fetched_at.alias("fetched_at"),
        F.when(~legacy, resp).alias("response"),
        F.when(legacy, resp["snippet"]).alias("snippet"),
        F.when(legacy, resp["labelIds"]).alias("labelIds"),
        F.when(legacy, resp["payload"]).alias("payload"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in CACHE.fields])


def mail_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the raw cache over every order."""
    return cache_rows(table(spark, sf_dir, "orders"))


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mail service lists now: ``(id, ts, labelIds)`` of orders since MAILBOX_SINCE."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(MAILBOX_SINCE).cast("timestamp_ntz"))
    return o.select(_order_id().alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                    _labels_from_orders().alias("labelIds"))


def earlier_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache as the previous audit left it: every order before CACHED_BEFORE."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(CACHED_BEFORE).cast("timestamp_ntz"))
    return cache_rows(o)


def fetch_results(spark: SparkSession, sf_dir: str, plan: DataFrame, fetched_at: str = ORDERS_AS_OF) -> DataFrame:
    """What fetching ``plan(id)`` returns: a fresh wrapped item per id.

    Orders still in status 'P' stand for messages whose fetch failed; they are
    absent from the result, so an old cached copy (if any) survives.
    """
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    got = o.select(_order_id().alias("id"), F.lit(fetched_at.replace(" ", "T") + "+00:00").alias("fetched_at"),
                   _response_from_orders().alias("response"))
    got = got.join(plan.select("id"), "id", "left_semi")
    return got.select("id", "fetched_at", "response",
                      F.lit(None).cast("string").alias("snippet"),
                      F.lit(None).cast("array<string>").alias("labelIds"),
                      F.lit(None).cast(CACHE["payload"].dataType).alias("payload"))


def gazetteer(spark: SparkSession, sf_dir: str, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """A ``(label, surface)`` dictionary: nation and region names as GPE, plus ``extra`` rows."""
    names = [(table(spark, sf_dir, t), c) for t, c in (("nation", "n_name"), ("region", "r_name"))]
    g = None
    for df, c in names:
        rows = df.select(F.lit("GPE").alias("label"), F.initcap(c).alias("surface"))
        g = rows if g is None else g.unionByName(rows)
    if extra:
        g = g.unionByName(spark.createDataFrame(extra, "label string, surface string"))
    return g.dropDuplicates()
