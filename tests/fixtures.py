"""Small inputs with the values the audited tool's own tests assert."""

from pyspark.sql import functions as F

# F1: sender table (from, total_volume, open_rate, ignorance_score, unread_count)
F1 = [
    ("test@example.com", 10, 50.0, 500, 5),
    ("newsletter@company.com", 25, 10.0, 2250, 22),
    ("bank@bank.com", 5, 80.0, 100, 1),
    ("promo@store.com", 15, 0.0, 1500, 15),
    ("important@service.com", 8, 60.0, 320, 3),
]
F1_SCHEMA = "from string, total_volume bigint, open_rate double, ignorance_score bigint, unread_count bigint"

# categories (updates, promotions, social, important) in F1 order
F2_CATS = [(8, 2, 0, 0), (20, 5, 0, 0), (0, 0, 0, 5), (0, 15, 0, 0), (2, 0, 0, 6)]

# message rows
F3 = [
    ("sender1@example.com", "id1", True, False, False, False, True, False, 1.0),
    ("sender1@example.com", "id2", False, True, False, False, False, False, 2.0),
    ("sender2@example.com", "id3", True, False, True, False, False, False, 1.5),
    ("sender2@example.com", "id4", True, False, False, True, False, False, 3.0),
    ("sender2@example.com", "id5", False, False, False, False, False, True, 2.5),
]
F3_SCHEMA = ("from string, id string, unread boolean, starred boolean, important boolean, social boolean, "
             "updates boolean, promotions boolean, age_days double")


def f1(spark):
    return spark.createDataFrame(F1, F1_SCHEMA)


def f2(spark):
    rows = [a + b for a, b in zip(F1, F2_CATS)]
    return spark.createDataFrame(rows, F1_SCHEMA + ", updates_count bigint, promotions_count bigint, "
                                 "social_count bigint, important_count bigint")


def f3(spark):
    return spark.createDataFrame(F3, F3_SCHEMA)


def as_dict(df, key="from"):
    return {r[key]: r.asDict() for r in df.collect()}


def cache_item(spark, rows):
    """rows: (id, fetched_at, wrapped: bool, headers list[(name, value)], snippet, labels)"""
    from inboxlens.schemas import CACHE
    data = []
    for id_, fetched, wrapped, headers, snippet, labels in rows:
        msg = {"snippet": snippet, "labelIds": labels,
               "payload": None if headers is None else {"headers": [{"name": n, "value": v} for n, v in headers]}}
        if wrapped:
            data.append({"id": id_, "fetched_at": fetched, "response": msg, "snippet": None, "labelIds": None,
                         "payload": None})
        else:
            data.append({"id": id_, "fetched_at": fetched, "response": None, **msg})
    return spark.createDataFrame(data, CACHE).select(*[F.col(c) for c in CACHE.fieldNames()])
