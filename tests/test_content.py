from pyspark.sql import functions as F

from inboxlens.functions.text import clean_text, common_words_filtered, keyword_tokens, subject_class
from inboxlens.operators import content as CT
from inboxlens.schemas import INTENT_KEYWORDS

SUBJECTS = ["Your credit score has changed", "Special loan offer - 0% APR", "Account balance update",
            "Weekly newsletter", "Transaction alert: $50 deposit"]

INTENT_TEXTS = [
    ("t1", "Buy now and save 50% on our limited time offer! Subscribe to our newsletter for exclusive deals.",
     "promotional"),
    ("t2", "Your order has been confirmed. Payment of $25.99 has been processed. Receipt attached.", "transactional"),
    ("t3", "Update: Your account status has changed. Please review the attached report.", "informational"),
    ("t4", "Hello, how are you doing today?", "unknown"),
    ("t5", "", "unknown"),
]


def test_subject_classes(spark):
    df = spark.createDataFrame([(s,) for s in SUBJECTS], "subject string")
    got = [r.c for r in df.select(subject_class("subject").alias("c")).collect()]
    assert got.count("valuable") == 3 and got.count("promotional") == 2 and got.count("uncategorized") == 0
    assert got[1] == "promotional" and got[3] == "promotional"


def test_subject_class_counts_empty(spark):
    empty = spark.createDataFrame([], "from string, id string, subject string")
    assert CT.subject_class_counts(empty).count() == 0


def test_clean_text_unicode(spark):
    df = spark.createDataFrame([("Héllo,  WORLD!! café_au-lait\tnaïve ",), (None,)], "t string")
    got = [r.c for r in df.select(clean_text("t").alias("c")).collect()]
    assert got == ["héllo world café_au lait naïve", ""]


def test_keywords(spark):
    df = spark.createDataFrame([("The cat and an owl by the Sea, of sea-sea!",), ("",)], "t string")
    got = [r.k for r in df.select(keyword_tokens("t").alias("k")).collect()]
    assert got == [["cat", "owl", "sea", "sea", "sea"], []]


def test_common_words(spark):
    df = spark.createDataFrame([(["With", "Payment", "due", "THROUGH", "Invoice", "your"],)], "w array<string>")
    assert df.select(common_words_filtered("w").alias("x")).first().x == ["payment", "invoice"]


def test_top_keywords_tie_order(spark):
    msgs = spark.createDataFrame([("a", "1", "zeta beta beta alpha"), ("a", "2", "alpha zeta gamma"),
                                  ("b", "3", "")], "from string, id string, snippet string")
    rows = CT.top_keywords(msgs, 2).orderBy("from", "rank").collect()
    assert [(r["from"], r.keyword, r.n) for r in rows] == [("a", "alpha", 2), ("a", "beta", 2)]


def test_lexicon_unambiguous():
    rows = CT.intent_lexicon_rows()
    forms = [f for f, _ in rows]
    assert len(forms) == len(set(forms))
    owner = dict(rows)
    for intent, words in INTENT_KEYWORDS.items():
        for w in words:
            assert owner[w] == intent
    assert owner["deals"] == "promotional" and owner["updated"] == "informational"


def test_intents_per_text(spark):
    df = spark.createDataFrame([(k, "x", t) for k, t, _ in INTENT_TEXTS], "id string, from string, snippet string")
    gaz = spark.createDataFrame([("ORG", "newsletter")], "label string, surface string")
    got = {r.id: r.intent for r in CT.top_intents(df, 1, "id", gaz).collect()}
    assert got == {k: want for k, _, want in INTENT_TEXTS}
    off = {r.id: (r.intent, r.score) for r in CT.top_intents(df, 1, "id", gaz, content_features=False).collect()}
    assert set(off.values()) == {("unknown", 0)}


def test_intent_scores_and_bonus(spark):
    df = spark.createDataFrame([(k, "x", t) for k, t, _ in INTENT_TEXTS[:2]], "id string, from string, snippet string")
    gaz = spark.createDataFrame([("ORG", "newsletter")], "label string, surface string")
    s = {(r.id, r.intent): r.score for r in CT.intent_scores(df, "id", gaz).collect()}
    assert s[("t1", "promotional")] == 8 + 2          # 8 words + newsletter organisation
    assert s[("t2", "transactional")] == 3 + 2        # order, payment, receipt + amount
    top3 = CT.top_intents(df.where("id = 't1'"), 3, "id", gaz).orderBy("rank").collect()
    assert [r.intent for r in top3][0] == "promotional" and len(top3) == 3


def test_mixed_top3(spark):
    df = spark.createDataFrame([("m", "x", "Buy now and save! Your order is confirmed. Account update available.")],
                               "id string, from string, snippet string")
    rows = CT.top_intents(df, 3, "id").collect()
    assert len(rows) <= 3 and {r.intent for r in rows} & {"promotional", "transactional"}


def test_entities(spark):
    msgs = spark.createDataFrame([
        ("a", "1", "Pay $25.99 by Monday to the Newsletter team in Germany."),
        ("a", "2", "Refund of $25.99 issued on 2024-01-05; United Kingdom office."),
        ("b", "3", "nothing here")], "from string, id string, snippet string")
    gaz = spark.createDataFrame([("ORG", "newsletter"), ("GPE", "Germany"), ("GPE", "United Kingdom")],
                                "label string, surface string")
    ents = {(r.id, r.label, r.entity) for r in CT.message_entities(msgs, gaz).collect()}
    assert ("1", "MONEY", "$25.99") in ents and ("1", "DATE", "Monday") in ents
    assert ("1", "ORG", "newsletter") in ents and ("1", "GPE", "Germany") in ents
    assert ("2", "GPE", "United Kingdom") in ents and ("2", "DATE", "2024-01-05") in ents
    counts = {(r.label, r.entity): r.n for r in CT.entity_counts(msgs, gaz).collect()}
    assert counts[("MONEY", "$25.99")] == 2


def test_no_python_udf_in_content_plans(spark):
    msgs = spark.createDataFrame([("a", "1", "Buy now")], "from string, id string, snippet string")
    for df in (CT.top_keywords(msgs), CT.top_intents(msgs, 3), CT.top_entities(msgs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entities_of_a_small_file_are_dealt_out_and_few_ngrams_are_shuffled(spark):
    """One file's texts used to be worked on in one task, and every n-gram of them met the gazetteer by a shuffle."""
    texts = [(f"s{i % 3}@x", f"m{i}", f"Firm {i} met Acme Corp of Paris on 3 May 2024 for $5 then firm {i + 1}") for i in range(400)]
    m = spark.createDataFrame(texts, "from string, id string, snippet string").coalesce(1)
    g = spark.createDataFrame([("ORG", "Acme Corp"), ("GPE", "Paris"), ("GPE", "paris"), ("ORG", "Firm 7"), ("OTHER", "May")],
                              "label string, surface string")
    ents = CT.message_entities(m, g)
    assert "REBALANCE_PARTITIONS_BY_NONE" in ents._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in ents.groupBy("label", "entity").count().collect())
    assert got == [("DATE", "3 May 2024", 400), ("GPE", "Paris", 400), ("GPE", "paris", 400), ("MONEY", "$5", 400),
                   ("ORG", "Acme Corp", 400), ("ORG", "Firm 7", 2)]
    entries = spark.range(1000).select(F.concat(F.lit("entry "), "id").alias("_gram"))
    grams = entries.unionByName(spark.range(20000).select(F.concat(F.lit("other "), "id").alias("_gram")))
    left = CT._marked(grams, CT._gram_marks(entries))
    assert left.where("_gram like 'entry%'").count() == 1000 and left.count() < 1100
    top = CT.top_entities(m, g, 1)
    assert "REBALANCE_PARTITIONS_BY_NONE" in top._jdf.queryExecution().executedPlan().toString() and top.count() == 12


def test_ngrams_are_put_together_only_where_an_entry_may_begin(spark):
    """Every n-gram of every text used to be put together; patterns were searched in the few tasks of the join's stage."""
    m = spark.createDataFrame([("a", "1", "the acme corp of new new york, acme"), ("a", "2", None), ("b", "3", "corp acme new"),
                               ("a", "4", "york $5 acme corp inc acme corp inc")], "from string, id string, snippet string")
    g = spark.createDataFrame([("ORG", "Acme Corp", "acme corp", 2), ("ORG", "ACME corp inc", "acme corp inc", 3),
                               ("GPE", "new york", "new york", 2), ("GPE", "York", "york", 1)],
                              "label string, surface string, _gram string, _n int")
    grams = CT._entry_grams(m.withColumn("_t", F.coalesce("snippet", F.lit(""))), g)
    assert sorted(r._gram for r in grams.where("id = '4'").collect()) == ["acme corp"] * 2 + ["acme corp inc"] * 2 + ["york"]
    assert grams.where("id = '3'").isEmpty()
    money = spark.createDataFrame([("MONEY", "$5"), ("DATE", "acme"), ("MONEY", "5")], "label string, surface string")
    ents = CT.message_entities(m, g.select("label", "surface").unionByName(money))
    assert sorted(tuple(r) for r in ents.select("id", "label", "entity").collect()) == [
        ("1", "DATE", "acme"), ("1", "GPE", "York"), ("1", "GPE", "new york"), ("1", "ORG", "Acme Corp"), ("3", "DATE", "acme"),
        ("4", "DATE", "acme"), ("4", "GPE", "York"), ("4", "MONEY", "$5"), ("4", "MONEY", "5"), ("4", "ORG", "ACME corp inc"),
        ("4", "ORG", "Acme Corp")]
    plan = ents._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id") == 2 and "transform(" not in plan
