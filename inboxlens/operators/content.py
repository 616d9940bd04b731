"""Content analysis over subjects and snippets: keywords, subject classes,
entities and intents, per message and per sender.

Each branch splits a text into words once (one Unicode regex pass) and works
on exploded rows: keywords are grouped counts, entities one generator plus a
join to the gazetteer, intents a broadcast join to the lexicon and one
aggregate. Per-sender top-k uses ``row_number`` windows, which Spark plans
with a partial WindowGroupLimit before the shuffle, so a sender with a huge
vocabulary only moves its per-partition top-k; the intent top-n is row-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inboxlens.functions.text import clean_text, common_words_filtered, is_keyword, subject_class, words
from inboxlens.schemas import ENTITY_LABELS, INTENT_KEYWORDS, INTENT_ORDER, MONEY_BONUS, NEWSLETTER_BONUS

# ---------------------------------------------------------------------------
# sender -> subjects / snippets as long tables
# ---------------------------------------------------------------------------


def _ord(messages: DataFrame) -> list[str]:
    """The message's place in the mailbox, where the table has that column."""
    return ["ord"] if "ord" in messages.columns else []


def sender_subjects(messages: DataFrame) -> DataFrame:
    """``(from, id, subject)`` for every message, undated ones included; ``ord`` stays when there is one, so
    that lists can be put in mailbox order."""
    return messages.select("from", "id", F.coalesce(F.col("subject"), F.lit("")).alias("subject"), *_ord(messages))


def sender_snippets(messages: DataFrame) -> DataFrame:
    """``(from, id, snippet)`` for messages with a non-empty snippet; ``ord`` stays when there is one."""
    return (messages.where(F.coalesce(F.length("snippet"), F.lit(0)) > 0)
            .select("from", "id", "snippet", *_ord(messages)))


def cache_subjects(cache: DataFrame) -> DataFrame:
    """``(from, id, subject)`` straight from cache rows: every cached message,
    undated ones included, a missing Subject read as ''."""
    from inboxlens.operators.messages import extract
    return sender_subjects(extract(cache, subject_default=""))


def cache_snippets(cache: DataFrame) -> DataFrame:
    """``(from, id, snippet)`` of cached messages with a non-empty snippet."""
    from inboxlens.operators.messages import extract
    return sender_snippets(extract(cache))


def top_senders_by_subjects(messages: DataFrame, n: int) -> DataFrame:
    """Senders by number of subjects, most first (ties by address)."""
    return (sender_subjects(messages).groupBy("from").agg(F.count(F.lit(1)).alias("email_count"))
            .orderBy(F.col("email_count").desc(), F.col("from")).limit(n))


def first_subject(messages: DataFrame) -> DataFrame:
    """``(from, sample_subject)``: the subject of the sender's first message by ``ord``, or by id without one."""
    first = (_ord(messages) or ["id"])[0]
    return sender_subjects(messages).groupBy("from").agg(F.min_by("subject", first).alias("sample_subject"))


def snippet_counts(messages: DataFrame) -> DataFrame:
    """``(from, email_count)``: number of non-empty snippets per sender."""
    return sender_snippets(messages).groupBy("from").agg(F.count(F.lit(1)).alias("email_count"))


# ---------------------------------------------------------------------------
# subject classes and words
# ---------------------------------------------------------------------------


def classify_subjects(messages: DataFrame) -> DataFrame:
    """``(from, id, subject, subject_class)``."""
    return sender_subjects(messages).withColumn("subject_class", subject_class("subject"))


def subject_class_counts(messages: DataFrame) -> DataFrame:
    """Per sender and class: number of subjects."""
    return (classify_subjects(messages).groupBy("from", "subject_class")
            .agg(F.count(F.lit(1)).alias("subjects")))


def subject_words(messages: DataFrame) -> DataFrame:
    """``(id, word)``: subject words (split on spaces) kept by the common-word filter."""
    words = common_words_filtered(F.split(F.coalesce(F.col("subject"), F.lit("")), " "))
    return messages.select("id", F.explode(words).alias("word"))


def cleaned(messages: DataFrame, column: str = "snippet") -> DataFrame:
    return messages.select("id", clean_text(column).alias("clean_text"))


def message_keywords(messages: DataFrame, column: str = "snippet") -> DataFrame:
    """``(from, id, keyword)``, one row per keyword occurrence.

    Words are exploded and filtered as rows, so the test runs in generated
    code rather than in an interpreted array lambda.
    """
    w = messages.select("from", "id", F.explode(words(column)).alias("keyword"))
    return w.where(is_keyword("keyword"))


def keyword_counts(messages: DataFrame, column: str = "snippet") -> DataFrame:
    """``(from, keyword, n)``: occurrences over all of a sender's non-empty snippets."""
    return (message_keywords(sender_snippets(messages) if column == "snippet" else messages, column)
            .groupBy("from", "keyword").agg(F.count(F.lit(1)).alias("n")))


def top_k(df: DataFrame, keys: list[str], metric: str, tie: str, k: int) -> DataFrame:
    """Rows ranked 1..k within each ``keys`` group by ``metric`` desc, then ``tie`` asc."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_keywords(messages: DataFrame, k: int = 10) -> DataFrame:
    return top_k(keyword_counts(messages), ["from"], "n", "keyword", k)


# ---------------------------------------------------------------------------
# entities (dictionary and pattern based)
# ---------------------------------------------------------------------------

# Patterns for amount and date mentions, put together from the fixed values below.
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_MAGNITUDE = r"(?:\s?(?:k|m|bn|thousand|million|billion|trillion)\b)?"
_CODE = r"(?:usd|eur|gbp|jpy|chf|cad|aud|inr|cny)"
_UNIT = r"(?:dollars?|euros?|pounds?|cents?|yen|rupees?|francs?|yuan)"
MONEY_PATTERN = (rf"(?i)(?:\b(?:us|c|a))?[$€£¥₹]\s?{_NUMBER}{_MAGNITUDE}|\b{_CODE}\s?{_NUMBER}{_MAGNITUDE}"
                 rf"|\b{_NUMBER}{_MAGNITUDE}\s?(?:{_CODE}|{_UNIT})\b")
# A month in full or by its first letters, and nothing else that begins like one.
_MONTH = (r"(?:january|february|march|april|may|june|july|august|september|october|november|december"
          r"|(?:jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)\b\.?)")
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
DATE_PATTERN = (rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}\b|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|{_MONTH} {_DAY}\b(?:,? \d{{4}}\b)?"
                rf"|{_DAY} (?:of )?{_MONTH}(?![a-z])(?:,? \d{{4}}\b)?|{_MONTH} \d{{4}}\b"
                r"|(?:(?:mon|tues|wednes|thurs|fri|satur|sun)day|today|tomorrow|yesterday)\b)")


#: Bits of the maps of gazetteer entries and of their first words: what is broadcast are 2**bits / 64 rows of 16 bytes at most.
GRAM_BITS, FIRST_BITS = 26, 20


def _gram_marks(gazetteer: DataFrame, bits: int = GRAM_BITS) -> DataFrame:
    """(_at, _bits): a bit map of the hashes of ``_gram``; its size is bounded whatever the gazetteer's."""
    slot = F.xxhash64("_gram").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return (gazetteer.select(F.shiftright(slot, 6).alias("_at"), bit.alias("_bit"))
            .groupBy("_at").agg(F.bit_or("_bit").alias("_bits")))


def _marked(grams: DataFrame, marks: DataFrame, bits: int = GRAM_BITS) -> DataFrame:
    """The rows whose ``_gram`` may be an entry: all that are one, and some others."""
    names = grams.columns
    slot = F.xxhash64("_gram").bitwiseAND(F.lit((1 << bits) - 1))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot").bitwiseAND(F.lit(63)).cast("int"))
    met = grams.withColumn("_slot", slot).withColumn("_at", F.shiftright("_slot", 6)).join(F.broadcast(marks), "_at")
    return met.where(F.col("_bits").bitwiseAND(mask) != 0).select(*names)


def _entry_grams(texts: DataFrame, g: DataFrame) -> DataFrame:
    """``(from, id, _gram)``: the n-grams of ``_t`` that may be an entry ``_gram`` of ``g``, of ``_n`` words.

    Only words that may begin an entry are followed further: an n-gram is put together for these alone, in each of the
    lengths of the entries, which are gathered in one row.
    """
    firsts = g.select(F.substring_index("_gram", " ", 1).alias("_gram"))
    lengths = g.agg(F.collect_set("_n").alias("_lengths"))
    tok = texts.select("from", "id", words("_t").alias("_w"))
    starts = _marked(tok.select("from", "id", "_w", F.posexplode("_w").alias("_i", "_gram")),
                     _gram_marks(firsts, FIRST_BITS), FIRST_BITS).drop("_gram")
    sized = (starts.crossJoin(F.broadcast(lengths))  # one row
             .select("from", "id", "_w", "_i", F.explode("_lengths").alias("_n")).where("_i + _n <= size(_w)"))
    grams = sized.select("from", "id", F.array_join(F.slice("_w", F.col("_i") + 1, F.col("_n")), " ").alias("_gram"))
    return _marked(grams, _gram_marks(g))


def message_entities(messages: DataFrame, gazetteer: DataFrame | None = None,
                     column: str = "snippet") -> DataFrame:
    """``(from, id, label, entity)``, distinct per message.

    MONEY and DATE come from patterns; the other labels of the fixed set from
    the gazetteer ``(label, surface)``, matched on n-grams of the cleaned text
    by an inner equi-join. The n-gram lengths are those of the gazetteer's own
    entries, however long, gathered in one row of different lengths. Rows with
    other labels or without words are left out. Texts are dealt out evenly
    first, as a few small files may hold very many of them. Most words begin no
    entry and most n-grams are none: those that a broadcast bit map of bounded
    size rules out are not put together or not shuffled. Neither side of the
    join is forced into a broadcast: Spark decides by size. What the patterns
    find is made distinct by itself first, so that they are searched in as many
    tasks as there are cores and not in the few that the join's stage leaves
    to them.
    """
    src = messages.select("from", "id", F.coalesce(F.col(column), F.lit("")).alias("_t")).hint("rebalance")
    patterns = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_extract_all("_t", F.lit(rx), 0).alias("v"))
                         for label, rx in (("MONEY", MONEY_PATTERN), ("DATE", DATE_PATTERN))])
    rows = (src.select("from", "id", F.explode(patterns).alias("_c"))
               .select("from", "id", F.col("_c.label").alias("label"), F.explode("_c.v").alias("entity"))
               .dropDuplicates(["id", "label", "entity", "from"]))
    if gazetteer is not None:
        g = (gazetteer.where(F.col("label").isin(*ENTITY_LABELS))
             .select(F.col("label").alias("_label"), F.col("surface").alias("_surface"),
                     clean_text("surface").alias("_gram"), F.size(words("surface")).alias("_n"))
             .where(F.col("_n") > 0))
        hits = _entry_grams(src, g).join(g.select("_label", "_surface", "_gram"), "_gram")
        rows = rows.unionByName(hits.select("from", "id", F.col("_label").alias("label"),
                                            F.col("_surface").alias("entity")))
    return rows.where(F.length("entity") > 0).dropDuplicates(["id", "label", "entity", "from"])


def entity_counts(messages: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """``(from, label, entity, n)``: number of snippets mentioning the entity."""
    ents = message_entities(sender_snippets(messages), gazetteer)
    return ents.groupBy("from", "label", "entity").agg(F.count(F.lit(1)).alias("n"))


def top_entities(messages: DataFrame, gazetteer: DataFrame | None = None, k: int = 5) -> DataFrame:
    return top_k(entity_counts(messages, gazetteer), ["from", "label"], "n", "entity", k)


# ---------------------------------------------------------------------------
# intents
# ---------------------------------------------------------------------------



def _forms(word: str) -> set[str]:
    """Regular inflections of a keyword (plural, past, gerund)."""
    forms = {word, word + "s", word + "es", word + "ed", word + "ing"}
    if word.endswith("e"):
        forms |= {word + "d", word[:-1] + "ing"}
    if word.endswith("y") and len(word) > 2 and word[-2] not in "aeiou":
        forms |= {word[:-1] + "ies", word[:-1] + "ied"}
    return forms


def intent_lexicon_rows() -> list[tuple[str, str]]:
    """``(form, intent)`` rows built from the intent keywords by inflection rules.

    A form claimed by two intents, or equal to another intent's keyword, is
    left out so every form has one intent.
    """
    owner: dict[str, set[str]] = {}
    keywords = {w: i for i, ws in INTENT_KEYWORDS.items() for w in ws}
    for intent, words in INTENT_KEYWORDS.items():
        for w in words:
            for f in _forms(w):
                if f in keywords and keywords[f] != intent:
                    continue
                owner.setdefault(f, set()).add(intent)
    return sorted((f, next(iter(s))) for f, s in owner.items() if len(s) == 1)


def intent_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(intent_lexicon_rows(), "form string, intent string")


def intent_scores_wide(messages: DataFrame, key: str = "from", gazetteer: DataFrame | None = None,
                       column: str = "snippet", content_features: bool = True, per_row: bool = False) -> DataFrame:
    """One row per key with the four intent scores as columns.

    score = lexicon hits over all the key's texts, +2 transactional when any
    text mentions an amount, +2 promotional when an ORG of the gazetteer that
    contains "newsletter" occurs. Texts are tokenised once and joined to the
    lexicon (a fixed ~300 rows); one aggregation (partial before the shuffle)
    yields all four scores, so no per-key grid or distinct is needed. A null
    key is a key like any other. ``per_row``: each row is a key of its own, as
    for single messages; words are then counted within the row, and without a
    gazetteer nothing is shuffled (with one, rows of a repeated key share the
    newsletter bonus).
    """
    spark = messages.sparkSession
    if not content_features:
        if per_row:
            return messages.select(key, *[F.lit(0).cast("long").alias(i) for i in INTENT_ORDER])
        return messages.groupBy(key).agg(*[F.lit(0).cast("long").alias(i) for i in INTENT_ORDER])
    text = F.coalesce(F.col(column), F.lit(""))
    base = messages.select(key, words(text).alias("_w"), text.rlike(MONEY_PATTERN).alias("_money"))
    if per_row:
        forms = {i: [f for f, of in intent_lexicon_rows() if of == i] for i in INTENT_ORDER}

        def count(intent: str):
            return F.size(F.filter("_w", lambda w: w.isin(*forms[intent])))

        wide = base.select(key, "_money", *[count(i).alias(f"_{i}") for i in INTENT_ORDER])
    else:
        toks = base.select(key, "_money", F.explode_outer("_w").alias("form"))
        hits = toks.join(F.broadcast(intent_lexicon(spark)), "form", "left")
        wide = hits.groupBy(key).agg(*[F.count_if(F.col("intent") == i).alias(f"_{i}") for i in INTENT_ORDER],
                                     F.bool_or("_money").alias("_money"))
    if gazetteer is None:
        wide = wide.withColumn("_news", F.lit(False))
    else:
        orgs = gazetteer.where((F.col("label") == "ORG") & F.contains(F.lower("surface"), F.lit("newsletter")))
        named = message_entities(messages.select(F.col(key).alias("from"), F.lit(None).cast("string").alias("id"), column),
                                 orgs, column)
        named = named.where(F.col("label") == "ORG").select(F.col("from").alias("_of"), F.lit(True).alias("_hit")).distinct()
        wide = (wide.join(named, F.col(key).eqNullSafe(F.col("_of")), "left")
                .withColumn("_news", F.coalesce("_hit", F.lit(False))))
    bonus = {"transactional": F.when(F.col("_money"), MONEY_BONUS).otherwise(0),
             "promotional": F.when(F.col("_news"), NEWSLETTER_BONUS).otherwise(0)}
    return wide.select(key, *[(F.col(f"_{i}") + bonus.get(i, F.lit(0))).cast("long").alias(i) for i in INTENT_ORDER])


def intent_scores(messages: DataFrame, key: str = "from", gazetteer: DataFrame | None = None,
                  column: str = "snippet", content_features: bool = True, per_row: bool = False) -> DataFrame:
    """``(key, intent, intent_rank, score)``: the four scores of every key as rows."""
    wide = intent_scores_wide(messages, key, gazetteer, column, content_features, per_row)
    stack = ", ".join(f"'{i}', {r}, `{i}`" for r, i in enumerate(INTENT_ORDER, 1))
    return wide.selectExpr(f"`{key}`", f"stack({len(INTENT_ORDER)}, {stack}) AS (intent, intent_rank, score)")


def top_intents(messages: DataFrame, n: int = 3, key: str = "from", gazetteer: DataFrame | None = None,
                column: str = "snippet", content_features: bool = True, per_row: bool = False) -> DataFrame:
    """Top ``n`` intents per key by score (ties: promotional, transactional,
    informational, social). A key whose best score is 0 gets ``unknown`` / 0.

    Ranking is row-local: the four scores are sorted as an array, so no
    window or second shuffle is involved.
    """
    wide = intent_scores_wide(messages, key, gazetteer, column, content_features, per_row)
    entries = F.array(*[F.struct((-F.col(i)).alias("k"), F.lit(r).alias("r"), F.lit(i).alias("intent"),
                                 F.col(i).alias("score")) for r, i in enumerate(INTENT_ORDER, 1)])
    best = F.greatest(*[F.col(i) for i in INTENT_ORDER])
    unknown = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).alias("r"), F.lit("unknown").alias("intent"),
                               F.lit(0).cast("long").alias("score")))
    top = F.when(best > 0, F.slice(F.array_sort(entries), 1, n)).otherwise(unknown)
    return (wide.select(key, F.posexplode(top).alias("_pos", "_x"))
            .select(key, (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_x.intent").alias("intent"),
                    F.col("_x.score").alias("score")))


__all__ = [
    "sender_subjects", "sender_snippets", "cache_subjects", "cache_snippets", "top_senders_by_subjects", "first_subject", "snippet_counts",
    "classify_subjects", "subject_class_counts", "subject_words", "cleaned", "message_keywords",
    "keyword_counts", "top_k", "top_keywords", "message_entities",
    "entity_counts", "top_entities", "intent_lexicon_rows", "intent_lexicon", "intent_scores", "intent_scores_wide",
    "top_intents",
]
