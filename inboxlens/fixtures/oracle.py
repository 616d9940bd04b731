"""DuckDB statements that recompute each registered query straight from the
test tables (views ``orders``, ``events``, ``documents``, ``nation``,
``region`` are registered by the checker). Doubles are rounded to 6 places
on both sides."""

from __future__ import annotations

from inboxlens.fixtures.views import (CACHED_BEFORE, EVENTS_AS_OF, MAILBOX_SINCE, ORDERS_AS_OF)
from inboxlens.operators.content import intent_lexicon_rows
from inboxlens.schemas import (COMMON_WORDS, INTENT_ORDER, KEYWORD_STOP_WORDS, PROMOTIONAL_KEYWORDS,
                               VALUABLE_KEYWORDS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def age_sql(ts: str, as_of: str) -> str:
    return (f"CAST(floor((epoch_us(TIMESTAMP {_q(as_of)}) - epoch_us({ts})) / 86400000000.0) AS BIGINT)")


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


# Written apart from the patterns of the operators.
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_FULL = "(?:" + "|".join(_MONTHS) + ")"
_SHORT = "(?:" + "|".join(m[:3] for m in _MONTHS if m != "May") + "|Sept)"
_MON = rf"(?:{_FULL}|{_SHORT}\.|{_SHORT}\b)"
_NTH = "[0-9][0-9]?(?:st|nd|rd|th)?"
_AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?(?: ?(?:thousand|million|billion|trillion|bn|k|m)\b)?"
_ISO = "(?:" + "|".join(["USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "INR", "CNY"]) + ")"
_COIN = "(?:" + "|".join(x + "s?" for x in ("dollar", "euro", "pound", "cent", "rupee", "franc")) + "|yen|yuan)"
MONEY_RX = rf"(?i)(?:(?:\b(?:US|A|C))?[£$€₹¥]\s?{_AMOUNT}|\b{_ISO}\s?{_AMOUNT}|\b{_AMOUNT}\s?(?:{_COIN}|{_ISO})\b)"
DATE_RX = ("(?i)\\b(?:" + "|".join([
    "[0-9]{4}-[0-9]{2}-[0-9]{2}\\b", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\\b", _MON + " " + _NTH + "\\b,? [0-9]{4}\\b",
    _MON + " " + _NTH + "\\b", _NTH + " (?:of )?" + _MON + ",? [0-9]{4}\\b", _NTH + " (?:of )?(?:" + _FULL + "\\b|" + _SHORT
    + "\\.|" + _SHORT + "\\b)", _MON + " [0-9]{4}\\b",
    "(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|tomorrow|yesterday)\\b"]) + ")")


ORDER_FLAGS = """o_orderstatus <> 'F' AS unread, o_orderpriority = '1-URGENT' AS starred,
       o_orderpriority IN ('1-URGENT', '2-HIGH') AS important, o_orderpriority = '5-LOW' AS social,
       o_orderpriority = '3-MEDIUM' AS updates, o_orderpriority = '4-NOT SPECIFIED' AS promotions"""

ORDER_LABELS = """list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'UNREAD' END,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'STARRED' END,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'IMPORTANT' END,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'CATEGORY_SOCIAL' END,
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'CATEGORY_UPDATES' END,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'CATEGORY_PROMOTIONS' END], lambda x: x IS NOT NULL)"""


def mail_orders(as_of: str = ORDERS_AS_OF, where: str = "TRUE") -> str:
    return f"""SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id,
       'cust' || CAST(o_custkey AS VARCHAR) || '@example.com' AS "from",
       {ORDER_FLAGS},
       o_orderdate AS ts, {age_sql('o_orderdate', as_of)} AS age_days
FROM orders WHERE {where}"""


def mail_events(as_of: str = EVENTS_AS_OF) -> str:
    return f"""SELECT 'e' || CAST(event_id AS VARCHAR) AS id,
       'user' || CAST(user_id AS VARCHAR) || '@example.com' AS "from",
       event_type IN ('error', 'signup') AS unread, FALSE AS starred, FALSE AS important,
       event_type = 'click' AS social, event_type IN ('error', 'signup') AS updates,
       event_type = 'view' AS promotions, ts,
       CASE event_type WHEN 'purchase' THEN 'Your receipt' WHEN 'view' THEN 'Weekend deals'
            WHEN 'click' THEN 'New comment' WHEN 'signup' THEN 'Account balance update'
            ELSE 'Status report' END AS subject,
       CASE event_type
         WHEN 'purchase' THEN 'Your order is on its way. Payment of $' ||
              CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' received. Invoice attached.'
         WHEN 'view' THEN 'Buy now and save on our limited offer! Subscribe to our newsletter for exclusive deals.'
         WHEN 'click' THEN 'A friend left a comment on your post. Follow the group.'
         WHEN 'signup' THEN '' ELSE 'Update: status report and event summary.' END AS snippet,
       {age_sql('ts', as_of)} AS age_days
FROM events"""


MAIL_DOCS = """SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, source || '@example.com' AS "from",
       text AS snippet, split_part(text, chr(10), 1) AS subject, doc_id AS ord
FROM documents"""

MAIL_DOCS_WHOLE = MAIL_DOCS.replace("split_part(text, chr(10), 1)", "text")

MAIL_CUSTOMERS = """SELECT 'k' || CAST(c_custkey AS VARCHAR) AS id, lower(c_mktsegment) || '@example.com' AS "from",
       c_name || ' of ' || upper(n_name[1]) || lower(n_name[2:]) || ' met Supplier#' ||
       lpad(CAST(c_nationkey AS VARCHAR), 9, '0') || ' and took Brand#' || CAST(c_nationkey + 1 AS VARCHAR) || ' for ' ||
       CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) || ' Dollars at the ' || upper(c_mktsegment[1]) ||
       lower(c_mktsegment[2:]) || ' trade fair of the year on ' || CAST(c_custkey % 28 + 1 AS VARCHAR) || ' March 2024' ||
       '. Market 24 and decision 3 cost USD ' || CAST(c_custkey AS VARCHAR) || ',000, $1.2 million, 5k EUR or 30 pounds by the ' ||
       CAST(c_custkey % 10 + 4 AS VARCHAR) || 'th of May 2024, Sept. ' || CAST(c_custkey % 28 + 1 AS VARCHAR) || ' or June 2025' AS snippet
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

CUSTOMER_GAZETTEER = """(SELECT 'PERSON' AS label, c_name AS surface FROM customer
   UNION SELECT 'GPE', upper(n_name[1]) || lower(n_name[2:]) FROM nation
   UNION SELECT 'ORG', s_name FROM supplier UNION SELECT 'PRODUCT', p_brand FROM part
   UNION SELECT 'EVENT', upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' trade fair of the year' FROM customer)"""


def senders_from(msgs: str) -> str:
    """E1 over a message CTE name."""
    return f"""SELECT "from", total_volume, unread_count, starred_count, important_count, social_count,
       updates_count, promotions_count, avg_recency_days, open_rate,
       CAST(total_volume AS DOUBLE) * (100.0 - open_rate) AS ignorance_score
FROM (SELECT "from", CAST(count(id) AS BIGINT) AS total_volume,
             CAST(count_if(unread) AS BIGINT) AS unread_count,
             CAST(count_if(starred) AS BIGINT) AS starred_count,
             CAST(count_if(important) AS BIGINT) AS important_count,
             CAST(count_if(social) AS BIGINT) AS social_count,
             CAST(count_if(updates) AS BIGINT) AS updates_count,
             CAST(count_if(promotions) AS BIGINT) AS promotions_count,
             avg(CAST(age_days AS DOUBLE)) AS avg_recency_days,
             (CAST(count(id) AS DOUBLE) - count_if(unread)) / CAST(count(id) AS DOUBLE) * 100.0 AS open_rate
      FROM {msgs} WHERE age_days IS NOT NULL AND "from" IS NOT NULL GROUP BY "from")"""


SENDER_COLS = ('"from", total_volume, unread_count, starred_count, important_count, social_count, '
               'updates_count, promotions_count, round(avg_recency_days, 6) AS avg_recency_days, '
               'round(open_rate, 6) AS open_rate, round(ignorance_score, 6) AS ignorance_score')


def with_v1(body: str, as_of: str = ORDERS_AS_OF) -> str:
    return f"WITH m AS ({mail_orders(as_of)}),\n s AS ({senders_from('m')})\n{body}"


def with_v2(body: str) -> str:
    return f"WITH m AS ({mail_events()}),\n s AS ({senders_from('m')})\n{body}"


def with_v3(body: str) -> str:
    return f"WITH m AS ({MAIL_DOCS})\n{body}"


TIER = ("CASE WHEN open_rate >= 80 THEN 'high' WHEN open_rate >= 50 THEN 'medium' "
        "WHEN open_rate >= 1 THEN 'low' WHEN open_rate = 0 THEN 'zero' END")
TIER_NAME = ("CASE tier WHEN 'high' THEN 'High Engagement (80-100%)' WHEN 'medium' THEN 'Medium Engagement (50-79%)' "
             "WHEN 'low' THEN 'Low Engagement (1-49%)' WHEN 'zero' THEN 'Zero Engagement (0%)' END")
TIER_RANK = "CASE tier WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'zero' THEN 4 END"


def pct(v: str, t: str) -> str:
    return f"coalesce(CAST({v} AS DOUBLE) / nullif(CAST({t} AS DOUBLE), 0) * 100.0, 0.0)"


def overall_sql(src: str = "s") -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total_senders,
       CAST(coalesce(sum(total_volume), 0) AS BIGINT) AS total_emails,
       round({pct('sum(unread_count)', 'sum(total_volume)')}, 6) AS unread_percentage,
       round(coalesce(avg(open_rate), 0.0), 6) AS average_open_rate,
       CAST(count_if(open_rate = 0) AS BIGINT) AS senders_never_opened,
       round(coalesce(max(ignorance_score), 0.0), 6) AS top_ignorance_score
FROM {src}"""


def overall_raw(src: str = "s") -> str:
    return f"""SELECT {pct('sum(unread_count)', 'sum(total_volume)')} AS unread_percentage,
       coalesce(avg(open_rate), 0.0) AS average_open_rate,
       coalesce(max(ignorance_score), 0.0) AS top_ignorance_score FROM {src}"""


# ---- raw cache (V4) extraction, computed straight from orders ---------------------------------

def v4_extract(where: str = "TRUE") -> str:
    date = ("CASE WHEN o_orderkey % 50 = 0 THEN 'Unknown' ELSE "
            "strftime(o_orderdate, '%a, %-d %b %Y %H:%M:%S +0000') END")
    return f"""SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, {ORDER_FLAGS},
       'cust' || CAST(o_custkey AS VARCHAR) || '@example.com' AS "from",
       'No Subject' AS subject, {date} AS date,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {age_sql('o_orderdate', ORDERS_AS_OF)} END AS age_days,
       '' AS snippet, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '2001-08-30T00:00:00+00:00'
            ELSE '2001-08-01T00:00:00+00:00' END AS fetched_at,
       array_to_string({ORDER_LABELS}, ',') AS labels
FROM orders WHERE {where}"""


MSG_COLS = ('id, unread, starred, important, social, updates, promotions, "from", subject, date, '
            'age_days, snippet')

MAILBOX_WHERE = f"o_orderdate >= TIMESTAMP '{MAILBOX_SINCE}'"
CACHED_WHERE = f"o_orderdate < TIMESTAMP '{CACHED_BEFORE}'"


def stale_sql(fetched_at: str, as_of: str = ORDERS_AS_OF, ttl: int = 7) -> str:
    return (f"coalesce(floor((epoch_us(TIMESTAMP {_q(as_of)}) - epoch_us(CAST({fetched_at} AS TIMESTAMPTZ))) "
            f"/ 86400000000.0) >= {ttl}, TRUE)")


# refresh scenario: plan, fetched ids and the cache after upsert + prune
REFRESH_CTES = f"""lst AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {MAILBOX_WHERE}),
 old AS ({v4_extract(CACHED_WHERE)}),
 plan AS (SELECT l.id, CASE WHEN o.id IS NULL THEN 'missing' ELSE 'stale' END AS reason
          FROM lst l LEFT JOIN old o ON l.id = o.id
          WHERE o.id IS NULL OR {stale_sql('o.fetched_at')}),
 got AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id FROM orders
         WHERE o_orderstatus <> 'P' AND 'o' || CAST(o_orderkey AS VARCHAR) IN (SELECT id FROM plan)),
 cache2 AS (SELECT id, fetched_at FROM old WHERE id NOT IN (SELECT id FROM got)
            UNION ALL SELECT id, '{ORDERS_AS_OF.replace(' ', 'T')}+00:00' AS fetched_at FROM got),
 kept AS (SELECT id FROM cache2 WHERE id IN (SELECT id FROM lst))"""


# ---- text ---------------------------------------------------------------------------------------

def keyword_list_sql(x: str) -> str:
    return (f"list_filter(string_split({clean_sql(x)}, ' '), "
            f"lambda w: length(w) > 2 AND NOT list_contains({_list(KEYWORD_STOP_WORDS)}, w))")


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def subject_class_sql(subject: str) -> str:
    low = f"lower(coalesce({subject}, ''))"
    return (f"CASE WHEN {any_contains(low, VALUABLE_KEYWORDS)} THEN 'valuable' "
            f"WHEN {any_contains(low, PROMOTIONAL_KEYWORDS)} THEN 'promotional' ELSE 'uncategorized' END")


def common_words_sql(words: str) -> str:
    return (f"list_transform(list_filter({words}, lambda w: length(w) > 3 AND "
            f"NOT list_contains({_list(COMMON_WORDS)}, lower(w))), lambda w: lower(w))")


def lexicon_values() -> str:
    return "(VALUES " + ", ".join(f"({_q(f)}, {_q(i)})" for f, i in intent_lexicon_rows()) + ") AS lex(form, intent)"


INTENTS_VALUES = "(VALUES " + ", ".join(f"({_q(i)}, {r})" for r, i in enumerate(INTENT_ORDER, 1)) + \
    ") AS it(intent, intent_rank)"


def entities_cte(src: str, gaz: str) -> str:
    """(from, id, label, entity) distinct per message, for a message CTE with ``snippet``."""
    return f"""ent_src AS (SELECT "from", id, coalesce(snippet, '') AS t FROM {src}),
 ent_tok AS (SELECT "from", id, string_split({clean_sql('t')}, ' ') AS tok FROM ent_src),
 gaz AS (SELECT label, surface, {clean_sql('surface')} AS gram FROM {gaz}),
 ent_gram AS (SELECT "from", id, array_to_string(list_slice(tok, p, p + n - 1), ' ') AS gram
              FROM ent_tok, (SELECT DISTINCT CAST(len(string_split(gram, ' ')) AS BIGINT) AS n FROM gaz) AS r,
              LATERAL (SELECT unnest(range(1, len(tok) - n + 2)) AS p)),
 ents AS (SELECT DISTINCT "from", id, label, entity FROM (
     SELECT "from", id, 'MONEY' AS label, unnest(regexp_extract_all(t, {_q(MONEY_RX)})) AS entity FROM ent_src
     UNION ALL
     SELECT "from", id, 'DATE' AS label, unnest(regexp_extract_all(t, {_q(DATE_RX)})) AS entity FROM ent_src
     UNION ALL
     SELECT g."from", g.id, z.label, z.surface AS entity FROM ent_gram g JOIN gaz z ON g.gram = z.gram)
   WHERE length(entity) > 0)"""


GAZETTEER_SQL = """(SELECT 'GPE' AS label, upper(substr(lower(n_name), 1, 1)) || substr(lower(n_name), 2) AS surface FROM nation
   UNION SELECT 'GPE', upper(substr(lower(r_name), 1, 1)) || substr(lower(r_name), 2) FROM region
   UNION SELECT 'ORG', 'newsletter')"""


def intent_scores_cte(src: str, key: str = '"from"') -> str:
    """scores(k, intent, intent_rank, score) for a message CTE with ``snippet``; needs ``ents``."""
    return f"""keys AS (SELECT DISTINCT {key} AS k FROM {src}),
 grid AS (SELECT k, intent, intent_rank FROM keys, {INTENTS_VALUES}),
 toks AS (SELECT {key} AS k, unnest(string_split({clean_sql('snippet')}, ' ')) AS form FROM {src}),
 hits AS (SELECT k, intent, count(*) AS n FROM toks JOIN {lexicon_values()} USING (form) GROUP BY k, intent),
 flags AS (SELECT {'"from"' if key == '"from"' else 'id'} AS k, bool_or(label = 'MONEY') AS money,
                  bool_or(label = 'ORG' AND contains(lower(entity), 'newsletter')) AS news
           FROM ents GROUP BY 1),
 scores AS (SELECT g.k, g.intent, g.intent_rank,
                   CAST(coalesce(h.n, 0) + CASE WHEN g.intent = 'transactional' AND f.money THEN 2
                                              WHEN g.intent = 'promotional' AND f.news THEN 2 ELSE 0 END AS BIGINT) AS score
            FROM grid g LEFT JOIN hits h ON g.k = h.k AND g.intent = h.intent LEFT JOIN flags f ON g.k = f.k)"""


def top_intents_cte(n: int) -> str:
    return f"""ranked AS (SELECT k, intent, score,
                   row_number() OVER (PARTITION BY k ORDER BY score DESC, intent_rank) AS rank,
                   max(score) OVER (PARTITION BY k) AS best FROM scores),
 topi AS (SELECT k, CAST(rank AS INTEGER) AS rank, intent, score FROM ranked WHERE best > 0 AND rank <= {n}
          UNION ALL SELECT k, 1, 'unknown', CAST(0 AS BIGINT) FROM ranked WHERE best = 0 AND rank = 1)"""
