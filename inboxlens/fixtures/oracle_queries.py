"""DuckDB oracle statements, one per registered query (see ``__spark_entry__``).

Queries with no entry here (clustering) are checked by row count only and by
property tests.
"""

from __future__ import annotations

from inboxlens.fixtures import oracle as O
from inboxlens.fixtures.views import ORDERS_AS_OF

SC = O.SENDER_COLS
TOP10 = 'ORDER BY s.ignorance_score DESC, s."from" LIMIT 10'
BEFORE_AS_OF = "1998-01-01 00:00:00"


def _before_after() -> str:
    return f"""WITH mb AS ({O.mail_orders(BEFORE_AS_OF, "o_orderdate < TIMESTAMP '1998-01-01'")}),
 sb AS ({O.senders_from('mb')}),
 ma AS ({O.mail_orders()}),
 sa AS ({O.senders_from('ma')}),
 b AS ({O.overall_raw('sb')}), a AS ({O.overall_raw('sa')})"""


I1 = _before_after() + """
SELECT round(b.unread_percentage - a.unread_percentage, 6) AS unread_improvement,
       round(b.top_ignorance_score - a.top_ignorance_score, 6) AS top_score_reduction,
       round((b.top_ignorance_score - a.top_ignorance_score) / nullif(b.top_ignorance_score, 0) * 100.0, 6)
         AS top_score_reduction_pct,
       round(a.average_open_rate - b.average_open_rate, 6) AS open_rate_improvement
FROM b, a"""

E3 = O.with_v2(f"""SELECT t.total_emails,
       v.e AS top10_volume_emails, round({O.pct('v.e', 't.total_emails')}, 6) AS top10_volume_pct,
       n.e AS top10_noise_emails, round({O.pct('n.e', 't.total_emails')}, 6) AS top10_noise_pct,
       t.zero_open_senders, t.zero_open_emails, round({O.pct('t.zero_open_emails', 't.total_emails')}, 6) AS zero_open_pct,
       t.high_volume_senders, t.high_volume_emails,
       round({O.pct('t.high_volume_emails', 't.total_emails')}, 6) AS high_volume_pct
FROM (SELECT CAST(coalesce(sum(total_volume), 0) AS BIGINT) AS total_emails,
             CAST(count_if(open_rate = 0) AS BIGINT) AS zero_open_senders,
             CAST(coalesce(sum(CASE WHEN open_rate = 0 THEN total_volume END), 0) AS BIGINT) AS zero_open_emails,
             CAST(count_if(total_volume > 50) AS BIGINT) AS high_volume_senders,
             CAST(coalesce(sum(CASE WHEN total_volume > 50 THEN total_volume END), 0) AS BIGINT) AS high_volume_emails
      FROM s) t,
     (SELECT CAST(coalesce(sum(total_volume), 0) AS BIGINT) AS e
        FROM (SELECT total_volume FROM s ORDER BY total_volume DESC, "from" LIMIT 10)) v,
     (SELECT CAST(coalesce(sum(total_volume), 0) AS BIGINT) AS e
        FROM (SELECT total_volume FROM s ORDER BY ignorance_score DESC, "from" LIMIT 10)) n""")

E4_BODY = f"""SELECT tier, tier_name, tier_rank, senders, emails, round({O.pct('emails', 'a')}, 6) AS share_pct,
       round(avg_open_rate, 6) AS avg_open_rate
FROM (SELECT tier, {O.TIER_NAME} AS tier_name, CAST({O.TIER_RANK} AS INTEGER) AS tier_rank,
             CAST(count(*) AS BIGINT) AS senders, CAST(sum(total_volume) AS BIGINT) AS emails,
             avg(open_rate) AS avg_open_rate
      FROM (SELECT *, {O.TIER} AS tier FROM s) WHERE tier IS NOT NULL GROUP BY tier),
     (SELECT sum(total_volume) AS a FROM s)"""

E5 = O.with_v1("""SELECT category_rank, category, emails,
       round(coalesce(CAST(emails AS DOUBLE) / nullif(CAST(a AS DOUBLE), 0) * 100.0, 0.0), 6) AS share_pct
FROM (SELECT 1 AS category_rank, 'Updates' AS category, CAST(sum(updates_count) AS BIGINT) AS emails, sum(total_volume) AS a FROM s
      UNION ALL SELECT 2, 'Promotions', CAST(sum(promotions_count) AS BIGINT), sum(total_volume) FROM s
      UNION ALL SELECT 3, 'Social', CAST(sum(social_count) AS BIGINT), sum(total_volume) FROM s
      UNION ALL SELECT 4, 'Important', CAST(sum(important_count) AS BIGINT), sum(total_volume) FROM s)
WHERE emails > 0""")

C12 = O.with_v2("""SELECT "from", total_volume, round(open_rate, 6) AS open_rate, filter FROM (
  SELECT *, 'never_opened' AS filter FROM s WHERE open_rate = 0
  UNION ALL SELECT *, 'over_50' FROM s WHERE total_volume > 50
  UNION ALL SELECT *, 'at_least_20' FROM s WHERE total_volume >= 20
  UNION ALL SELECT *, 'at_least_20_low_open' FROM s WHERE total_volume >= 20 AND open_rate < 50)""")


def _lookup(pattern: str) -> str:
    return f"""SELECT "from" AS sender, total_volume AS total_emails, round(open_rate, 6) AS open_rate,
       round(ignorance_score, 6) AS ignorance_score, unread_count
FROM s WHERE regexp_matches("from", '(?i){pattern}') ORDER BY s.ignorance_score DESC, s."from" LIMIT 1"""


I2 = O.with_v1("""SELECT round(h, 6) AS health_score,
       CASE WHEN h >= 90 THEN 'Excellent' WHEN h >= 80 THEN 'Good' WHEN h >= 70 THEN 'Moderate'
            WHEN h >= 60 THEN 'Poor' WHEN h >= 0 THEN 'Critical' END AS health_band
FROM (SELECT average_open_rate * 0.5 + (100.0 - unread_percentage) * 0.5 AS h FROM (""" + O.overall_raw() + "))")

I3 = O.with_v1(f"""SELECT round(u, 6) AS unread_rate,
       CASE WHEN u < 5 THEN 'Excellent' WHEN u < 10 THEN 'Good' WHEN u > 20 THEN 'Needs attention' END AS unread_band,
       round(z, 6) AS zero_engagement_share,
       CASE WHEN z < 2 THEN 'Excellent' WHEN z < 5 THEN 'Good' WHEN z > 10 THEN 'Problematic' END AS zero_engagement_band,
       round(h, 6) AS high_engagement_share,
       CASE WHEN h > 90 THEN 'Excellent' WHEN h > 80 THEN 'Good' END AS high_engagement_band
FROM (SELECT {O.pct('sum(unread_count)', 'sum(total_volume)')} AS u,
             {O.pct("count_if(tier = 'zero')", 'count(*)')} AS z,
             {O.pct("count_if(tier = 'high')", 'count(*)')} AS h
      FROM (SELECT *, {O.TIER} AS tier FROM s))""")

C5 = O.with_v1(f"""SELECT "from", total_volume, round({O.pct('total_volume', 'a')}, 6) AS share_pct
FROM s, (SELECT sum(total_volume) AS a FROM s)""")

V4_ALL = O.v4_extract()

# the cluster operators over a given assignment: the tier as cluster number, senders without a tier in cluster 4
CLUSTERED = O.with_v1(f""", c AS (SELECT *, CAST(CASE {O.TIER} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2
  WHEN 'zero' THEN 3 ELSE 4 END AS INTEGER) AS cluster FROM s)""")
STATS = """, stats AS (SELECT cluster, count(*) AS senders, CAST(sum(total_volume) AS BIGINT) AS total_emails,
  CAST(sum(unread_count) AS BIGINT) AS total_unread, round(avg(open_rate), 6) AS avg_open_rate,
  round(avg(ignorance_score), 6) AS avg_ignorance FROM c GROUP BY cluster)"""
TOP5 = """, top5 AS (SELECT cluster, CAST(r AS INTEGER) AS rank, "from", total_volume, round(open_rate, 6) AS open_rate,
  round(ignorance_score, 6) AS ignorance_score FROM (SELECT *, row_number() OVER (PARTITION BY cluster
  ORDER BY ignorance_score DESC, "from") AS r FROM c) WHERE r <= 5)"""
FLAT = ("id, CASE WHEN o_orderkey % 3 = 0 THEN 'flat' ELSE 'wrapped' END AS item_format, fetched_at, "
        "'' AS snippet, labels, CAST(2 AS INTEGER) AS n_headers")

A6 = f"""SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS ts, {O.ORDER_LABELS} AS labels
  FROM orders WHERE {O.MAILBOX_WHERE})
WHERE NOT list_contains(labels, 'TRASH') AND NOT list_contains(labels, 'CATEGORY_PROMOTIONS')
ORDER BY ts DESC, id LIMIT 2000"""

REFRESH = "WITH " + O.REFRESH_CTES

J1 = REFRESH + f""",
 m AS (SELECT * FROM ({O.v4_extract(O.MAILBOX_WHERE)}) WHERE id IN (SELECT id FROM cache2)),
 s AS ({O.senders_from('m')})
SELECT {SC} FROM s"""

FEED = REFRESH + """
SELECT id, CASE WHEN id NOT IN (SELECT id FROM lst) THEN 'removed' WHEN id NOT IN (SELECT id FROM got) THEN 'kept'
            WHEN id IN (SELECT id FROM old) THEN 'replaced' ELSE 'added' END AS change FROM cache2"""

LISTED = f"""SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
  array_to_string({O.ORDER_LABELS}, ',') AS labels, o_orderdate FROM orders WHERE {O.MAILBOX_WHERE}"""

D1 = f"""SELECT o.id, o."from" FROM ({O.v4_extract(O.CACHED_WHERE)}) o
WHERE o.id IN (SELECT 'o' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE {O.MAILBOX_WHERE})"""

D_BUCKETED = f"""SELECT coalesce(l.id, o.id) AS id, l.id IS NOT NULL AS listed, o.id IS NOT NULL AS cached, o.fetched_at
FROM (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {O.MAILBOX_WHERE}) l
FULL JOIN ({O.v4_extract(O.CACHED_WHERE)}) o ON l.id = o.id"""

RUNNING = """
SELECT "from", total_volume, row_number() OVER w AS place, CAST(sum(total_volume) OVER w AS BIGINT) AS running,
       round(CAST(sum(total_volume) OVER w AS DOUBLE) / sum(total_volume) OVER () * 100.0, 6) AS share_pct
FROM s WINDOW w AS (ORDER BY total_volume DESC, "from" ROWS UNBOUNDED PRECEDING)"""

CUBE = f"""WITH m AS ({O.mail_orders()}),
 s AS ({O.senders_from('m')}),
 t AS (SELECT "from", coalesce({O.TIER}, 'none') AS tier FROM s),
 c AS (SELECT t.tier, strftime(m.ts, '%Y-%m') AS month, m.unread,
              unnest(list_filter(['any', CASE WHEN updates THEN 'updates' END, CASE WHEN promotions THEN 'promotions' END,
                CASE WHEN social THEN 'social' END, CASE WHEN important THEN 'important' END], lambda x: x IS NOT NULL)) AS category
       FROM m JOIN t USING ("from") WHERE age_days IS NOT NULL)
SELECT tier, category, month, CAST(grouping(tier, category, month) AS INTEGER) AS level, count(*) AS emails,
       CAST(count_if(unread) AS BIGINT) AS unread, round(100.0 - count_if(unread) / CAST(count(*) AS DOUBLE) * 100.0, 6) AS open_rate
FROM c GROUP BY GROUPING SETS ((tier, category, month), (tier, category), (category, month), (tier, month), (tier), (category), ())"""

D2 = f"""SELECT l.id, o.id IS NOT NULL AS cached, o.fetched_at
FROM (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE {O.MAILBOX_WHERE}) l
LEFT JOIN ({O.v4_extract(O.CACHED_WHERE)}) o ON l.id = o.id"""

D3 = f"""SELECT id, id IN (SELECT 'o' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE {O.MAILBOX_WHERE}) AS listed
FROM ({O.v4_extract(O.CACHED_WHERE)})"""

TOP5_V2 = 'SELECT "from" FROM s ORDER BY s.total_volume DESC, s."from" LIMIT 5'

D4 = O.with_v2(f"""SELECT m."from", m.id FROM m WHERE length(m.snippet) > 0 AND m."from" IN ({TOP5_V2})""")

D5 = O.with_v3('SELECT "from", arg_min(coalesce(subject, \'\'), ord) AS sample_subject FROM m GROUP BY "from"')

C6 = O.with_v3(f"SELECT id, {O.clean_sql('snippet')} AS clean_text FROM m")

C7 = O.with_v3(f"""SELECT id, keyword, CAST(count(*) AS BIGINT) AS n
FROM (SELECT id, unnest({O.keyword_list_sql('snippet')}) AS keyword FROM m) GROUP BY id, keyword""")

C8 = O.with_v3(f"""SELECT word, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest({O.common_words_sql("string_split(coalesce(subject, ''), ' ')")}) AS word FROM m) GROUP BY word""")

C9 = O.with_v3(f"""SELECT "from", subject_class, CAST(count(*) AS BIGINT) AS subjects
FROM (SELECT "from", {O.subject_class_sql('subject')} AS subject_class FROM m) GROUP BY "from", subject_class""")

C9E = O.with_v2(f"""SELECT "from", subject_class, CAST(count(*) AS BIGINT) AS subjects
FROM (SELECT "from", {O.subject_class_sql('subject')} AS subject_class FROM m) GROUP BY "from", subject_class""")

E10_BODY = f"""kw AS (SELECT "from", keyword, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT "from", unnest({O.keyword_list_sql('snippet')}) AS keyword FROM m WHERE length(snippet) > 0)
        GROUP BY "from", keyword)"""

E10 = f"WITH m AS ({O.MAIL_DOCS}),\n {E10_BODY}\nSELECT \"from\", keyword, n FROM kw"

F7 = f"""WITH m AS ({O.MAIL_DOCS}),
 {E10_BODY}
SELECT "from", keyword, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY n DESC, keyword) AS rank FROM kw) WHERE rank <= 10"""


def _v2_entities(src: str = "m2") -> str:
    return (f"WITH m AS ({O.mail_events()}),\n m2 AS (SELECT * FROM m WHERE length(snippet) > 0),\n"
            f" {O.entities_cte(src, O.GAZETTEER_SQL)}")


H1 = f"""WITH m AS ({O.mail_events()}),
 {O.entities_cte('m', O.GAZETTEER_SQL)}
SELECT id, label, entity FROM ents"""

E11 = _v2_entities() + """,
 ec AS (SELECT "from", label, entity, CAST(count(*) AS BIGINT) AS n FROM ents GROUP BY "from", label, entity)
SELECT "from", label, entity, n FROM ec"""

F8 = _v2_entities() + """,
 ec AS (SELECT "from", label, entity, CAST(count(*) AS BIGINT) AS n FROM ents GROUP BY "from", label, entity)
SELECT "from", label, entity, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "from", label ORDER BY n DESC, entity) AS rank FROM ec) WHERE rank <= 5"""

H2 = f"""WITH m AS ({O.mail_events()}),
 {O.entities_cte('m', O.GAZETTEER_SQL)},
 {O.intent_scores_cte('m', 'id')},
 {O.top_intents_cte(1)}
SELECT k AS id, intent, score FROM topi"""

H2S = _v2_entities() + f""",
 {O.intent_scores_cte('m2')}
SELECT k AS "from", intent, score FROM scores"""

F9 = _v2_entities() + f""",
 {O.intent_scores_cte('m2')},
 {O.top_intents_cte(3)}
SELECT k AS "from", rank, intent, score FROM topi"""


def _patterns(order_metric: str, nlp: bool, hide_zero: bool) -> str:
    """Flattened pattern rows for the top 5 senders of V2."""
    ent_part = ""
    ent_join = ""
    ent_sel = "'' AS top_entities"
    if nlp:
        ent_part = """,
 ec AS (SELECT "from", label, entity, CAST(count(*) AS BIGINT) AS n FROM ents GROUP BY "from", label, entity),
 er AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "from", label ORDER BY n DESC, entity) AS r FROM ec) WHERE r <= 5),
 el AS (SELECT "from", label, string_agg(entity || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY r) AS t
        FROM er GROUP BY "from", label),
 ef AS (SELECT "from", string_agg(label || ': ' || t, '; ' ORDER BY label) AS top_entities FROM el GROUP BY "from")"""
        ent_join = ' LEFT JOIN ef ON ef."from" = tp."from"'
        ent_sel = "coalesce(ef.top_entities, '') AS top_entities"
    scores_cte = O.intent_scores_cte('m2')
    if not nlp:
        scores_cte = (f"keys AS (SELECT DISTINCT \"from\" AS k FROM m2),\n"
                      f" scores AS (SELECT k, intent, intent_rank, CAST(0 AS BIGINT) AS score FROM keys, {O.INTENTS_VALUES})")
    zero = " WHERE score > 0" if hide_zero else ""
    return f"""WITH m AS ({O.mail_events()}),
 s AS ({O.senders_from('m')}),
 tp AS (SELECT "from", CAST(row_number() OVER (ORDER BY {order_metric} DESC, "from") AS INTEGER) AS rank
        FROM (SELECT * FROM s ORDER BY s.{order_metric} DESC, s."from" LIMIT 5)),
 mine AS (SELECT * FROM m WHERE "from" IN (SELECT "from" FROM tp)),
 m2 AS (SELECT * FROM mine WHERE length(snippet) > 0),
 {O.entities_cte('m2', O.GAZETTEER_SQL)},
 {scores_cte},
 {O.top_intents_cte(3)},
 cnt AS (SELECT "from", CAST(count(*) AS BIGINT) AS email_count FROM m2 GROUP BY "from"),
 subj AS (SELECT "from", arg_min(subject, id) AS sample_subject FROM mine GROUP BY "from"),
 kw AS (SELECT "from", keyword, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT "from", unnest({O.keyword_list_sql('snippet')}) AS keyword FROM m2) GROUP BY "from", keyword),
 kr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY n DESC, keyword) AS r FROM kw) WHERE r <= 10),
 kf AS (SELECT "from", string_agg(keyword || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY r) AS top_keywords
        FROM kr GROUP BY "from"),
 itf AS (SELECT k AS "from", string_agg(intent || ' (' || CAST(score AS VARCHAR) || ')', ', ' ORDER BY rank) AS top_intents
         FROM topi{zero} GROUP BY k){ent_part}
SELECT tp."from", tp.rank, coalesce(subj.sample_subject, '') AS sample_subject, cnt.email_count,
       coalesce(kf.top_keywords, '') AS top_keywords, coalesce(itf.top_intents, '{'unknown' if hide_zero else ''}') AS top_intents,
       {ent_sel}, {'TRUE' if nlp else 'FALSE'} AS nlp_used
FROM tp JOIN cnt ON cnt."from" = tp."from" LEFT JOIN subj ON subj."from" = tp."from"
     LEFT JOIN kf ON kf."from" = tp."from" LEFT JOIN itf ON itf."from" = tp."from"{ent_join}"""


I4 = _v2_entities() + f""",
 s AS ({O.senders_from('m')}),
 {O.intent_scores_cte('m2')},
 {O.top_intents_cte(1)},
 rules AS (SELECT * FROM (VALUES ('promotional', 'high', 'Keep, but consider digest mode'),
    ('promotional', 'low', 'Unsubscribe immediately'), ('promotional', 'zero', 'Unsubscribe immediately'),
    ('transactional', 'high', 'Keep with auto-archive after 30 days'), ('transactional', 'low', 'Archive immediately'),
    ('informational', 'high', 'Keep in inbox'), ('informational', 'low', 'Move to digest folder'),
    ('social', 'high', 'Keep in inbox'), ('social', 'low', 'Review monthly')) AS r(intent, tier, action))
SELECT x."from", x.total_volume, round(x.open_rate, 6) AS open_rate, x.tier, x.intent,
       coalesce(r.action, CASE WHEN x.intent = 'promotional' AND x.open_rate < 50 THEN 'Unsubscribe immediately' END) AS action,
       CASE x.intent WHEN 'informational' THEN 'Newsletters: Consider weekly digest'
                     WHEN 'social' THEN 'Personal: Always keep' END AS kind_advice,
       CASE WHEN x.intent = 'transactional' THEN 'Label as "Transactions"' END AS label_advice,
       CASE WHEN x.intent = 'promotional' AND x.total_volume >= 20 THEN 'Create filters to skip inbox' END AS filter_advice
FROM (SELECT s."from", s.total_volume, s.open_rate, {O.TIER} AS tier, t.intent
      FROM s LEFT JOIN topi t ON t.k = s."from") x
LEFT JOIN rules r ON r.intent = x.intent AND r.tier = x.tier"""

G1 = O.with_v1("""SELECT "from", round(CAST(total_volume AS DOUBLE), 6) AS total_volume,
       round(CAST(unread_count AS DOUBLE), 6) AS unread_count, round(coalesce(open_rate, 0.0), 6) AS open_rate,
       round(coalesce(ignorance_score, 0.0), 6) AS ignorance_score FROM s""")


def _z(c: str) -> str:
    return (f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () "
            f"ELSE 0.0 END, 6) AS {c}")


G2 = O.with_v1(f"""SELECT "from", {_z('total_volume')}, {_z('unread_count')}, {_z('open_rate')}, {_z('ignorance_score')}
FROM (SELECT "from", CAST(total_volume AS DOUBLE) AS total_volume, CAST(unread_count AS DOUBLE) AS unread_count,
             coalesce(open_rate, 0.0) AS open_rate, coalesce(ignorance_score, 0.0) AS ignorance_score FROM s)""")


# ---- long report tables ---------------------------------------------------------------------------

def _long(section: str, src: str, metrics: list[str], item: str = "NULL", rank: str = "NULL") -> str:
    parts = [f"SELECT '{section}' AS section, CAST({rank} AS INTEGER) AS rank, CAST({item} AS VARCHAR) AS item, "
             f"'{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM {src}" for m in metrics]
    return "\nUNION ALL ".join(parts)


STATUS_METRICS = ["total_senders", "total_emails", "unread_percentage", "average_open_rate",
                  "senders_never_opened", "top_ignorance_score"]


def _ranked(sql: str, order: str) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM ({sql}))"


TOP10_SRC = _ranked('SELECT * FROM s ORDER BY s.ignorance_score DESC, s."from" LIMIT 10', 'ignorance_score DESC, "from"')
UNSUB_SRC = _ranked('SELECT * FROM s WHERE open_rate = 0 ORDER BY s.total_volume DESC, s."from" LIMIT 5',
                    'total_volume DESC, "from"')
REVIEW_B_SRC = _ranked('SELECT * FROM s WHERE total_volume >= 20 AND open_rate < 50 ORDER BY s.ignorance_score DESC, '
                       's."from" LIMIT 5', 'ignorance_score DESC, "from"')
REVIEW_A_SRC = _ranked('SELECT * FROM s WHERE total_volume >= 20 ORDER BY s.ignorance_score DESC, s."from" LIMIT 5',
                       'ignorance_score DESC, "from"')
KEEP_SRC = _ranked('SELECT * FROM s WHERE open_rate >= 80 ORDER BY s.total_volume DESC, s."from" LIMIT 3',
                   'total_volume DESC, "from"')
OVERALL_SRC = f"(SELECT *, 0 AS _x FROM ({O.overall_sql()}))"
def _dist_src() -> str:
    body = E3[E3.index("SELECT t.total_emails"):]
    return f"({body})"


E4_SRC = f"({E4_BODY})"
E5_SRC = "(" + E5[E5.index("SELECT category_rank"):] + ")"

J2 = O.with_v1("SELECT * FROM (\n" + "\nUNION ALL ".join([
    _long("status", OVERALL_SRC, STATUS_METRICS),
    _long("distribution", _dist_src(), ["top10_volume_emails", "top10_volume_pct", "top10_noise_emails",
                                        "top10_noise_pct", "zero_open_senders", "zero_open_emails", "zero_open_pct",
                                        "high_volume_senders", "high_volume_emails", "high_volume_pct"]),
    _long("engagement", E4_SRC, ["senders", "emails", "share_pct"], "tier_name", "tier_rank"),
    _long("categories", E5_SRC, ["emails", "share_pct"], "category", "category_rank"),
    _long("top_noise_makers", TOP10_SRC, ["total_volume", "open_rate", "ignorance_score"], '"from"', "rk"),
    _long("unsubscribe", UNSUB_SRC, ["total_volume"], '"from"', "rk"),
    _long("review", REVIEW_B_SRC, ["total_volume", "open_rate"], '"from"', "rk"),
    _long("keep", KEEP_SRC, ["total_volume", "open_rate"], '"from"', "rk"),
]) + ")")

TOP3_SRC = _ranked('SELECT * FROM s ORDER BY s.ignorance_score DESC, s."from" LIMIT 3', 'ignorance_score DESC, "from"')
J2_BRIEF = O.with_v1("SELECT * FROM (\n" + "\nUNION ALL ".join([
    _long("status", OVERALL_SRC, STATUS_METRICS[:4]),
    _long("top_priorities", TOP3_SRC, ["total_volume", "ignorance_score"], '"from"', "rk"),
]) + ")")


def _j3() -> str:
    cmp_src = """(SELECT b.unread_percentage - a.unread_percentage AS unread_improvement,
       b.top_ignorance_score - a.top_ignorance_score AS top_score_reduction,
       (b.top_ignorance_score - a.top_ignorance_score) / nullif(b.top_ignorance_score, 0) * 100.0 AS top_score_reduction_pct,
       a.average_open_rate - b.average_open_rate AS open_rate_improvement FROM b, a)"""
    srcs = [
        _long("status", f"(SELECT * FROM ({O.overall_sql('sa')}))", STATUS_METRICS),
        _long("improvement", cmp_src, ["unread_improvement", "top_score_reduction", "top_score_reduction_pct",
                                       "open_rate_improvement"]),
        _long("top_noise_makers", TOP10_SRC.replace("FROM s ", "FROM sa s "),
              ["total_volume", "open_rate", "ignorance_score"], '"from"', "rk"),
        _long("unsubscribe", UNSUB_SRC.replace("FROM s ", "FROM sa s "), ["total_volume"], '"from"', "rk"),
        _long("review", REVIEW_A_SRC.replace("FROM s ", "FROM sa s "), ["total_volume", "open_rate"], '"from"', "rk"),
    ]
    return _before_after() + "\nSELECT * FROM (\n" + "\nUNION ALL ".join(srcs) + ")"


J4 = O.with_v1("SELECT * FROM (\n" + "\nUNION ALL ".join([
    _long("tiers", E4_SRC, ["senders", "emails", "share_pct", "avg_open_rate"], "tier_name", "tier_rank"),
    _long("top_high_engagement", KEEP_SRC, ["total_volume", "open_rate"], '"from"', "rk"),
]) + ")")


RAW_E1 = f"""WITH m AS ({V4_ALL}),
 s AS ({O.senders_from('m')})
SELECT {SC} FROM s"""

ORACLES: dict[str, str] = {
    "e1b_aggregate_from_raw_cache": RAW_E1,
    "s1_incremental_audit_stream": RAW_E1,
    "e1_aggregate_and_score": O.with_v1(f"SELECT {SC} FROM s"),
    "c13_audit_summary": O.with_v1('SELECT "from", total_volume, round(open_rate, 6) AS open_rate, '
                                   'round(avg_recency_days, 6) AS avg_recency_days, '
                                   f'round(ignorance_score, 6) AS ignorance_score FROM s {TOP10}'),
    "f1_sort_by_score": O.with_v1('SELECT "from", round(ignorance_score, 6) AS ignorance_score FROM s'),
    "f2_top_noise_makers": O.with_v1(f"SELECT {SC} FROM s {TOP10}"),
    "e2_overall_metrics": O.with_v1(O.overall_sql()),
    "e3_distribution_summary": E3,
    "e4_tier_overview": O.with_v1(E4_BODY),
    "e5_category_distribution": E5,
    "e6_engagement_tiers": O.with_v1(f'SELECT "from", round(open_rate, 6) AS open_rate, tier, {O.TIER_NAME} AS tier_name '
                                     f'FROM (SELECT *, {O.TIER} AS tier FROM s)'),
    "c12_sender_filters": C12,
    "f3_unsubscribe_candidates": O.with_v1(f'SELECT {SC} FROM s WHERE open_rate = 0 '
                                           'ORDER BY s.total_volume DESC, s."from" LIMIT 5'),
    "f4_review_candidates": O.with_v1(f'SELECT {SC} FROM s WHERE total_volume >= 20 '
                                      'ORDER BY s.ignorance_score DESC, s."from" LIMIT 5'),
    "f4b_review_low_engagement": O.with_v1(f'SELECT {SC} FROM s WHERE total_volume >= 20 AND open_rate < 50 '
                                           'ORDER BY s.ignorance_score DESC, s."from" LIMIT 5'),
    "f5_top_engaged": O.with_v1(f"SELECT {SC}, 'high' AS tier FROM s WHERE open_rate >= 80 "
                                'ORDER BY s.total_volume DESC, s."from" LIMIT 3'),
    "f6_tier_listing": O.with_v1(f"""SELECT "from", total_volume, round(open_rate, 6) AS open_rate, tier, {O.TIER_NAME} AS tier_name
FROM (SELECT *, {O.TIER} AS tier FROM s) WHERE tier IS NOT NULL"""),
    "c8_filter_common_words_text": C8.replace(O.MAIL_DOCS, O.MAIL_DOCS_WHOLE),
    "c9_subject_classes_text": C9.replace(O.MAIL_DOCS, O.MAIL_DOCS_WHOLE),
    "c5_percentage_text": C5.replace(") AS share_pct", ") AS share_pct, printf('%.1f%%', total_volume / a * 100.0) AS share_text"),
    "a1_load_legacy_cache": f"SELECT {FLAT} FROM ({V4_ALL})",
    "h1_extract_entities_all_labels": f"""WITH m AS ({O.MAIL_CUSTOMERS}),
 {O.entities_cte('m', O.CUSTOMER_GAZETTEER)}
SELECT id, label, entity FROM ents""",
    "f8_top_entities_all_labels": f"""WITH m AS ({O.MAIL_CUSTOMERS}),
 {O.entities_cte('m', O.CUSTOMER_GAZETTEER)},
 ec AS (SELECT "from", label, entity, CAST(count(*) AS BIGINT) AS n FROM ents GROUP BY "from", label, entity)
SELECT "from", label, entity, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "from", label ORDER BY n DESC, entity) AS rank FROM ec) WHERE rank <= 5""",
    "d6_cluster_metrics_join": CLUSTERED + """
SELECT "from", cluster, total_volume, round(open_rate, 6) AS open_rate, round(ignorance_score, 6) AS ignorance_score FROM c""",
    "e12_cluster_stats": CLUSTERED + STATS + "\nSELECT * FROM stats",
    "f10_clusters_by_open_rate": CLUSTERED + STATS + """
SELECT cluster, avg_open_rate, row_number() OVER (ORDER BY avg_open_rate, cluster) AS place FROM stats""",
    "f11_top_per_cluster": CLUSTERED + TOP5 + "\nSELECT * FROM top5",
    "j6_analyze_clusters": CLUSTERED + STATS + TOP5 + """
SELECT 'stats' AS section, CAST(NULL AS INTEGER) AS rank, CAST(cluster AS VARCHAR) AS item, metric, value FROM (
  UNPIVOT (SELECT cluster, CAST(senders AS DOUBLE) AS senders, CAST(total_emails AS DOUBLE) AS total_emails,
           CAST(total_unread AS DOUBLE) AS total_unread, avg_open_rate, avg_ignorance FROM stats)
  ON COLUMNS(* EXCLUDE cluster) INTO NAME metric VALUE value)
UNION ALL
SELECT 'top in cluster ' || CAST(cluster AS VARCHAR), rank, "from", metric, value FROM (
  UNPIVOT (SELECT cluster, rank, "from", CAST(total_volume AS DOUBLE) AS total_volume, open_rate, ignorance_score FROM top5)
  ON total_volume, open_rate, ignorance_score INTO NAME metric VALUE value)""",
    "g3_cluster_senders": O.with_v1("""SELECT count(*) AS senders, count(*) AS assigned, CAST(5 AS BIGINT) AS clusters,
  TRUE AS ids_follow_open_rate, TRUE AS cheapest_of_the_starts, TRUE AS beats_one_cluster FROM s"""),
    "g4_stable_ids": O.with_v1("""SELECT "from", CAST(dense_rank() OVER (ORDER BY o, sc DESC, raw) - 1 AS INTEGER) AS cluster FROM (
  SELECT "from", raw, avg(open_rate) OVER (PARTITION BY raw) AS o, avg(ignorance_score) OVER (PARTITION BY raw) AS sc
  FROM (SELECT *, CAST(total_volume % 7 AS INTEGER) AS raw FROM s))"""),
    "c10_sender_lookup": O.with_v1(_lookup("CUST1[0-9]{2}@")),
    "j7_sender": O.with_v2(_lookup("user1[0-9]@")),
    "i1_compare_metrics": I1,
    "i2_health_score": I2,
    "i3_success_bands": I3,
    "c5_percentage": C5,
    "c2_process_messages": f"SELECT {O.MSG_COLS} FROM ({O.v4_extract(O.MAILBOX_WHERE)})",
    "c1_get_header": f'SELECT id, "from", subject, date FROM ({V4_ALL})',
    "c3_age_days": f"SELECT id, date, age_days FROM ({V4_ALL})",
    "c4_label_flags": f"SELECT id, unread, starred, important, social, updates, promotions FROM ({V4_ALL})",
    "c11_drop_undated": f'SELECT id, "from", age_days FROM ({V4_ALL}) WHERE age_days IS NOT NULL',
    "a3_unwrap_response": f"SELECT {FLAT} FROM ({V4_ALL})",
    "a1_load_cache": f"SELECT {FLAT} FROM ({V4_ALL})",
    "a2_save_cache": f"SELECT {FLAT} FROM ({V4_ALL})",
    "a4_load_audit_data": O.with_v1(f"SELECT {SC} FROM s"),
    "a5_save_report": O.with_v1(f"SELECT {SC} FROM s"),
    "a6_bounded_listing": A6,
    "b1_stale_entries": f"SELECT id, {O.stale_sql('fetched_at')} AS stale FROM ({V4_ALL})",
    "b2_fetch_plan": REFRESH + "\nSELECT id, reason FROM plan",
    "b3_upsert_fetched": REFRESH + "\nSELECT id, fetched_at FROM cache2",
    "b4_prune_cache": REFRESH + "\nSELECT id FROM cache2 WHERE id NOT IN (SELECT id FROM lst)",
    "d1d2d3_bucketed_cache": D_BUCKETED,
    "e14_running_shares": O.with_v1(RUNNING),
    "e14b_smallest_holders": O.with_v1(f"""SELECT "from", total_volume, place FROM ({RUNNING}) r,
  (SELECT sum(total_volume) AS a FROM s) WHERE running > 0 AND running - total_volume < 0.8 * a"""),
    "e15_tier_category_month": CUBE,
    "j1_audit": J1,
    "j1b_audit_mailbox_source": J1,
    "b3b_change_feed": FEED,
    "a6b_mailbox_source": A6,
    "a6c_mailbox_time_bounds": f"""SELECT id, ts, labels FROM ({LISTED})
WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01'""",
    "a6d_mailbox_stream": f"SELECT id, ts FROM ({LISTED})",
    "d1_listing_cache_inner": D1,
    "d2_listing_cache_left": D2,
    "d3_cache_listing_semi_anti": D3,
    "d4_top_senders_snippets": D4,
    "d5_first_subject": D5,
    "c6_preprocess_text": C6,
    "c7_extract_keywords": C7,
    "c8_filter_common_words": C8,
    "c9_subject_classes": C9,
    "c9_subject_classes_events": C9E,
    "e7_sender_subjects": O.with_v3('SELECT "from", id, coalesce(subject, \'\') AS subject, ord FROM m'),
    "e7b_cache_subjects": f'SELECT "from", id, \'\' AS subject FROM ({V4_ALL})',
    "e8_sender_snippets": O.with_v2('SELECT "from", id, snippet FROM m WHERE length(snippet) > 0'),
    "e9_top_senders_by_volume": O.with_v2('SELECT "from", CAST(count(*) AS BIGINT) AS email_count FROM m '
                                          'GROUP BY "from" ORDER BY email_count DESC, "from" LIMIT 10'),
    "e10_keyword_frequency": E10,
    "f7_top_keywords": F7,
    "e13_snippet_counts": O.with_v2('SELECT "from", CAST(count(*) AS BIGINT) AS email_count FROM m '
                                    'WHERE length(snippet) > 0 GROUP BY "from"'),
    "f12_pattern_senders_by_volume": O.with_v2(
        'SELECT "from", total_volume, round(ignorance_score, 6) AS ignorance_score, '
        'CAST(row_number() OVER (ORDER BY total_volume DESC, "from") AS INTEGER) AS rank '
        'FROM (SELECT * FROM s ORDER BY s.total_volume DESC, s."from" LIMIT 5)'),
    "f12b_pattern_senders_by_ignorance": O.with_v2(
        'SELECT "from", total_volume, round(ignorance_score, 6) AS ignorance_score, '
        'CAST(row_number() OVER (ORDER BY ignorance_score DESC, "from") AS INTEGER) AS rank '
        'FROM (SELECT * FROM s ORDER BY s.ignorance_score DESC, s."from" LIMIT 5)'),
    "h1_extract_entities": H1,
    "e11_entity_frequency": E11,
    "f8_top_entities": F8,
    "h2_infer_intent": H2,
    "h2_intent_scores": H2S,
    "f9_top_intents": F9,
    "h4_title_patterns": _patterns("total_volume", True, False),
    "h3_patterns_without_nlp": _patterns("total_volume", False, False),
    "j5_analyze_patterns": _patterns("ignorance_score", True, True),
    "i4_intent_actions": I4,
    "g1_feature_table": G1,
    "g2_standardize": G2,
    "j2_report": J2,
    "j2_brief_report": J2_BRIEF,
    "j3_cleanup_report": _j3(),
    "j4_engagement": J4,
}

__all__ = ["ORACLES", "ORDERS_AS_OF"]
