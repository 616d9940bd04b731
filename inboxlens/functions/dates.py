"""Date parsing and whole-day ages.

``rfc2822_timestamp`` follows the standard-library reading of an RFC 2822
``Date`` header (the subset real mail uses): optional weekday, ``d Mon yyyy``
(or ``Mon d yyyy``), ``HH:MM[:SS]`` and a zone given as ``+hhmm`` or as a
North-American / universal name. A header without a usable zone (none,
``-0000``, unknown name) has no absolute time, so its age is null.
Ages are whole days floored toward minus infinity, not calendar-day
differences: an e-mail one hour in the future is ``-1`` day old.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month and weekday spellings, and named zones as +hhmm offsets.
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
               "january", "february", "march", "april", "may", "june", "july", "august",
               "september", "october", "november", "december"]
DAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
NAMED_ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
               "AST": -400, "ADT": -300, "EST": -500, "EDT": -400, "CST": -600, "CDT": -500,
               "MST": -700, "MDT": -600, "PST": -800, "PDT": -700}

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_of_column(as_of=None) -> Column:
    """``as_of`` as a TIMESTAMP column: None -> now, str/datetime -> literal.

    Text or a naive datetime without a zone means UTC, whatever the session zone.
    """
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, _dt.datetime):
        if as_of.tzinfo is None:
            as_of = as_of.replace(tzinfo=_dt.UTC)
        as_of = as_of.isoformat(sep=" ")
    text = str(as_of).strip()
    if not re.search(r"(Z|[+-]\d{2}:?\d{2}|\s[A-Za-z][A-Za-z_/]+)$", text):
        text += "Z"
    return F.lit(text).cast("timestamp")


def _int(s: Column) -> Column:
    """Python ``int(s)`` for plain signed decimal text, else null."""
    return F.when(s.rlike(r"^[+-]?[0-9]{1,9}$"), s.cast("long"))


# [Day,] (d[,] Mon | Mon d[,]) then either
#   year[,] time[,]   with time HH:MM[:SS] or HH.MM[.SS]
#   HH:MM[:SS][,] year[,]
# then (space zone [anything]) or a +zone/-zone glued to the last token at the end.
# groups: 1 day, 2 month | 3 month, 4 day, 5 year, 6-8 h:m:s, 9-11 h.m.s | 12-14 h:m:s, 15 year,
#         16 zone | 17 glued zone
_DATE_BODY = (r"(?:(\d{1,2}),?\s+([A-Za-z]+)|([A-Za-z]+)\s+(\d{1,2}),?)\s+"
              r"(?:(\d{1,4}),?\s+(?:(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?|(\d{1,2})\.(\d{1,2})(?:\.(\d{1,2}))?),?"
              r"|(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?,?\s+(\d{1,4}),?)"
              r"(?:\s+(\S+).*|([+-]\S*))?")
_SEP = "\u0001"
_CANON_RE = "^" + _DATE_BODY + "$"
_CANON_TO = _SEP.join(["$1$4", "$2$3", "$5$15", "$6$9$12", "$7$10$13", "$8$11$14", "$16$17"])
# a leading weekday, with or without comma (or junk up to a comma in the first word)
_LEAD_RE = r"^\s*(?:\S*,\s*|(?i:" + "|".join(DAY_NAMES) + r")(?:\s+|$))?"


def date_parts(date: Column | str) -> Column:
    """Date header -> ``[day, month, year, hour, minute, second, zone]`` text, one regex pass.

    A header that does not fit the grammar gives a one-element array.
    """
    s = F.regexp_replace(_c(date), _LEAD_RE, "")
    return F.split(F.regexp_replace(s, _CANON_RE, _CANON_TO), _SEP)


def zone_hhmm(zone_text: Column | str) -> Column:
    """Zone token -> signed ``hhmm`` number; null for no / unknown zone and for ``-0000``."""
    zone = F.upper(_c(zone_text))
    named = F.create_map(*[x for k, v in NAMED_ZONES.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    numeric = F.when(zone.rlike(r"^[+-]?[0-9]{1,9}$") & ~zone.rlike(r"^-0+$"), zone.cast("long"))
    return F.coalesce(F.try_element_at(named, zone), numeric)


def timestamp_from_parts(parts: Column | str, hhmm: Column | str | None = None) -> Column:
    """Absolute TIMESTAMP from :func:`date_parts`, null when no absolute time exists.

    The numeric parts are digit strings by construction of the regex, so they
    are cast directly; only the zone needs checking (:func:`zone_hhmm`).
    """
    p = _c(parts)
    hh = zone_hhmm(F.get(p, 6)) if hhmm is None else _c(hhmm)
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    m_at = F.array_position(months, F.lower(F.get(p, 1)))
    month = F.when(m_at > 12, m_at - 12).otherwise(m_at)
    y = F.get(p, 2).cast("int")
    year = F.when(y < 100, F.when(y > 68, y + 1900).otherwise(y + 2000)).otherwise(y)
    sec = F.coalesce(F.nullif(F.get(p, 5), F.lit("")).cast("int"), F.lit(0))
    # (hhmm div 100, hhmm % 100) keep the sign, so -0530 -> -5 h -30 min
    offset = (hh.cast("long") / 100).cast("long") * 3600 + (hh % 100) * 60
    ok = (F.size(p) == 7) & (m_at > 0) & (sec < 60) & (F.abs(offset) < 86400)
    local = F.try_make_timestamp(year, month.cast("int"), F.get(p, 0).cast("int"), F.get(p, 3).cast("int"),
                                 F.get(p, 4).cast("int"), sec.cast("decimal(16,6)"), F.lit("UTC"))
    return F.when(ok, F.timestamp_micros(F.unix_micros(local) - offset * 1_000_000))


def rfc2822_timestamp(date: Column | str) -> Column:
    """Absolute TIMESTAMP of a Date header, or null when it cannot be placed in time.

    Accepted: ``[Day,] d Mon yyyy HH:MM[:SS] zone`` and ``[Day,] Mon d yyyy ...``;
    the zone may follow the time without a space; anything after the zone is
    ignored (e.g. ``(UTC)``). Two-digit years map 00-68 to 20xx, 69-99 to 19xx.
    For whole tables prefer :func:`with_date_ts`, which evaluates the regex once.
    """
    return timestamp_from_parts(date_parts(date))


def with_date_ts(df: DataFrame, date_col: str = "date", ts_col: str = "ts") -> DataFrame:
    """Adds ``ts_col`` parsed from ``date_col`` (same result as :func:`rfc2822_timestamp`).

    Staged projections: the regex runs once, each numeric field is computed
    once, and the timestamp reads them as columns. Spark keeps these
    projections apart because their outputs are referenced several times, so
    the generated code stays small (no duplicated sub-expressions, well under
    the JVM method size limit) and nothing falls back to interpretation.
    """
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    p = F.col("_dp")
    staged = (df.withColumn("_dp", date_parts(date_col))
                .withColumn("_dn", F.size(p))
                .withColumn("_dm", F.array_position(months, F.lower(F.get(p, 1))).cast("int"))
                .withColumn("_dy", F.get(p, 2).cast("int"))
                .withColumn("_ds", F.coalesce(F.nullif(F.get(p, 5), F.lit("")).cast("int"), F.lit(0)))
                .withColumn("_dz", zone_hhmm(F.get(p, 6))))
    m, y, sec, hh = F.col("_dm"), F.col("_dy"), F.col("_ds"), F.col("_dz")
    staged = staged.select(
        "*",
        ((hh / 100).cast("long") * 3600 + (hh % 100) * 60).alias("_doff"),
        F.try_make_timestamp(F.when(y < 100, F.when(y > 68, y + 1900).otherwise(y + 2000)).otherwise(y),
                             F.when(m > 12, m - 12).otherwise(m), F.get(p, 0).cast("int"), F.get(p, 3).cast("int"),
                             F.get(p, 4).cast("int"), sec.cast("decimal(16,6)"), F.lit("UTC")).alias("_dl"))
    off = F.col("_doff")
    ok = (F.col("_dn") == 7) & (m > 0) & (sec < 60) & (F.abs(off) < 86400)
    return (staged.withColumn(ts_col, F.when(ok, F.timestamp_micros(F.unix_micros("_dl") - off * 1_000_000)))
                  .drop("_dp", "_dn", "_dm", "_dy", "_ds", "_dz", "_doff", "_dl"))


def age_days_from_ts(ts: Column | str, as_of=None) -> Column:
    """Whole days between ``ts`` and ``as_of``, floored (Python ``timedelta.days``)."""
    t = _c(ts).cast("timestamp")
    diff = F.unix_micros(as_of_column(as_of)) - F.unix_micros(t)
    return F.floor(diff / F.lit(float(MICROS_PER_DAY))).cast("long")


def age_days(date: Column | str, as_of=None) -> Column:
    """Age in whole days of a Date header; null when it does not parse."""
    return age_days_from_ts(rfc2822_timestamp(date), as_of)


def iso_timestamp(s: Column | str) -> Column:
    """ISO-8601 text to TIMESTAMP; zone-less text counts as UTC; anything else null."""
    c = _c(s)
    return F.when(c.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}"), c.try_cast("timestamp"))


def is_stale(fetched_at: Column | str, ttl_days: int, as_of=None) -> Column:
    """True when the fetch stamp is missing, unreadable, or at least ``ttl_days`` old."""
    age = age_days_from_ts(iso_timestamp(fetched_at), as_of)
    return F.coalesce(age >= F.lit(ttl_days), F.lit(True))
