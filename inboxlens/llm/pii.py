"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is done within the row with built-in functions. A pattern cuts the text into gaps and matches; offsets are
sums of their lengths. The patterns start only where a match can start, which keeps them linear on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order: those of the contract, then the one that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Length of an IBAN after its first four characters, and the countries that have it (the public registry).
_IBAN = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK",
    17: "CH HR LI LV", 18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR", 23: "BI DJ FR GR IT MC MR SM",
    24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE", 27: "MT SC", 28: "LC", 29: "RU"}
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # By country: a match ends where the number ends. Other country codes may have any length.
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(
        rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for n, codes in _IBAN.items()) + (
        rf"|(?!{'|'.join(_IBAN.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
        r")(?![A-Za-z0-9])"),
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}
#: Score of a confirmed span, and what a context word within NEAR characters adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.85}
CONTEXT = {"email": "e-?mail|contact|write", "ip": r"\bip\b|address|server|host", "card": "card|visa|master|credit|payment",
           "phone": "phone|call|mobile|tel|fax", "iban": "iban|bank|account|transfer"}
NEAR, BONUS = 40, 0.1
_BLOCK = 64


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(value, ""))
    terms = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(value: Column) -> Column:
    moved = F.split(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4)), "")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(F.regexp_replace(match, r"\x20", ""))
    return F.lit(True)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def spans(docs: DataFrame, text_col: str = "text", column: str = "pii") -> DataFrame:
    """``docs`` with one more column: an array of (kind, start, end, value, score), by kind in order, then start.

    Offsets are code points, the end is exclusive. Matches of a kind are the leftmost ones that don't overlap; what
    fails its check is dropped. Null texts count as empty and give an empty array, like texts without personal data;
    every row stays, repeated ones too. A column that is called like the new one is replaced. Whole texts are
    searched; work is in proportion to the text, but for a small part that grows with the square of the matches / 64.
    """
    docs = docs.drop(column)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    # Each step refers to the arrays of the step before at least twice: the optimizer then leaves the steps apart.
    out = out.select("row", *[F.when(F.col("t").rlike(_NEEDS[k]), F.struct(
        F.split("t", PATTERNS[k], -1).alias("gaps"),
        F.regexp_extract_all("t", F.lit(PATTERNS[k]), F.lit(0)).alias("hits"))).alias(k) for k in KINDS])
    gaps, hits = (lambda k: F.col(f"{k}.gaps")), (lambda k: F.col(f"{k}.hits"))
    out = out.select("*", *[F.when(F.size(hits(k)) > 0, F.zip_with(
        gaps(k), hits(k), lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long"))).alias(f"{k}_len")
        for k in KINDS])
    blocks = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(f"{k}_len") / _BLOCK).cast("int")), lambda b: _sum(  # noqa: E731,E501
        F.slice(f"{k}_len", b * _BLOCK + 1, F.lit(_BLOCK))))
    out = out.select("*", *[F.when(F.size(f"{k}_len") > 0, blocks(k)).alias(f"{k}_sum") for k in KINDS])
    upto = lambda k: F.transform(f"{k}_sum", lambda _, b: _sum(F.slice(f"{k}_sum", F.lit(1), b)))
    out = out.select("*", *[F.when(F.size(f"{k}_sum") > 0, upto(k)).alias(f"{k}_at") for k in KINDS])

    def found(k: str) -> Column:
        def one(hit: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = F.element_at(f"{k}_at", block + 1) + _sum(F.slice(f"{k}_len", block * _BLOCK + 1, i % _BLOCK))
            gap = F.element_at(gaps(k), i + 1)
            near = F.concat_ws(" ", F.substring(gap, -NEAR, NEAR), F.substring(F.element_at(gaps(k), i + 2), 1, NEAR))
            score = F.lit(SCORES[k]) + F.when(F.lower(near).rlike(CONTEXT[k]), BONUS).otherwise(0.0)
            start = start + F.length(gap)
            return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"),
                            hit.alias("value"), F.round(score, 3).alias("score"))
        all_hits = F.filter(F.transform(hits(k), one), lambda s: _valid(k, s["value"]))
        return F.when((F.size(f"{k}_at") > 0) & (F.size(f"{k}_len") > 0), all_hits)

    kind = "array<struct<kind: string, start: bigint, end: bigint, value: string, score: double>>"
    parts = [F.coalesce(found(k).cast(kind), F.array().cast(kind)) for k in KINDS]
    return out.select("row", F.concat(*parts).alias(column)).select("row.*", column)


def digest(found: DataFrame, id_col: str = "doc_id", column: str = "pii") -> DataFrame:
    """Counts by kind, and the spans as text: ``kind:start:end``, comma-joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(column, lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(column, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col(f"`{id_col}`").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(column, text), ",").alias("spans"))
