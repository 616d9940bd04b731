"""Text normalisation, keyword tokens and subject classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inboxlens.schemas import COMMON_WORDS, KEYWORD_STOP_WORDS, PROMOTIONAL_KEYWORDS, VALUABLE_KEYWORDS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# one Unicode-aware pass: runs of word characters are the words
# letters, numbers of all kinds and the underscore; combining marks separate words
_NON_WORD = r"[^\p{L}\p{N}_]+"


def words(text: Column | str) -> Column:
    """Words of the lower-cased text: maximal runs of Unicode word characters.

    Equal to splitting the cleaned text (punctuation to spaces, whitespace
    runs collapsed, trimmed) on spaces, in a single regex pass.
    """
    parts = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), _NON_WORD)
    return F.array_remove(parts, "")


def clean_text(text: Column | str) -> Column:
    """Lower-case, punctuation to spaces, whitespace runs to one space, trimmed.

    Letters and numbers of all scripts stay word characters.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), _NON_WORD, " "))


def keyword_tokens(text: Column | str) -> Column:
    """Keywords of a text: cleaned words longer than two letters, minus stop words."""
    stop = F.array(*[F.lit(w) for w in KEYWORD_STOP_WORDS])
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def is_keyword(word: Column | str) -> Column:
    """Row-level keyword test for exploded words (stays in generated code)."""
    w = _c(word)
    return (F.length(w) > 2) & ~w.isin(*KEYWORD_STOP_WORDS)


def common_words_filtered(words: Column | str) -> Column:
    """Words longer than three letters that are not common English words, lower-cased."""
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    kept = F.filter(_c(words), lambda w: (F.length(w) > 3) & ~F.array_contains(common, F.lower(w)))
    return F.transform(kept, lambda w: F.lower(w))


def _any_substring(lowered: Column, words: list[str]) -> Column:
    # one compiled alternation in generated code
    return lowered.rlike("|".join(rf"\Q{w}\E" for w in words))


def subject_class(subject: Column | str) -> Column:
    """'valuable', else 'promotional', else 'uncategorized' by keyword substrings."""
    low = F.lower(F.coalesce(_c(subject), F.lit("")))
    return (F.when(_any_substring(low, VALUABLE_KEYWORDS), F.lit("valuable"))
             .when(_any_substring(low, PROMOTIONAL_KEYWORDS), F.lit("promotional"))
             .otherwise(F.lit("uncategorized")))
