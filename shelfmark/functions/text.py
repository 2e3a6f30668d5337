"""Text expressions. Everything here is a built-in Spark column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# ---- fixed values -------------------------------------------------------------------
# Cell texts that a CSV reader of the pandas family takes as missing.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
DOI_PREFIX = "https://doi.org/"
SHORT_SUMMARY = "Sin resumen en exportación"
# White space as Python's str.strip and str.split see it.
SPACE = r"[\s\x1c-\x1f]"
# -------------------------------------------------------------------------------------


def as_col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean(col: str | Column) -> Column:
    """Null becomes the empty string; white space (also no-break spaces) is cut at both ends."""
    text = F.coalesce(as_col(col).cast("string"), F.lit(""))
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def doi_url(col: str | Column) -> Column:
    """DOI as link; empty or null gives the empty string.

    A value that already is a link stays as it is (deviation: no doubled prefix).
    """
    doi = F.coalesce(as_col(col), F.lit(""))
    return (
        F.when(doi == "", F.lit(""))
        .when(doi.startswith("http"), doi)
        .otherwise(F.concat(F.lit(DOI_PREFIX), doi))
    )


def summary_or_placeholder(col: str | Column, min_chars: int = 21) -> Column:
    """The abstract, or a fixed text when it has fewer than ``min_chars`` characters."""
    text = as_col(col)
    return F.when(F.length(text) >= min_chars, text).otherwise(F.lit(SHORT_SUMMARY))


def word_runs(col: str | Column, min_len: int) -> Column:
    """Array of runs of at least ``min_len`` letters, digits or ``_``, lower-cased; null gives [].

    The class is spelled out since Java's ``\\w`` is ASCII only.
    """
    text = F.lower(F.coalesce(as_col(col), F.lit("")))
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{%d,}" % min_len), F.lit(0))


def split_words(col: str | Column) -> Column:
    """Lower-cased words between white space, in order; null gives []."""
    text = F.lower(F.coalesce(as_col(col), F.lit("")))
    return F.filter(F.split(text, f"(?U){SPACE}+"), lambda w: w != "")


def char_ngrams(col: str | Column, n: int = 2) -> Column:
    """Set of character n-grams of the lower-cased text; text shorter than ``n`` gives [].

    The text is cut to characters once, without a pattern, so the cost is linear in its length.
    """
    text = F.lower(F.coalesce(as_col(col), F.lit("")))
    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    grams = chars
    for shift in range(1, n):
        rest = F.slice(chars, F.lit(1 + shift), F.size(chars))
        grams = F.zip_with(grams, rest, lambda a, b: F.concat(a, b))
    # zip_with pads the shorter side with null; those tails are no n-grams
    return F.array_compact(F.array_distinct(grams))


def pairs_in_order(words: Column, sep: str = " ") -> Column:
    """Neighbouring words joined by ``sep``."""
    nxt = F.slice(words, F.lit(2), F.size(words))
    both = F.zip_with(words, nxt, lambda a, b: F.concat(a, F.lit(sep), b))
    return F.filter(both, lambda p: p.isNotNull())


def has_any_word(lowered: str | Column, words: Sequence[str]) -> Column:
    """True when a lower-cased text contains one of ``words`` anywhere; null gives false.

    Matching is by substring, so "machine learning" counts for "learning" (kept on purpose).
    """
    text = as_col(lowered)
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return F.coalesce(hit, F.lit(False))


def extract_year(col: str | Column) -> Column:
    """First run of four digits as a year, else null.

    One rule per row replaces a column-wide format guess. For ``2026``, ``20260401``,
    ``2024-03-01``, ``2026.0``, ``Mar2026`` and ``3/5/2026`` it gives the date's year;
    ``nan`` and the empty text give null.
    """
    digits = F.regexp_extract(as_col(col).cast("string"), r"([0-9]{4})", 1)
    return F.when(digits != "", digits).cast("int")
