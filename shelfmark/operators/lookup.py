"""Projection, search and lookups on the record table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import has_any_word
from shelfmark.functions.vocab import EDUCATION_WORDS
from shelfmark.operators.records import dedup_first

# ---- fixed values -------------------------------------------------------------------
VISIBLE_COLUMNS = ("title", "authors", "published", "url", "country")
CATEGORY_LABELS = ("Educación", "Otros Temas (IA General)")
# -------------------------------------------------------------------------------------


def select_visible(df: DataFrame, visible: Sequence[str] = VISIBLE_COLUMNS) -> DataFrame:
    """The visible columns that the table has."""
    return df.select(*[c for c in visible if c in df.columns])


def lookup_first(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """The first row, by ``order``, whose ``key`` equals ``value``."""
    return df.where(F.col(key) == value).orderBy(*order).limit(1)


def lookup_many(df: DataFrame, wanted: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row for every key of ``wanted``; the choice of join is left to Spark."""
    hits = df.join(wanted.select(key).distinct(), key, "left_semi")
    return dedup_first(hits, [key], order)


def search(df: DataFrame, query: str, cols: Sequence[str] = ("summary", "title"), regex: bool = True) -> DataFrame:
    """Rows with ``query`` in one of ``cols``, whatever the case; an empty query gives all rows.

    ``query`` is a regular expression unless ``regex`` is false. Nulls never match (deviation).
    """
    if not query:
        return df
    if regex:
        hits = [F.col(c).rlike(f"(?iuU){query}") for c in cols]
    else:
        hits = [F.lower(c).contains(query.lower()) for c in cols]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def search_count(df: DataFrame, query: str, cols: Sequence[str] = ("summary", "title"), regex: bool = True) -> DataFrame:
    """Number of hits of :func:`search`."""
    return search(df, query, cols, regex).agg(F.count("*").alias("hits"))


def flag_category(
    df: DataFrame, col: str = "summary", words: Sequence[str] = EDUCATION_WORDS, name: str = "is_education"
) -> DataFrame:
    """Add a flag: does the text contain one of ``words``?"""
    lowered = df.select("*", F.lower(col).alias("_low"))
    return lowered.select(*[c for c in df.columns if c != name], has_any_word("_low", words).alias(name))


def flagged(df: DataFrame, flag: str = "is_education", cols: Sequence[str] = ("title", "authors")) -> DataFrame:
    """The chosen columns of the flagged rows."""
    return df.where(F.col(flag)).select(*cols)


def category_share(df: DataFrame, flag: str = "is_education", labels: Sequence[str] = CATEGORY_LABELS) -> DataFrame:
    """Rows per flag value and their share of all rows in percent, one decimal."""
    counts = df.agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col(flag), 1)).alias("yes"),
        F.count(F.when(~F.col(flag), 1)).alias("no"),
    )
    rows = F.array(
        F.struct(F.lit(labels[0]).alias("category"), F.col("yes").alias("n")),
        F.struct(F.lit(labels[1]).alias("category"), F.col("no").alias("n")),
    )
    return (
        counts.select("total", F.inline(rows))
        .where(F.col("n") > 0)
        .select("category", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("share_pct"))
    )


def cluster_members(
    assign: DataFrame, docs: DataFrame, label: int, id_col: str = "id", label_col: str = "label"
) -> DataFrame:
    """The documents of one cluster."""
    return docs.join(assign.where(F.col(label_col) == label).select(id_col), id_col, "left_semi")
