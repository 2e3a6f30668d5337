"""Country tags and their counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import as_col
from shelfmark.functions.vocab import COUNTRIES


def country_of(col: str | Column, countries: Mapping[str, Sequence[str]] = COUNTRIES, mode: str = "substring") -> Column:
    """First country, in dictionary order, with a variant in the lower-cased text; else null.

    ``mode="substring"`` takes any occurrence ("mit" also within "limited", kept on
    purpose); ``mode="word"`` asks for a word boundary at both ends. One CASE per row that
    stops at the first hit: no join and no shuffle. Byte searches one after the other beat a
    single alternation here (3.0 against 3.6 seconds over 24 MB on two cores).
    """
    return _country_in(F.lower(as_col(col)), countries, mode)


def _country_in(text: Column, countries: Mapping[str, Sequence[str]], mode: str) -> Column:
    if mode not in ("substring", "word"):
        raise ValueError("mode is 'substring' or 'word'")
    tag = None
    for country, variants in countries.items():
        if mode == "substring":
            hit = reduce(lambda a, b: a | b, [text.contains(v) for v in variants])
        else:
            hit = text.rlike(r"(?U)\b(?:%s)\b" % "|".join(re.escape(v) for v in variants))
        tag = F.when(hit, F.lit(country)) if tag is None else tag.when(hit, F.lit(country))
    return tag if tag is not None else F.lit(None).cast("string")


def tag_country(
    df: DataFrame,
    cols: Sequence[str] = ("authors", "summary"),
    countries: Mapping[str, Sequence[str]] = COUNTRIES,
    mode: str = "substring",
    name: str = "country",
) -> DataFrame:
    """Add the country found in the first of ``cols`` that has one.

    The lower-cased texts are columns of their own first: inside the CASE they would be
    computed again for every variant.
    """
    lowered = df.select("*", *[F.lower(c).alias(f"_low_{c}") for c in cols])
    tags = [_country_in(F.col(f"_low_{c}"), countries, mode) for c in cols]
    return lowered.select(*[c for c in df.columns if c != name], F.coalesce(*tags).alias(name))


def country_counts(df: DataFrame, k: int | None = None, col: str = "country") -> DataFrame:
    """(country, n), largest first; untagged rows are left out."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), col)
    return ordered if k is None else ordered.limit(k)


def headline(df: DataFrame, col: str = "country", approximate: bool = False) -> DataFrame:
    """Number of records and of different countries."""
    distinct = F.approx_count_distinct(col) if approximate else F.count_distinct(col)
    return df.agg(F.count("*").alias("records"), distinct.alias("countries"))
