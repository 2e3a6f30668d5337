"""Publications per year and source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import clean, extract_year

# ---- fixed values -------------------------------------------------------------------
DEFAULT_YEAR = 2024
DEFAULT_SOURCE = "Fuente Externa"
# -------------------------------------------------------------------------------------


def with_year(df: DataFrame, col: str = "published", name: str = "year_plot") -> DataFrame:
    """Add the year of a free-text date; a table without that column gets the fixed year."""
    if col not in df.columns:
        return df.withColumn(name, F.lit(DEFAULT_YEAR))
    return df.withColumn(name, extract_year(clean(col)))


def valid_years(df: DataFrame, col: str = "year_plot") -> DataFrame:
    """Rows with a year after 1900."""
    return df.where(F.col(col) > 1900)


def source_column(df: DataFrame, candidates: Sequence[str] = ("journal", "source")) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def timeline_long(df: DataFrame, year: str = "year_plot", source: str | None = None) -> DataFrame:
    """(year, source, n) for the pairs that occur."""
    source = source or source_column(df)
    label = F.col(source) if source else F.lit(DEFAULT_SOURCE)
    return (
        valid_years(df, year)
        .where(label.isNotNull())
        .groupBy(F.col(year).alias("year"), label.alias("source"))
        .agg(F.count("*").alias("n"))
    )


def timeline(
    df: DataFrame, year: str = "year_plot", source: str | None = None, sources: Sequence[str] | None = None
) -> DataFrame:
    """One row per year, one column per source, 0 where a pair does not occur.

    Give ``sources`` to save the query that finds them. The pivot works on the counts of
    :func:`timeline_long`, at most years x sources rows, so the corpus is shuffled once and
    only as partial counts.
    """
    counts = timeline_long(df, year, source)
    pivoted = counts.groupBy("year").pivot("source", list(sources) if sources else None)
    return pivoted.agg(F.sum("n")).na.fill(0).orderBy("year")
