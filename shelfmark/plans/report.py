"""The tables of the report: cloud terms, countries, timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfmark.operators.tagging import country_counts, tag_country
from shelfmark.operators.terms import cloud_weights
from shelfmark.operators.timeline import timeline, with_year


def report_tables(df: DataFrame, out: str | None = None, k_terms: int = 100, k_countries: int = 10) -> dict[str, DataFrame]:
    """Cloud terms, top countries and timeline; written under ``out`` when given.

    Each table reads only the columns it needs from the corpus. Without any country, or any
    valid year, its table is empty.
    """
    tagged = df if "country" in df.columns else tag_country(df)
    tables = {
        "cloud": cloud_weights(df, k=k_terms),
        "countries": country_counts(tagged, k_countries),
        "timeline": timeline(with_year(df)),
    }
    if out is None:
        return tables
    for name, result in tables.items():
        result.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: df.sparkSession.read.parquet(f"{out}/{name}") for name in tables}
