"""Record tables: column choice, normalisation, concatenation, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import NULL_TEXTS, clean, doi_url, summary_or_placeholder
from shelfmark.operators.keys import content_key, lookup_join

# ---- fixed values -------------------------------------------------------------------
# Header names tried in order for each field. The last entries (deviation) are the headers
# that real exports carry for authors and dates.
SUMMARY_COLUMNS = ("AB", "Abstract", "Resumen", "abstract", "resumen", "AB ")
TITLE_COLUMNS = ("TI", "Title", "Título", "title", "TI ")
AUTHOR_COLUMNS = ("AU", "Author", "Autores", "author", "AU ", "contributors")
YEAR_COLUMNS = ("PY", "Year", "Año", "year", "PY ", "publicationDate", "coverDate")
DOI_COLUMNS = ("DOI", "doi", "Do")
UNIFIED_COLUMNS = ("title", "authors", "summary", "published", "url", "archivo")
# -------------------------------------------------------------------------------------

FIELD_CANDIDATES = {
    "title": TITLE_COLUMNS,
    "authors": AUTHOR_COLUMNS,
    "summary": SUMMARY_COLUMNS,
    "published": YEAR_COLUMNS,
    "url": DOI_COLUMNS,
}


def first_present(names: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate among ``names``; exact and case-sensitive."""
    return next((c for c in candidates if c in names), None)


def pick_column(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first candidate column that ``df`` has, else the empty string."""
    name = first_present(df.columns, candidates)
    return df[f"`{name}`"] if name is not None else F.lit("")


def present_or_null(col: Column) -> Column:
    """Null for the cell texts that count as missing in a CSV export."""
    return F.when(~col.isin(*NULL_TEXTS), col)


def unified_fields(pick, candidates: dict[str, Sequence[str]] | None = None) -> list[Column]:
    """title, authors, summary, published, url out of raw cells; ``pick(candidates)`` gives a cell."""
    field = {
        name: clean(present_or_null(pick(cands))) for name, cands in (candidates or FIELD_CANDIDATES).items()
    }
    return [
        field["title"].alias("title"),
        field["authors"].alias("authors"),
        summary_or_placeholder(field["summary"]).alias("summary"),
        field["published"].alias("published"),
        doi_url(field["url"]).alias("url"),
    ]


def normalize_csv(
    df: DataFrame, candidates: dict[str, Sequence[str]] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Raw export rows as title, authors, summary, published, url (and the ``keep`` columns).

    Titles of five characters or fewer are dropped; abstracts of twenty or fewer get the
    fixed text. Both are projections and filters of one scan.
    """
    fields = unified_fields(lambda cands: pick_column(df, cands), candidates)
    return df.select(*fields, *[F.col(c) for c in keep]).where(F.length("title") > 5)


def union_exports(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row, by ``order``, of every combination of ``keys``.

    Nulls equal each other; case and spaces count. The minimum is combined before the
    shuffle, so a key held by a third of all rows sends one row per input task, where a
    window would sort them all in one.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    first = F.min_by(whole, F.struct(*[F.col(c) for c in order]))
    return df.groupBy(content_key(*keys).alias("_key")).agg(first.alias("_row")).select("_row.*")


def dedup_stats(df: DataFrame, keys: Sequence[str], summary: str = "summary") -> DataFrame:
    """Total, unique and repeated rows, and abstracts longer than twenty characters among the
    kept rows. The fixed text for short abstracts does not count as an abstract (deviation).
    """
    order = [c for c in ("archivo", "ingest_ord", "doc_id") if c in df.columns]
    return stats_by_key(df, keys, order, summary)


def stats_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], summary: str) -> DataFrame:
    """As :func:`dedup_stats` with the row order given."""
    from shelfmark.functions.text import SHORT_SUMMARY

    text = F.col(summary)
    is_abstract = F.coalesce((F.length(text) > 20) & (text != SHORT_SUMMARY), F.lit(False))
    per_key = df.groupBy(content_key(*keys).alias("_key")).agg(
        F.count("*").alias("n"),
        F.min(F.struct(*order, is_abstract.alias("abstract"))).alias("first"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("*").alias("unique_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
        F.count(F.when(F.col("first.abstract"), 1)).alias("abstracts"),
    )


def duplicates(df: DataFrame, keys: Sequence[str], order: str, kept: str = "kept_id") -> DataFrame:
    """The rows that :func:`dedup_first` drops, each with the ``order`` value of its kept row.

    ``order`` must be a unique column. Only keys that occur more than once are looked up,
    and large groups of copies by broadcast (see :func:`lookup_join`).
    """
    keyed = df.withColumn("_key", content_key(*keys))
    repeated = (
        keyed.groupBy("_key")
        .agg(F.min(order).alias(kept), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
    )
    found = lookup_join(keyed, repeated, "_key", [kept], "_n", F.xxhash64(order))
    return found.where(F.col(order) != F.col(kept)).drop("_key")


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ("ingest_ord",)) -> DataFrame:
    """The first ``n`` rows."""
    return df.orderBy(*order).limit(n)
