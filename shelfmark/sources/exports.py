"""Folders of mixed exports, and the unified record table on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators.records import dedup_first, union_exports
from shelfmark.sources.bibtex import read_bibtex_exports
from shelfmark.sources.csv_exports import UNIFIED_SCHEMA, empty_unified, read_csv_exports

#: "First" among records: file by file in name order, row by row within a file.
ORDER = ("archivo", "ingest_ord")


def _or_empty(spark: SparkSession, read, paths) -> DataFrame:
    try:
        return read(spark, paths)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            return empty_unified(spark)
        raise


def read_exports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every ``.csv`` and ``.bib`` export under ``paths`` as unified records; other files are
    not read."""
    return union_exports(
        _or_empty(spark, read_csv_exports, paths), _or_empty(spark, read_bibtex_exports, paths)
    )


def unify(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The exports under ``paths`` with one row per title, the first one."""
    return dedup_first(read_exports(spark, paths), ["title"], ORDER)


def write_unified(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the unified table; CSV is for exchange and has no byte order mark (deviation)."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError("fmt is 'parquet' or 'csv'")


def read_unified(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the unified table with its fixed schema, so ``published`` stays a string."""
    reader = spark.read.schema(UNIFIED_SCHEMA)
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def skipped_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files under ``paths`` that are neither ``.csv`` nor ``.bib``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path").where(~F.lower("path").rlike(r"\.(csv|bib)$"))
