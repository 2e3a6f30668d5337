"""Incremental ingest of export files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.records import dedup_first
from shelfmark.sources.csv_exports import UNIFIED_SCHEMA
from shelfmark.session import cut
from shelfmark.sources.exports import ORDER, read_exports
from shelfmark.streaming.seen_titles import SeenTitles, title_key

STORED_SCHEMA = UNIFIED_SCHEMA.simpleString()[len("struct<"):-1] + ",batch_id:bigint"


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """What :func:`ingest_stream` has stored so far (all batches)."""
    return spark.read.schema(STORED_SCHEMA.replace(":", " ")).parquet(out)


def _index(spark: SparkSession, out: str, batch_id: int) -> SeenTitles:
    """The index below ``out``, complete up to ``batch_id``; made once for tables stored without one."""
    index = SeenTitles(spark, f"{out}/_seen")
    if batch_id > 0 and not index.segments():
        try:
            # a batch that runs again must not see its own first try
            stored = read_ingested(spark, out).where(F.col("batch_id") < batch_id).select(*title_key("title"))
            index.write(stored, (0, batch_id - 1))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    index.merge(batch_id)
    return index


def ingest_batch(spark: SparkSession, files: list[str], out: str, batch_id: int) -> None:
    """Normalise ``files`` and append the titles that are new, as partition ``batch_id``.

    Of the titles stored before, only the buckets that may hold one of this batch are read.
    """
    index = _index(spark, out, batch_id)
    fresh = cut(dedup_first(read_exports(spark, files), ["title"], ORDER).withColumns(dict(zip(("hi", "lo"), title_key("title")))))
    seen, _ = index.seen(fresh.select("hi", "lo"), batch_id)
    fresh = fresh.join(seen, ["hi", "lo"], "left_anti")
    fresh.drop("hi", "lo").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    stored = read_ingested(spark, out).where(F.col("batch_id") == batch_id)
    index.write(stored.select(*title_key("title")), (0, batch_id))


def ingest_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, max_files: int = 1000, **trigger
) -> StreamingQuery:
    """Follow ``folder`` and store each record whose title has not been seen.

    The stream only tells which files are new (at most ``max_files`` names per batch reach
    the driver); each batch reads them with the batch reader. Seen titles live in an index next to
    the output, so there is no growing operator state, and a batch that is run again overwrites
    its own partition and segment.
    """
    names = (
        spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{csv,bib,CSV,BIB}")
        .option("maxFilesPerTrigger", max_files)
        .format("binaryFile")
        .load(folder)
        .select("path")  # the content column is pruned, so no file is read here
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        files = sorted({row["path"] for row in batch.distinct().collect()})
        if files:
            ingest_batch(batch.sparkSession, files, out, batch_id)

    return (
        names.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
