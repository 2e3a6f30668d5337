"""BibTeX citation exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmark.functions.text import doi_url
from shelfmark.operators.keys import lookup_join

# ---- fixed values -------------------------------------------------------------------
NO_AUTHOR = "Sin autor"
NO_SUMMARY = "Sin resumen"
NO_YEAR = "2024"
# -------------------------------------------------------------------------------------

FILES = "*.[bB][iI][bB]"
#: A piece that begins an entry or a block without fields; the first piece of a file keeps its @.
START = r"^\s*@?\w+\s*[{(]"
#: Blocks that are no records.
NO_RECORD = r"(?i)^\s*@?(comment|string|preamble)\s*[{(]"

#: An entry up to its opening brace or parenthesis.
HEAD = r"^\s*@?\w+\s*([{(])"
#: The signs that matter to the scanner, and the runs of text between them.
TOKEN = r"[{}()\",]|[^{}()\",]++"
_NAME = r"^\s*([\w-]+)\s*="
_VALUE = r"(?s)^[^=]*=\s*(.*?)\s*$"


def _pieces(spark: SparkSession, paths: str | Sequence[str], pattern: str) -> DataFrame:
    """Files cut at every line that starts with @; large files are split, not read whole."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("lineSep", "\n@")
        .text(paths)
        .select(
            F.col("value").alias("piece"),
            F.col("_metadata.file_path").alias("archivo"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _placed_pieces(spark: SparkSession, paths: str | Sequence[str], pattern: str) -> DataFrame:
    """Pieces with the entry they belong to (of_block, of_k), null before the first of a file.

    A piece that starts no entry, such as a line of an abstract that begins with @, belongs to
    the entry before it. Entries are numbered inside each split of a file, whose size is
    bounded; a split that begins inside an entry looks up the split before that has one.
    """
    in_block = Window.partitionBy("archivo", "block").orderBy("row")
    numbered = _pieces(spark, paths, pattern).withColumn(
        "k", F.sum(F.when(F.col("piece").rlike(START), 1).otherwise(0)).over(in_block)
    )
    blocks = numbered.groupBy("archivo", "block").agg(F.max("k").alias("last"))
    before = Window.partitionBy("archivo").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("last") > 0, F.struct("block", "last"))
    owners = blocks.select(
        F.col("archivo").alias("_file"), F.col("block").alias("_block"), F.last(own, ignorenulls=True).over(before).alias("owner")
    )
    return numbered.join(
        owners, (F.col("k") == 0) & (F.col("archivo") == F.col("_file")) & (F.col("block") == F.col("_block")), "left"
    ).select(
        "archivo", "block", "row", "piece",
        F.when(F.col("k") > 0, F.col("block")).otherwise(F.col("owner.block")).alias("of_block"),
        F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("owner.last")).alias("of_k"),
    )


def _joined(placed: DataFrame) -> DataFrame:
    """(entry, archivo, ingest_ord): the pieces of every entry put together again."""
    entries = placed.where(F.col("of_k").isNotNull()).groupBy("archivo", "of_block", "of_k").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "piece"))).alias("parts")
    )
    return entries.select(
        F.array_join("parts.piece", "\n@").alias("entry"), "archivo", F.col("parts")[0]["row"].alias("ingest_ord")
    )


def scanned(entries: DataFrame) -> DataFrame:
    """``entries`` with ``fields`` (texts ``name = value`` in their order), ``closed`` and ``behind``.

    One walk over the braces, quotes and commas of the body counts the depth: a comma outside
    all braces and quotes ends a field, the closing sign of the entry ends the entry. So values
    may nest to any depth. ``closed`` tells whether the entry ends; ``behind`` is the text after.
    """
    close = F.when(F.regexp_extract("entry", HEAD, 1) == "(", F.lit(")")).otherwise(F.lit("}"))
    body = F.regexp_extract_all(F.regexp_replace("entry", HEAD, ""), F.lit(TOKEN), F.lit(0))
    walked = entries.select("*", close.alias("_close"), body.alias("_tokens"))
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("closed"), F.lit(0).alias("at"),
        F.array().cast("array<int>").alias("cuts"),
    )

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        top = (s["depth"] == 0) & ~s["quoted"]
        ends = top & (x == F.col("_close"))
        depth = F.when(x == "{", s["depth"] + 1).when((x == "}") & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"])
        quoted = F.when((x == '"') & (s["depth"] == 0), ~s["quoted"]).otherwise(s["quoted"])
        cuts = F.when(top & ((x == ",") | ends), F.concat(s["cuts"], F.array(at))).otherwise(s["cuts"])
        moved = F.struct(
            depth.alias("depth"), quoted.alias("quoted"), ends.alias("closed"), at.alias("at"), cuts.alias("cuts")
        )
        return F.when(s["closed"], s).otherwise(moved)

    walked = walked.select(*entries.columns, "_tokens", F.aggregate("_tokens", start, step).alias("_end"))
    ends = F.when(F.col("_end.closed"), F.col("_end.cuts")).otherwise(F.concat("_end.cuts", F.array(F.size("_tokens") + 1)))
    begins = F.concat(F.array(F.lit(0)), ends)
    part = lambda b, e: F.array_join(F.slice("_tokens", b + 1, e - b - 1), "")
    parts = F.zip_with(F.slice(begins, F.lit(1), F.size(ends)), ends, part)
    behind = F.array_join(F.slice("_tokens", F.col("_end.at") + 1, F.size("_tokens")), "")
    return walked.select(
        *entries.columns,
        F.filter(parts, lambda f: f.rlike(_NAME)).alias("fields"),
        F.col("_end.closed").alias("closed"),
        F.when(F.col("_end.closed"), behind).otherwise(F.lit("")).alias("behind"),
    )


def read_entries(spark: SparkSession, paths: str | Sequence[str], pattern: str = FILES) -> DataFrame:
    """One row per record entry: (entry, archivo, ingest_ord, fields, closed, behind).

    Blocks that are no records are left out; see :func:`rejected_entries` for what is lost.
    """
    return scanned(_joined(_placed_pieces(spark, paths, pattern)).where(~F.col("entry").rlike(NO_RECORD)))


def rejected_entries(spark: SparkSession, paths: str | Sequence[str], pattern: str = FILES) -> DataFrame:
    """(piece, reason, archivo, ingest_ord): the text that reaches no record.

    ``no end``: an entry whose braces do not close; what was read of it is still a record.
    ``no fields``: an entry without any ``name = value``, which gives an empty record.
    ``no record``: a comment, string or preamble block.
    ``outside``: text before the first entry of a file or behind the end of one.
    Blank text is no piece. An entry can give two rows, one of them for the text behind it.
    """
    placed = _placed_pieces(spark, paths, pattern)
    blocks = scanned(_joined(placed))
    no_record = F.col("entry").rlike(NO_RECORD)
    reason = (
        F.when(no_record, "no record").when(~F.col("closed"), "no end").when(F.size("fields") == 0, "no fields")
    )
    faults = F.filter(
        F.array(
            F.struct(F.col("entry").alias("piece"), reason.alias("reason")),
            F.struct(F.col("behind").alias("piece"), F.lit("outside").alias("reason")),
        ),
        lambda x: x["reason"].isNotNull() & x["piece"].rlike(r"\S"),
    )
    first = placed.where(F.col("of_k").isNull() & F.col("piece").rlike(r"\S")).select(
        "piece", F.lit("outside").alias("reason"), "archivo", F.col("row").alias("ingest_ord")
    )
    return blocks.select(F.inline(faults), "archivo", "ingest_ord").unionByName(first)


def field_value(fields: Column, name: str, drop_braces: bool = True) -> Column:
    """The value of one field out of ``fields``; null when the entry lacks it.

    One pair of braces or quotes around the value goes; ``drop_braces`` takes all inner braces.
    """
    named = F.filter(fields, lambda f: F.lower(F.regexp_extract(f, _NAME, 1)) == name)
    raw = F.regexp_extract(F.get(named, F.lit(0)), _VALUE, 1)
    wrapped = raw.rlike(r'(?s)^(\{.*\}|".*")$')
    value = F.when(wrapped, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.regexp_replace(value, r"[{}]", "") if drop_braces else value


def read_bibtex_exports(
    spark: SparkSession, paths: str | Sequence[str], drop_braces: bool = True, pattern: str = FILES
) -> DataFrame:
    """All BibTeX exports under ``paths`` as unified records.

    A field that no entry of a file has gets its fixed text in that file; a field that only
    some entries lack is null there. A missing DOI gives an empty link (deviation).
    """
    entries = read_entries(spark, paths, pattern).select("fields", "archivo", "ingest_ord")
    get = lambda name: field_value(F.col("fields"), name, drop_braces)
    fields = entries.select(
        get("title").alias("title"),
        get("author").alias("authors"),
        get("abstract").alias("summary"),
        get("year").alias("published"),
        doi_url(get("doi")).alias("url"),
        "archivo",
        "ingest_ord",
    )
    in_file = fields.groupBy("archivo").agg(
        F.count("*").alias("entries"),
        *[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in ("authors", "summary", "published")],
    )
    has = ["has_authors", "has_summary", "has_published"]
    known = lookup_join(fields, in_file, "archivo", has, "entries", F.xxhash64("ingest_ord"))

    def filled(col: str, text: str) -> Column:
        return F.when(~F.col(f"has_{col}"), F.lit(text)).otherwise(F.col(col)).alias(col)

    return known.select(
        "title",
        filled("authors", NO_AUTHOR),
        filled("summary", NO_SUMMARY),
        filled("published", NO_YEAR),
        "url",
        "archivo",
        "ingest_ord",
    )
