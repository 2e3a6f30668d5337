"""CSV citation exports.

The exports of one folder may differ in header and encoding. A first scan finds the header, the
encoding and the quoting state of every block; a second one cuts all files into records, large
files by many tasks, and parses each record under the header of its file.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.operators.records import UNIFIED_COLUMNS, first_present, normalize_csv, unified_fields, union_exports
from shelfmark.sources.csv_records import block_states, csv_blocks, csv_lines, csv_records

#: Kinds of files (header and encoding) parsed in one scan.
KINDS = 40

UNIFIED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in UNIFIED_COLUMNS] + [T.StructField("ingest_ord", T.LongType())]
)


def empty_unified(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], UNIFIED_SCHEMA)


def _header_names(header: str) -> list[str]:
    """Column names; a repeated one gets a number behind a dot, so the first keeps its name."""
    names, seen = [], set()
    for name in next(csv.reader([header.lstrip("﻿").rstrip("\r")]), []):
        own, k = name, 0
        while own.lower() in seen:
            k += 1
            own = f"{name}.{k}"
        seen.add(own.lower())
        names.append(own)
    return names


def read_csv_group(spark: SparkSession, paths: list[str], names: list[str], utf8: bool) -> DataFrame:
    """Read files that share one header, each by one task; every column is a string.

    Adds ``archivo`` (file) and ``ingest_ord`` (row order within the file).
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
        .csv(paths)
    )
    return raw.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)],
        F.col("_metadata.file_path").alias("archivo"),
        F.monotonically_increasing_id().alias("ingest_ord"),
    )


def _parsed(records: DataFrame, kinds: list[tuple], candidates) -> DataFrame:
    """Unified rows of the records of all files, each parsed under the header of its file's kind."""
    spark = records.sparkSession
    of_file = spark.createDataFrame(
        [(path, k) for k, (_, files) in enumerate(kinds) for path in files], "_path string, kind int"
    )
    rows = records.join(F.broadcast(of_file), F.col("path") == F.col("_path")).where(F.col("ord") > 0)

    def unified(names: list[str], utf8: bool, crlf: bool) -> Column:
        text = F.col("record").cast("string") if utf8 else F.decode("record", "ISO-8859-1")
        if crlf:
            text = F.regexp_replace(text, r"\r(?=\n|\z)", "")
        ddl = ", ".join(f"c{i} string" for i in range(len(names)))
        cells = F.from_csv(text, ddl, {"escape": '"', "maxCharsPerColumn": "-1"})

        def pick(cands: Sequence[str]) -> Column:
            name = first_present(names, cands)
            return F.lit("") if name is None else cells[f"c{names.index(name)}"]

        return F.struct(*unified_fields(pick, candidates))

    branches = [unified(*kind) for kind, _ in kinds]
    row = reduce(lambda out, k: out.when(F.col("kind") == k, branches[k]), range(1, len(kinds)), F.when(F.col("kind") == 0, branches[0]))
    return rows.select(row.alias("r"), F.col("path").alias("archivo"), F.col("ord").alias("ingest_ord")).select(
        "r.*", "archivo", "ingest_ord"
    ).where(F.length("title") > 5)


def read_csv_exports(spark: SparkSession, paths: str | Sequence[str], candidates=None) -> DataFrame:
    """All CSV exports under ``paths`` as unified records.

    Files that are not UTF-8 are read as Latin-1, which takes any byte. A file whose lines end with a
    lone carriage return is read by one task. ``ingest_ord`` grows along a file. The driver
    holds what it needs to plan any scan, the files and blocks, and one header per kind.
    """
    lines = csv_lines(spark, paths)
    blocks = csv_blocks(lines).toLocalIterator()
    files: dict[str, list] = defaultdict(list)
    for row in blocks:
        files[row["path"]].append(row)
    kinds: dict[tuple, list[str]] = defaultdict(list)
    old: dict[tuple, list[str]] = defaultdict(list)
    for path, rows in files.items():
        utf8 = all(r["utf8"] for r in rows)
        raw = next((bytes(r["header"]) for r in rows if r["header"] is not None), b"")
        header = raw.decode("utf-8" if utf8 else "latin-1").lstrip("\ufeff")
        crlf, header = header.endswith("\r"), header.removesuffix("\r")
        lone = "\r" in header
        names = _header_names(header.split("\r")[0])
        if names:
            (old if lone else kinds)[(tuple(names), utf8, crlf)].append(path)
    frames = []
    for (names, utf8, _), of_kind in sorted(old.items()):
        frames.append(normalize_csv(read_csv_group(spark, sorted(of_kind), list(names), utf8), candidates, keep=("archivo", "ingest_ord")))
    if kinds:
        records = csv_records(lines, block_states([r for p in sorted(files) for r in files[p]]))
        ordered = [((list(names), utf8, crlf), of_kind) for (names, utf8, crlf), of_kind in sorted(kinds.items())]
        frames += [_parsed(records, ordered[at : at + KINDS], candidates) for at in range(0, len(ordered), KINDS)]
    return union_exports(*frames) if frames else empty_unified(spark)
