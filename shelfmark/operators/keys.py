"""Key handling shared by the operators: joins on hot keys, dense numbering, content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import cut

#: The largest groups that travel by broadcast; any other key holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 10_000


def content_key(*cols: str | Column) -> Column:
    """256-bit key of the values; nulls equal each other and differ from the empty string.

    Every part is written as ``length:value`` so that no two different lists give one text.
    """
    parts = []
    for col in cols:
        text = (F.col(col) if isinstance(col, str) else col).cast("string")
        parts.append(
            F.when(text.isNull(), F.lit("n"))
            .otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))
        )
    return F.sha2(F.concat_ws("|", *parts), 256)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    payload: Sequence[str],
    size: str,
    spread: Column,
    how: str = "inner",
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Add ``payload`` of ``right`` (one row per ``key``) to ``left`` although keys are skewed.

    ``size`` is a column of ``right`` with the number of left rows of that key. The
    ``hot_keys`` largest keys are looked up in a broadcast of that fixed number of rows.
    Their left rows then go through the shuffle under a random salt instead of the key, so
    every task gets its share; all other keys join on the key itself. ``spread`` is a hash
    that differs between left rows of one key.
    """
    payload = list(payload)
    hot = (
        right.where(F.col(key).isNotNull())
        .orderBy(F.desc(size), key)
        .limit(hot_keys)
        .select(F.col(key).alias("_hot_key"), F.struct(*payload).alias("_hot"))
    )
    marked = left.join(F.broadcast(hot), left[key] == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), 1 + F.pmod(spread, F.lit(1 << 20)))
        .otherwise(F.lit(0))
        .cast("long"),
    )
    cold = right.select(
        F.col(key).alias("_cold_key"), F.lit(0).cast("long").alias("_cold_salt"), F.struct(*payload).alias("_cold")
    )
    joined = marked.join(
        cold, (marked[key] == cold["_cold_key"]) & (marked["_salt"] == cold["_cold_salt"]), "left"
    )
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*[left[c] for c in left.columns], *[found[c].alias(c) for c in payload])


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order`` (which must be unique) by a distributed sort.

    A range sort gives every task a contiguous piece; the only driver-side data are the row
    counts of the pieces, one number per task.
    """
    spark = df.sparkSession
    ranked = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    piece = F.shiftright("_at", 33)
    counts = ranked.groupBy(piece.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["p"], total))
        total += row["n"]
    table = spark.createDataFrame(offsets or [(0, 0)], "_piece long, _offset long")
    row_in_piece = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranked.join(F.broadcast(table), piece == F.col("_piece"))
        .withColumn(name, F.col("_offset") + row_in_piece)
        .drop("_at", "_piece", "_offset")
    )
