"""Rows of a table taken or left by a table of keys, without moving texts where keys are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most keys that travel by broadcast (some 16 bytes each); beyond, rows are shuffled by key.
BROADCAST_KEYS = 500_000
#: Most entries of lists beside keys that travel by broadcast.
BROADCAST_ENTRIES = 1_000_000


def text_key(id_col: str, text_col: str) -> Column:
    """A key by id and text: rows of equal id and text share it; nulls are values of their own."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def placed(keys: DataFrame, entries: Column | None = None) -> DataFrame:
    """``keys`` marked for a broadcast if their number allows it, else for a sorted join; with
    ``entries``, the length of the list beside each key, the lists are counted too."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    if few and entries is not None:
        few = (keys.agg(F.sum(entries)).first()[0] or 0) <= BROADCAST_ENTRIES
    return F.broadcast(keys) if few else keys.hint("shuffle_merge")


def without(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and :func:`text_key` are not in ``keys`` (id, key)."""
    gone = placed(keys.select(F.col("id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct())
    same = docs[id_col].eqNullSafe(F.col("_gone_id")) & (text_key(id_col, text_col) == F.col("_gone_key"))
    return docs.join(gone, same, "left_anti")
