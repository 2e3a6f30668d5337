"""Benchmark phrases in training text, by a distributed positional inverted index.

The index holds postings (term, document, position, words around) of the training text, for
the terms that are asked for: the rarest term of each test phrase. A phrase is looked up by
that term; its position less the term's offset in the phrase gives the only place where the
phrase can start, and the offset-adjusted neighbours must be the other terms (exact phrase),
or must all stand within a reach of the term (proximity).

Built-in expressions only. Terms are broadcast in blocks of a checked size, one scan of the
text per block; a benchmark of any size is covered by more blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.rows import text_key, without
from shelfmark.session import cut

#: What is no word once A-Z are small: words are digits, a-z and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most terms, and most bytes of terms, in one broadcast block.
BLOCK_TERMS, BLOCK_BYTES = 100_000, 4_000_000

_BIG, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index_words(text: str) -> Column:
    """Words of a text with A-Z made small; none for null."""
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(raw) == F.length(raw)
    small = F.when(plain, F.lower(raw)).otherwise(F.translate(raw, _BIG, _SMALL))
    return F.array_remove(F.split(small, BETWEEN), "")


def phrases_of(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase): the runs of ``width`` words of each item, once each; an item of fewer
    words is one run, one without words none."""
    words = items.select(F.col(id_col).cast("string").alias("item"), index_words(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return words.select("item", "w", F.explode(starts).alias("at")).select(
        "item", F.slice("w", F.col("at"), width).alias("phrase")
    ).distinct()


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The table ``terms`` (term, ...) cut by hash into blocks that may be broadcast."""
    size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
    parts = max(-(-size["n"] // BLOCK_TERMS), -(-(size["b"] or 0) // BLOCK_BYTES), 1)
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [terms]


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): postings of each term (terms: one column, distinct) in ``docs`` (w: words)."""
    every = docs.select(F.explode("w").alias("term"))
    found = [every.join(F.broadcast(block), "term").groupBy("term").agg(F.count("*").alias("n")) for block in _blocks(terms)]
    return terms.join(reduce(DataFrame.unionByName, found), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(key, term, pos, around, first): an index row for each occurrence of a term.

    ``docs`` holds ``key`` and ``w`` (words). ``around`` are the words from ``reach`` before
    the term to ``reach`` behind it, as far as the text has them; ``first`` is the position
    of the first of them. Positions count from 1.
    """
    every = docs.select("key", "w", F.posexplode("w").alias("_p", "term"))
    found = [every.join(F.broadcast(block.select("term")), "term") for block in _blocks(terms)]
    pos = F.col("_p") + 1
    first = F.greatest(pos - reach, F.lit(1))
    return reduce(DataFrame.unionByName, found).select(
        "key", "term", pos.alias("pos"), F.slice("w", first, pos + reach - first + 1).alias("around"), first.alias("first")
    )


def rarest_terms(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, term, offset): the rarest term of each phrase and its first offset in it,
    the smallest term on ties; phrases with a term that never occurs are left out."""
    each = phrases.select("phrase", F.posexplode("phrase").alias("offset", "term")).join(counts, "term")
    return each.groupBy("phrase").agg(F.min(F.struct("n", "term", "offset")).alias("m")).where(F.col("m.n") > 0).select(
        "phrase", "m.term", "m.offset"
    )


def phrase_matches(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, start, phrase): the exact occurrences of each phrase."""
    start = F.col("pos") - F.col("offset")
    at = start - F.col("first") + 1
    inside = F.when(at >= 1, F.slice("around", F.greatest(at, F.lit(1)), F.size("phrase")))
    return index.join(anchors, "term").where(inside == F.col("phrase")).select("key", start.alias("start"), "phrase")


def near_matches(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(key, pos, phrase): places of a phrase's rarest term with all its terms within the reach."""
    missing = F.array_except("phrase", "around")
    return index.join(anchors, "term").where(F.size(missing) == 0).select("key", "pos", "phrase").distinct()


def _found(docs, items, width, id_col, text_col, item_col, item_text) -> tuple[DataFrame, DataFrame]:
    """The phrases of the items, and their occurrences (at: id and key of the text, start, phrase)."""
    at = F.struct(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"))
    texts = docs.select(at.alias("key"), index_words(text_col).alias("w"))
    wanted = cut(phrases_of(items, width, item_col, item_text))
    phrases = wanted.select("phrase").distinct()
    terms = cut(phrases.select(F.explode("phrase").alias("term")).distinct())
    anchors = cut(rarest_terms(phrases, term_counts(texts, terms)))
    index = cut(postings(texts, anchors.select("term").distinct(), width - 1))
    return wanted, cut(phrase_matches(index, anchors).distinct().withColumnRenamed("key", "at"))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a phrase of ``items`` occurs, all columns as they are."""
    _, found = _found(docs, items, width, id_col, text_col, item_col, item_text)
    return without(docs, found.select("at.id", "at.key"), id_col, text_col)


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word is hit when it lies in an exact occurrence of a phrase of ``items``. Rows are told
    apart by id and text: rows with a null or repeated id each get their own result, equal
    rows the same one. Null and empty texts have no words. An item with a null id hits words
    but is not listed. Empty tables give no rows or no hits. Of the inputs only the named
    columns are read. The index and the matches are written to the checkpoint folder.
    """
    key = text_key(id_col, text_col)
    wanted, found = _found(docs, items, width, id_col, text_col, item_col, item_text)

    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", F.size("phrase").alias("n")))),
        F.struct(zero.alias("to"), zero.alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["to"], (s["start"] + s["n"]).cast("long")).alias("to"),
            (a["n"] + F.greatest(zero, s["start"] + s["n"] - F.greatest(s["start"].cast("long"), a["to"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hits = found.groupBy("at").agg(covered.alias("n_hit"))
    listed = (
        found.select("at", "phrase").distinct().join(wanted.where(F.col("item").isNotNull()), "phrase")
        .groupBy("at").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).alias("_doc"), key.alias("_key"), F.size(index_words(text_col)).cast("long").alias("n_words"))
    on = lambda other: F.col("_doc").eqNullSafe(F.col(f"{other}.id")) & (F.col("_key") == F.col(f"{other}.key"))
    met = rows.join(hits.withColumnRenamed("at", "_hit"), on("_hit"), "left").join(listed.withColumnRenamed("at", "_listed"), on("_listed"), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", zero)
    return met.select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
