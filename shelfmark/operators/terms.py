"""Term counts, cloud weights and collocations.

All of them count map-side first, so the shuffle carries vocabularies and not the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import word_runs
from shelfmark.functions.vocab import cloud_stop_words
from shelfmark.session import cut


def term_counts(df: DataFrame, col: str = "summary", min_len: int = 6) -> DataFrame:
    """(term, n) over the whole corpus."""
    words = df.select(F.explode(word_runs(col, min_len)).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


def top_terms(df: DataFrame, col: str = "summary", min_len: int = 6, k: int = 10) -> DataFrame:
    """The ``k`` most frequent terms of at least ``min_len`` characters; ties by term."""
    return term_counts(df, col, min_len).orderBy(F.desc("n"), "term").limit(k)


def _cloud_words(col: str, stop: Sequence[str]) -> Column:
    return F.filter(word_runs(col, 3), lambda w: ~w.isin(*stop))


def cloud_tokens(df: DataFrame, col: str = "summary", stop: Sequence[str] | None = None) -> DataFrame:
    """(term, n) of the words of three or more characters that are no stop words.

    The stop words are a constant set in the filter, so nothing is shuffled for them.
    """
    stop = cloud_stop_words() if stop is None else stop
    words = df.select(F.explode(word_runs(col, 3)).alias("term")).where(~F.col("term").isin(*stop))
    return words.groupBy("term").agg(F.count("*").alias("n"))


NUMBER = r"^\p{Nd}+$"


def _is_plural(col: str) -> Column:
    return F.col(col).endswith("s") & ~F.col(col).endswith("ss")


def _singular(col: str) -> Column:
    return F.expr(f"substring({col}, 1, length({col}) - 1)")


def _names(df: DataFrame, col: str, stop: Sequence[str], fold_plurals: bool) -> DataFrame:
    """(word, counted, n): every word but numbers, and the word it is counted under.

    ``...xs`` counts under ``...x`` where both occur; ``...ss`` is no plural. Both sides of
    the join hold a word once, so it has no hot key. The result has the size of the
    vocabulary and is read several times, so it is written once.
    """
    words = cloud_tokens(df, col, stop).where(~F.col("term").rlike(NUMBER))
    if not fold_plurals:
        return cut(words.select(F.col("term").alias("word"), F.col("term").alias("counted"), "n"))
    words = cut(words)
    stem = F.when(_is_plural("term"), _singular("term"))
    singular = words.select(F.col("term").alias("counted"))
    plural = words.select("term", "n", stem.alias("stem"))
    return cut(
        plural.join(singular, F.col("stem") == F.col("counted"), "left").select(
            F.col("term").alias("word"), F.coalesce("counted", "term").alias("counted"), "n"
        )
    )


def _counted(names: DataFrame) -> DataFrame:
    return names.groupBy(F.col("counted").alias("term")).agg(F.sum("n").alias("n"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """log of p^k (1-p)^(n-k), with probabilities held off zero."""
    tiny = F.lit(1e-10)
    return k * F.log(F.greatest(p, tiny)) + (n - k) * F.log(F.greatest(1 - p, tiny))


def _collocation_score(total: float) -> Column:
    """Dunning's log-likelihood ratio of the pair count ``n`` against the counts c1 and c2."""
    c12, c1, c2 = (F.col(c).cast("double") for c in ("n", "c1", "c2"))
    n = F.lit(total)
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    ratio = (
        _log_likelihood(c12, c1, p)
        + _log_likelihood(c2 - c12, n - c1, p)
        - _log_likelihood(c12, c1, p1)
        - _log_likelihood(c2 - c12, n - c1, p2)
    )
    return F.when((n <= c1) | (n <= c2), F.lit(0.0)).otherwise(-2 * ratio)


def _stem(col: str, fold_plurals: bool) -> Column:
    """A word without its plural ending. Of all words only ``...x`` and ``...xs`` have the stem ``...x``."""
    return F.when(_is_plural(col), _singular(col)).otherwise(F.col(col)) if fold_plurals else F.col(col)


def _word_pairs(df: DataFrame, col: str, stop: Sequence[str], fold_plurals: bool) -> DataFrame:
    """(word1, stem2, singular, n) of neighbouring words, numbers and stop words taken out first.

    Pairs whose second words have one stem are one row; ``singular`` tells whether the stem itself occurs.
    """
    words = F.filter(_cloud_words(col, stop), lambda w: ~w.rlike(NUMBER))
    pair = F.zip_with(
        "w", F.slice("w", F.lit(2), F.size("w")),
        lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("word1"), b.alias("word2"))),
    )
    return (
        df.select(words.alias("w"))
        .select(F.explode(pair).alias("p"))
        .where(F.col("p").isNotNull())
        .select("p.word1", "p.word2")
        .select("word1", "word2", _stem("word2", fold_plurals).alias("stem2"))
        .groupBy("word1", "stem2")
        .agg(F.max(F.col("word2") == F.col("stem2")).alias("singular"), F.count("*").alias("n"))
    )


def _scored_pairs(pairs: DataFrame, names: DataFrame, min_score: float, fold_plurals: bool) -> DataFrame:
    single = cut(_counted(names))
    total = float(names.agg(F.sum("n")).first()[0] or 0.0)
    # a word stands in either table once, so a task builds its table from an even share of the vocabulary
    # and the pairs, which are many more, need no sort
    first = names.select(F.col("word").alias("word1"), F.col("counted").alias("unigram1")).join(
        single.select(F.col("term").alias("unigram1"), F.col("n").alias("c1")), "unigram1"
    )
    # ...xs counts under ...x where both occur, so a stem has one word to count under
    second = single.select(
        _stem("term", fold_plurals).alias("stem2"), F.col("term").alias("unigram2"), F.col("n").alias("c2")
    )
    # a plural second word joins the pair with the singular where that pair occurs
    folded = pairs.join(second.hint("shuffle_hash"), "stem2").select(
        "word1", F.when(F.col("singular"), F.col("stem2")).otherwise(F.concat("stem2", F.lit("s"))).alias("word2"),
        "unigram2", "n", "c2",
    )
    scored = folded.join(first.hint("shuffle_hash"), "word1").withColumn("score", _collocation_score(total))
    return scored.where(F.col("score") > min_score).select(
        "word1", "word2", "unigram1", "unigram2", "n", "score"
    )


def collocations(
    df: DataFrame,
    col: str = "summary",
    stop: Sequence[str] | None = None,
    min_score: float = 30.0,
    fold_plurals: bool = True,
) -> DataFrame:
    """(word1, word2, unigram1, unigram2, n, score): neighbouring words that occur together
    more than by chance, with the words they are counted under.

    Words are neighbours within one document (deviation: no pair spans two documents).
    """
    stop = cloud_stop_words() if stop is None else stop
    return _scored_pairs(_word_pairs(df, col, stop, fold_plurals), _names(df, col, stop, fold_plurals), min_score, fold_plurals)


def cloud_weights(
    df: DataFrame,
    col: str = "summary",
    stop: Sequence[str] | None = None,
    k: int = 100,
    fold_plurals: bool = True,
    with_collocations: bool = True,
    min_score: float = 30.0,
) -> DataFrame:
    """The ``k`` heaviest cloud entries as (term, n, weight), weight = n / largest n.

    Numbers are dropped and plurals counted with their singular. With collocations, a pair
    of words that scores above ``min_score`` is an entry of its own and its occurrences are
    taken off its two words. The corpus is read twice: for its words and for its pairs.
    """
    stop = cloud_stop_words() if stop is None else stop
    names = _names(df, col, stop, fold_plurals)
    counts = _counted(names)
    if with_collocations:
        pairs = cut(_scored_pairs(_word_pairs(df, col, stop, fold_plurals), names, min_score, fold_plurals))
        taken = pairs.select(
            F.explode(F.array("unigram1", "unigram2")).alias("term"), (-F.col("n")).alias("n")
        )
        phrases = pairs.select(F.concat_ws(" ", "word1", "word2").alias("term"), "n")
        counts = (
            counts.unionByName(taken)
            .groupBy("term")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") > 0)
            .unionByName(phrases)
        )
    top = counts.orderBy(F.desc("n"), "term").limit(k)
    # at most k rows from here on
    ranked = top.agg(F.max("n").alias("largest"), F.collect_list(F.struct("term", "n")).alias("rows"))
    return ranked.select("largest", F.inline("rows")).select(
        "term", "n", (F.col("n") / F.col("largest")).alias("weight")
    )
