"""TF-IDF vectors of a corpus over a bounded vocabulary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import pairs_in_order, word_runs
from shelfmark.functions.vocab import stop_words

#: Second words of pairs that are looked for by name, in multiples of the vocabulary; with more ties all are taken.
SECOND_WORDS = 10


@dataclass(frozen=True)
class Vectorised:
    """``vectors`` holds (id, features), one row per document; ``vocabulary`` names the positions."""

    vectors: DataFrame
    vocabulary: list[str]

    def long(self) -> DataFrame:
        """(id, term, w) of the entries that are not zero."""
        terms = F.array(*[F.lit(t) for t in self.vocabulary])
        return (
            self.vectors.select("id", F.posexplode(vector_to_array("features")).alias("pos", "w"))
            .where(F.col("w") != 0)
            .select("id", F.element_at(terms, F.col("pos") + 1).alias("term"), "w")
        )


def _most_frequent(terms: DataFrame, most: int) -> list[tuple[str, int]]:
    """(term, n) of the ``most`` most frequent values of ``term``, ties by name."""
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    return [(r["term"], r["n"]) for r in counts.orderBy(F.desc("n"), "term").limit(most).collect()]


def _pairs_of(first: Sequence[str], second: Sequence[str] | None) -> Column:
    """Neighbouring ``words`` joined by a blank, where the first and the second word are among the given ones.

    Neighbours are picked by position, so a pair of other words makes no text.
    """
    nxt = F.slice("words", F.lit(2), F.size("words"))
    known = lambda a, b: a.isin(*first) & (b.isNotNull() if second is None else b.isin(*second))
    return F.filter(F.zip_with("words", nxt, lambda a, b: F.when(known(a, b), F.concat(a, F.lit(" "), b))), lambda p: p.isNotNull())


def _vocabulary(docs: DataFrame, vocab: int, ngrams: Sequence[int]) -> list[str]:
    """The ``vocab`` most frequent terms of ``words``, by corpus count, ties by name.

    A pair occurs no more often than either of its words, and its name comes after that of its first word.
    So next to the ``vocab`` most frequent words a pair has a place only if its first word is one of them
    and its second word as frequent as the last of them: all other pairs go uncounted.
    """
    if vocab < 1:
        return []
    if 1 not in ngrams:
        pairs = docs.select(F.explode(pairs_in_order(F.col("words"))).alias("term"))
        return [t for t, _ in _most_frequent(pairs, vocab)]
    words = docs.select(F.explode("words").alias("term"))
    single = _most_frequent(words, SECOND_WORDS * vocab + 1 if 2 in ngrams else vocab)
    top = single[:vocab]
    if 2 not in ngrams or not top:
        return [t for t, _ in top]
    least = top[-1][1] if len(top) == vocab else 0
    second = [t for t, n in single if n >= least]
    pairs = _pairs_of([t for t, _ in top], second if len(second) <= SECOND_WORDS * vocab else None)
    double = _most_frequent(docs.select(F.explode(pairs).alias("term")), vocab)
    by_name = sorted([*top, *double], key=lambda x: x[0].encode())
    return [t for t, _ in sorted(by_name, key=lambda x: -x[1])[:vocab]]


def _grams(ngrams: Sequence[int], vocabulary: Sequence[str]) -> Column:
    """Words and pairs of ``words`` that are in the vocabulary."""
    pairs = [t for t in vocabulary if " " in t]
    ends = [sorted({t.split(" ")[i] for t in pairs}) or [""] for i in (0, 1)]
    parts = {1: F.filter("words", lambda w: w.isin(*vocabulary)), 2: F.filter(_pairs_of(*ends), lambda p: p.isin(*vocabulary))}
    return F.concat(*[parts[n] for n in ngrams])


def tfidf(
    df: DataFrame,
    id_col: str = "id",
    col: str = "summary",
    vocab: int = 150,
    ngrams: Sequence[int] = (1, 2),
    stop: Sequence[str] | None = None,
) -> Vectorised:
    """Unit-length TF-IDF vectors over the ``vocab`` most frequent terms.

    Terms rank by corpus count, ties by name; idf = ln((1+n)/(1+df)) + 1. A null text gives a
    zero vector (deviation: it is not the word "nan"). The stop words are Spark's English list
    (deviation).

    Only the vocabulary count shuffles, as partial counts of words and of pairs of frequent words. The ``vocab`` terms and weights on
    the driver are bounded by that parameter. Vectors are built where the text is read and
    kept, spilling to disk; a lost executor's share is computed again from the source.
    """
    stop = stop_words("english") if stop is None else stop
    words = word_runs(F.col(col), 2)
    # a column of their own, or each use would cut the text again
    docs = df.select(F.col(id_col).alias("id"), (F.filter(words, lambda w: ~w.isin(*stop)) if stop else words).alias("words"))
    vocabulary = _vocabulary(docs, vocab, ngrams)
    if not vocabulary:
        raise ValueError("the corpus has no terms")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="tf")
    tf = counter.transform(docs.select("id", _grams(ngrams, vocabulary).alias("grams"))).select("id", "tf").persist()
    # Spark's idf lacks the "+ 1"
    idf = IDF(inputCol="tf", outputCol="_").fit(tf).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="raw")
    unit = Normalizer(p=2.0, inputCol="raw", outputCol="features")
    vectors = unit.transform(scale.transform(tf)).select("id", "features")
    return Vectorised(vectors, vocabulary)


def as_arrays(vectors: DataFrame) -> DataFrame:
    """(id, v) with the vector as an array of doubles."""
    if vectors.schema["features"].dataType.typeName() == "array":
        return vectors.select("id", F.col("features").cast("array<double>").alias("v"))
    return vectors.select("id", vector_to_array("features").alias("v"))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row per different vector: (rep, copies, v); ``rep`` is the smallest id.

    Copies are combined before the shuffle.
    """
    return (
        as_arrays(vectors).groupBy("v")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .select("rep", "copies", "v")
    )


def vector_key(col: str) -> Column:
    """256-bit key of a vector; null for a null vector."""
    text = F.to_json(F.struct(F.col(col).alias("v")))
    return F.when(F.col(col).isNotNull(), F.sha2(text.cast("binary"), 256))
