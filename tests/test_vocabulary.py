"""The vocabulary without a count of all pairs, next to a plain count."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.vectors import _pairs_of, _vocabulary, tfidf


def counted(texts, vocab, ngrams):
    n = Counter()
    for words in texts:
        if 1 in ngrams:
            n.update(words)
        if 2 in ngrams:
            n.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    return [t for t, _ in sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))[:vocab]]


@pytest.mark.parametrize("ngrams", [(1,), (2,), (1, 2)])
@pytest.mark.parametrize("vocab", [1, 3, 7, 40, 500])
def test_vocabulary_equals_a_count_of_all_terms(spark, vocab, ngrams):
    rng = random.Random(5)
    word = ["aa", "ab", "été", "zz", "z0", "a_", "日本", *[f"w{i}" for i in range(90)]]
    # few words and pairs that repeat, then a tail of ties
    texts = [[rng.choice(word[: rng.choice([3, 7, 97])]) for _ in range(rng.choice([0, 1, 2, 9]))] for _ in range(60)]
    texts += [["zz", "aa"] * 20, [f"once{i}" for i in range(200)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, words array<string>")
    assert _vocabulary(docs, vocab, ngrams) == counted(texts, vocab, ngrams)
    df = docs.select("id", F.concat_ws(" ", "words").alias("summary"))
    found = tfidf(df, vocab=vocab, ngrams=ngrams, stop=[])
    assert found.vocabulary == counted(texts, vocab, ngrams)
    has = {(r["id"], r["term"]) for r in found.long().collect()}
    assert has == {(i, t) for i, words in enumerate(texts) for t in counted([words], 1000, ngrams) if t in found.vocabulary}


def test_pairs_of_rare_words_are_never_made(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", "c"],)], "words array<string>")
    assert df.select(_pairs_of(["a"], ["c"])).first()[0] == ["a c"]
    assert df.select(_pairs_of(["a"], None)).first()[0] == ["a b", "a c"]
