"""Pairs of words next to a plain count: plurals, words with a double s, numbers, documents without a pair."""

import random
import re
from collections import Counter

import pytest

from shelfmark.operators import terms

STOP = ("the", "bra")


def counted(texts, fold):
    docs = [[w for w in re.findall(r"\w{3,}", t.lower()) if w not in STOP and not w.isdecimal()] for t in texts]
    words = Counter(w for d in docs for w in d)

    def name(w):
        stem = w[:-1] if w.endswith("s") and not w.endswith("ss") else w
        return stem if fold and stem in words else w

    pairs, forms = Counter(), {}
    for d in docs:
        for a, b in zip(d, d[1:]):
            key = a, name(b)
            pairs[key] += 1
            forms[key] = min(b, forms.get(key, b))
    return {(a, forms[a, u], name(a), u): n for (a, u), n in pairs.items()}


@pytest.mark.parametrize("fold", [True, False])
def test_collocations_equal_a_plain_count(spark, fold):
    rng = random.Random(3)
    words = ["cat", "cats", "dog", "dogs", "boss", "bos", "bosss", "ies", "bras", "the", "2024", "été", "étés", "class", "classs", "lone", "on"]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 17])]) for _ in range(rng.choice([0, 1, 2, 30]))) for _ in range(40)] + [None, "cats"]
    df = spark.createDataFrame([(t,) for t in texts], "summary string")
    found = terms.collocations(df, stop=STOP, min_score=-1e9, fold_plurals=fold)
    got = {(r["word1"], r["word2"], r["unigram1"], r["unigram2"]): r["n"] for r in found.collect()}
    assert got == counted([t or "" for t in texts], fold)


def test_pairs_are_shuffled_once_to_be_counted_and_not_sorted(spark):
    df = spark.createDataFrame([("cat dogs cat dog",)], "summary string")
    plan = terms.collocations(df, min_score=-1e9)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("partial_count") == 1 and "partial_sum" not in plan
