"""Quality rules and benchmark phrases on small made tables, next to plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.llm.decontamination import (
    benchmark_hits, clean_documents, index_words, near_matches, phrases_of, postings, rarest_terms, term_counts,
)
from shelfmark.llm.quality_rules import good_documents, log_binomial_tail, quality_verdicts, text_stats

DOCS = "doc_id long, text string, lang string, key string, n_words string"
LABELS = "doc_id long, quality int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \t\n", "one", "a b c d e a b c d e", "a b c d e f a b c d e", "x x x x x x x x x",
    "l\nl\n\nl\n m", "é#ñ *|<> \x0b tab\x0cform", "word " * 3000, " ".join(WORDS) + "\n" + " ".join(WORDS[::-1]),
]


def test_stats_equal_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in text_stats(df).collect()}
    assert got == {i: plain_stats(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.1), (300, 1, 0.02), (5000, 60, 0.02), (40, 3, 0.3), (200000, 3800, 0.02), (1, 0, 0.5)])
def test_binomial_tail_is_exact(spark, n, k, p):
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    top = max(log(j) for j in range(k + 1))
    want = top + math.log(math.fsum(math.exp(log(j) - top) for j in range(k + 1)))
    row = spark.range(1).select(log_binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first()
    assert row.t == pytest.approx(want, abs=1e-6)


def corpus(spark, n=900):
    clean = lambda i: " ".join(f"{w}{i}x{k}" for k, w in enumerate(WORDS * 2))
    junk = lambda i: " ".join(f"{w}{i}***" for w in WORDS * 2 if True)
    rows = [(i, clean(i) if i % 5 else " ".join(f"{w}{i}y{k}***" for k, w in enumerate(WORDS)), "en", None, "clash") for i in range(n)]
    del junk
    return rows, [(i, int(i % 5 > 0)) for i in range(n)]


def test_rules_keep_good_and_reject_marked_junk(spark):
    rows, labels = corpus(spark)
    rows += [(None, "short", None, "k", "w"), (3, rows[3][1], "en", None, "w"), (3, rows[3][1], "en", None, "w"), (9999, None, "fr", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    found = quality_verdicts(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None or r.doc_id == 9999:
            assert r.base_failed and not r.kept
        else:
            assert not r.base_failed and r.kept == (r.doc_id % 5 > 0)
    kept = good_documents(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns and kept.count() == 900 * 4 // 5 + 2


def test_rules_without_labels_or_rows(spark):
    rows, _ = corpus(spark, 20)
    docs = spark.createDataFrame(rows, DOCS)
    found = quality_verdicts(docs, spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept for r in found) and len(found) == 20
    few = quality_verdicts(docs, spark.createDataFrame([(0, 0), (1, 1), (2, None), (None, 1)], LABELS)).collect()
    assert all(r.kept for r in few)  # too few labels certify nothing
    assert quality_verdicts(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


ITEMS = [(1, "The Quick brown fox jumps over the lazy dog and then sleeps"), (2, "short item"), (3, None), (4, "..."), (None, "null id item"), (5, "Short ITEM"), (6, "éa éb")]
PAGES = [
    (1, "xx the quick brown fox jumps over the lazy dog and yy"), (2, "the quick brown fox jumps over the lazy dog"), (3, "short-item, SHORT item"),
    (4, None), (5, ""), (None, "null id item here"), (None, None), (7, "ÉA éb éA Éb éa éb"), (8, "short item"), (8, "short item"), (8, "nothing"),
]


def plain_hits(text, width=10):
    words, hit, items = plain_words(text), set(), set()
    for item, t in ITEMS:
        w = plain_words(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[i : i + n]:
                    hit |= set(range(p, p + n))
                    items |= {str(item)} if item is not None else set()
    return len(words), len(hit), len(items), sorted(items)


def test_hits_equal_plain_python(spark):
    docs = spark.createDataFrame([(d, t, "e", "k", "n") for d, t in PAGES], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    import hashlib

    got = sorted(map(tuple, benchmark_hits(docs, items).collect()), key=str)
    want = []
    for d, t in PAGES:
        n, h, k, names = plain_hits(t)
        want.append((d, n, h, k, hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0))
    assert got == sorted(want, key=str)
    left = clean_documents(docs, items)
    assert left.columns == docs.columns
    assert left.count() == sum(not w[5] for w in want)
    assert benchmark_hits(docs, items.limit(0)).where("contaminated").count() == 0
    assert benchmark_hits(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "lazy red dog sleeps"), (2, "lazy a b c d e f dog")], "key int, text string").select("key", index_words("text").alias("w"))
    phrases = phrases_of(spark.createDataFrame([(1, "lazy dog")], "item_id int, text string"))
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    anchors = rarest_terms(phrases.select("phrase"), term_counts(docs, terms))
    index = postings(docs, anchors.select("term"), 3)
    assert [r.key for r in near_matches(index, anchors).collect()] == [1]
