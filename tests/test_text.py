"""Text expressions, records and lookups on hand-made rows."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import pairs as px
from shelfmark.functions.edit import distance
from shelfmark.functions.text import char_ngrams, clean, doi_url, extract_year, split_words, word_runs
from shelfmark.operators import lookup, records, tagging, terms, timeline
from shelfmark.operators.pair_scores import attach_texts, pair_report, tfidf_cosine_pairs
from shelfmark.operators.similarity_join import cosine_join, dice_join, jaccard_join


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_clean_doi_and_year(spark):
    got = values(spark, [(" \t a b \n",), (None,), ("",)], "t string", clean("t"))
    assert [g[0] for g in got] == ["a b", "", ""]
    got = values(spark, [("10.1/x",), ("https://doi.org/10.1/x",), ("",), (None,)], "t string", doi_url("t"))
    assert [g[0] for g in got] == ["https://doi.org/10.1/x", "https://doi.org/10.1/x", "", ""]
    dates = ["20260401", "2026", "Mar2026", "3/5/2026", "2026.0", "2024-03-01", "12345", "c2019", "1899", "nan", "", None]
    got = values(spark, [(d,) for d in dates], "t string", extract_year("t"))
    assert [g[0] for g in got] == [2026, 2026, 2026, 2026, 2026, 2024, 1234, 2019, 1899, None, None, None]


def test_tokens(spark):
    row = [("Été à-la  Niño_7 x\nÜBER",), (None,), ("",)]
    got = values(spark, row, "t string", word_runs("t", 3), split_words("t"), char_ngrams(F.substring("t", 1, 3)))
    assert got[0] == (["été", "niño_7", "über"], ["été", "à-la", "niño_7", "x", "über"], ["ét", "té"])
    assert got[1] == ([], [], []) and got[2] == ([], [], [])
    assert values(spark, [("a",)], "t string", char_ngrams("t"))[0][0] == []


PAIRS = [("same text here", "same text here"), ("ab cd", "xy zw"), ("", ""), ("a", ""), ("a", "a"),
         ("Éa b C", "éA B c"), ("kitten sat", "sitting sat on"), ("éa", "ea")]


def test_pair_scores_follow_the_definitions(spark):
    got = values(spark, PAIRS, "a string, b string", px.jaccard("a", "b"), px.levenshtein_sim("a", "b"),
                 px.hamming_words("a", "b"), px.dice_ngrams("a", "b"))
    for (a, b), (jac, lev, ham, dice) in zip(PAIRS, got):
        wa, wb = a.lower().split(), b.lower().split()
        sa, sb = set(wa), set(wb)
        assert jac == pytest.approx(len(sa & sb) / len(sa | sb) if sa and sb else 0.0)
        same = sum(x == y for x, y in zip(wa, wb))
        assert ham == pytest.approx(same / max(len(wa), len(wb)) if wa and wb else 0.0)
        ga, gb = ({t.lower()[i:i + 2] for i in range(len(t) - 1)} for t in (a, b))
        assert dice == pytest.approx(2 * len(ga & gb) / (len(ga) + len(gb)) if ga and gb else 0.0)
        longest = max(len(a), len(b))
        assert lev == pytest.approx(1 - table_distance(a, b) / longest if longest else 1.0)


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@given(st.text("abé𝄞 ", max_size=90), st.text("abé𝄞 ", max_size=90))
@settings(max_examples=300, deadline=None)
def test_edit_distance_equals_the_table(a, b):
    assert distance(a, b) == table_distance(a, b) == distance(b, a)


def test_pair_report_and_tfidf(spark):
    docs = spark.createDataFrame([(1, "red fox ran"), (2, "red fox sat sat"), (3, "")], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "id_a long, id_b long")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, embedding array<float>")
    got = {r["id_b"]: r for r in pair_report(docs, pairs, embeddings=emb).collect()}
    assert set(got) == {2, 3} and got[2]["text_b"] == "red fox sat sat"
    i = 1 + math.log(1.5)
    expect = 2 / (math.sqrt(2 + i * i) * math.sqrt(2 + 4 * i * i))
    assert got[2]["tfidf_cosine"] == pytest.approx(expect)
    assert got[2]["semantic_mean"] == pytest.approx(math.sqrt(0.5)) and got[3]["cosine_embedding"] == 0.0
    assert got[3]["jaccard"] == 0.0
    assert tfidf_cosine_pairs(attach_texts(docs, pairs.where("id_b = 3"))).first()["tfidf_cosine"] == 0.0


def test_joins_equal_all_pairs_with_copies(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(base[: 6 + i % 5] + [f"u{i % 7}"])) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(20)] + [(200, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    words = lambda t: frozenset(t.split())
    grams = lambda t: frozenset(t[i:i + 2] for i in range(len(t) - 1))
    jac = lambda a, b: len(a & b) / len(a | b)
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    for join, features, measure, t in ((jaccard_join, words, jac, 0.7), (dice_join, grams, dice, 0.9)):
        got = {(r["id_a"], r["id_b"]): r["score"] for r in join(df, t).collect()}
        first = {}  # texts with one set of features are one node
        for i, text in rows:
            if text:
                first.setdefault(features(text), i)
        nodes = sorted((i, f) for f, i in first.items())
        expect = {(i, j): measure(a, b) for i, a in nodes for j, b in nodes if i < j and measure(a, b) >= t}
        assert got.keys() == expect.keys()
        assert all(got[k] == pytest.approx(expect[k]) for k in got)
    r = jaccard_join(df, 0.7).where("id_a = 0").first()
    assert r["copies_a"] == 21 + sum(1 for i, t in rows[1:40] if t == rows[0][1])
    low, high = (set(map(tuple, cosine_join(df, t).select("id_a", "id_b").collect())) for t in (0.5, 0.9))
    assert high < low


def test_dedup_nulls_case_and_copies(spark):
    rows = [(5, "A", "x"), (1, "A", "y"), (2, "a", "z"), (3, None, "n"), (4, None, "m"), (6, "", "e"), (7, "A ", "s")]
    df = spark.createDataFrame(rows, "id long, title string, summary string")
    kept = records.dedup_first(df, ["title"], ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 6, 7]
    assert sorted(r["id"] for r in records.dedup_first(kept, ["title"], ["id"]).collect()) == [1, 2, 3, 6, 7]
    assert {(r["id"], r["kept_id"]) for r in records.duplicates(df, ["title"], "id").collect()} == {(5, 1), (4, 3)}
    stats = records.stats_by_key(df, ["title"], ["id"], "summary").first()
    assert (stats["total"], stats["unique_rows"], stats["repeated"], stats["abstracts"]) == (7, 5, 2, 0)
    empty = records.stats_by_key(df.limit(0), ["title"], ["id"], "summary").first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_search_category_country(spark):
    rows = [(1, "Machine LEARNING", "ÉTUDE a+b"), (2, None, "limited"), (3, "x", None)]
    df = spark.createDataFrame(rows, "id long, title string, summary string").withColumn("authors", F.lit("n"))
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(lookup.search(df, "")) == [1, 2, 3]
    assert ids(lookup.search(df, "étude|LIMITED")) == [1, 2]
    assert ids(lookup.search(df, "A+B", regex=False)) == [1]
    flagged = lookup.flag_category(df, "title")
    assert [r["is_education"] for r in flagged.orderBy("id").collect()] == [True, False, False]
    share = {r["category"]: (r["n"], r["share_pct"]) for r in lookup.category_share(flagged).collect()}
    assert share == {"Educación": (1, 33.3), "Otros Temas (IA General)": (2, 66.7)}
    assert [r["country"] for r in tagging.tag_country(df).orderBy("id").collect()] == [None, "USA", None]
    word = tagging.tag_country(df, mode="word").orderBy("id").collect()
    assert [r["country"] for r in word] == [None, None, None]
    both = spark.createDataFrame([("Paris and Beijing", ""), ("none", "Lyon")], "authors string, summary string")
    assert [r["country"] for r in tagging.tag_country(both).collect()] == ["China", "France"]
    assert lookup.lookup_first(df, "title", "x", ["id"]).first()["id"] == 3


def test_cloud_folds_plurals_and_takes_pairs_off_their_words(spark):
    text = "neural network. neural networks! networks 123 glass the " * 30 + "neural lamps lamp other words stand alone here"
    df = spark.createDataFrame([(text,), (None,)], "summary string")
    single = {r["term"]: r["n"] for r in terms.cloud_weights(df, with_collocations=False).collect()}
    assert single["network"] == 90 and single["lamp"] == 2 and "networks" not in single
    assert single["glass"] == 30 and "123" not in single and "the" not in single
    pairs = {r["term"]: r["n"] for r in terms.cloud_weights(df).collect()}
    assert pairs["neural network"] == 60
    # both pairs with "neural" count off it, and what falls to zero is dropped
    assert pairs["glass neural"] == 30 and "neural" not in pairs


def test_timeline_with_and_without_sources_and_years(spark):
    df = spark.createDataFrame([("2024", "a"), ("Mar2024", "b"), ("1/2/2025", "a"), ("1800", "a"), (None, "b")], "published string, source string")
    rows = [r.asDict() for r in timeline.timeline(timeline.with_year(df)).collect()]
    assert rows == [{"year": 2024, "a": 1, "b": 1}, {"year": 2025, "a": 1, "b": 0}]
    plain = timeline.timeline(timeline.with_year(df.select("source").limit(2).drop("source").withColumn("x", F.lit(1)))).collect()
    assert [r.asDict() for r in plain] == [{"year": 2024, "Fuente Externa": 2}]
    none = timeline.timeline_long(timeline.with_year(df.where("published = '1800'")))
    assert none.count() == 0


def test_characters_are_cut_without_a_pattern(spark):
    texts = ["", None, "a", "aé日本😀xyz \n\r b", "😀", "ÀB", "aaaa"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3):
        got = [r[0] for r in df.select(char_ngrams("t", n)).collect()]
        low = [(t or "").lower() for t in texts]
        assert got == [list(dict.fromkeys(t[i : i + n] for i in range(len(t) - n + 1))) for t in low]
    assert "regexp" not in df.select(char_ngrams("t"))._jdf.queryExecution().executedPlan().toString()
