"""Forms for large inputs next to brute force or the exact form: micro-clusters, cells, pieces, dictionaries, starts."""

import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfmark.functions.vocab import COUNTRIES
from shelfmark.operators.dictionary import tag_by_dictionary
from shelfmark.operators.edit_join import length_classes, levenshtein_join
from shelfmark.operators.kmeans import best_centres, kmeans
from shelfmark.operators.neighbours import embedding_topk, embedding_topk_approx
from shelfmark.operators.tagging import tag_country
from shelfmark.operators.vectors import as_arrays, distinct_vectors
from shelfmark.operators.ward import cut_tree, micro_clusters, ward_linkage


def blobs(seed, n, d=6, centres=4, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, d)) * 3
    x = at[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a large group of copies
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "features"])


# ---- Ward over micro-clusters ------------------------------------------------------------


def test_micro_ward_has_the_exact_top(spark):
    x = blobs(1, 300)
    exact = ward_linkage(frame(spark, x)).orderBy("merge_id").collect()
    z = ward_linkage(frame(spark, x), max_exact=40)
    rough = z.orderBy("merge_id").collect()
    n = len(x)
    assert len(rough) == n - 1 and rough[-1]["size"] == n
    used = sorted(v for r in rough for v in (r["left"], r["right"]))
    assert used == list(range(2 * n - 2)) and all(max(r["left"], r["right"]) < n + r["merge_id"] for r in rough)
    size = {i: 1 for i in range(n)}
    for r in rough:
        size[n + r["merge_id"]] = size[r["left"]] + size[r["right"]]
        assert size[n + r["merge_id"]] == r["size"]
    for a, b in zip(exact[-3:], rough[-3:]):  # between blobs: within two hundredths
        assert abs(a["height"] - b["height"]) <= 0.02 * a["height"]
    total = ((x - x.mean(axis=0)) ** 2).sum()
    assert total - 1e-6 <= sum(r["height"] ** 2 for r in rough) / 2 <= 1.02 * total
    assert sorted(r["count"] for r in cut_tree(z, 4).groupBy("label").count().collect()) == sorted(
        r["count"] for r in cut_tree(ward_linkage(frame(spark, x)), 4).groupBy("label").count().collect()
    )


def test_features_of_micro_clusters_add_up(spark):
    x = blobs(2, 200)
    arrays = as_arrays(frame(spark, x))
    members, features = micro_clusters(arrays, distinct_vectors(arrays.select("id", F.col("v").alias("features"))), 25)
    home = {r["id"]: r["rep"] for r in members.collect()}
    rows = {r["rep"]: r for r in features.collect()}
    assert len(home) == 200 and set(home.values()) == set(rows) and len(rows) <= 25
    for rep, r in rows.items():
        own = x[[i for i, h in home.items() if h == rep]]
        assert rep == min(i for i, h in home.items() if h == rep) and r["n"] == len(own)
        assert np.allclose(r["total"], own.sum(axis=0)) and r["squares"] == pytest.approx((own**2).sum())


# ---- approximate neighbours ----------------------------------------------------------------


def test_neighbours_by_cells_reach_the_recall(spark):
    vec = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pairs = lambda df: {(r["id"], r["neighbour"]) for r in df.collect()}
    exact = pairs(embedding_topk(vec, 5, "vec_id"))
    assert len(exact & pairs(embedding_topk_approx(vec, 5, "vec_id"))) >= 0.9 * len(exact)


def test_split_cells_give_the_same_rows(spark):
    x = np.random.default_rng(5).normal(size=(150, 8))
    x[:40] = x[0]
    x[41] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    rows = lambda **kw: [
        (r["id"], r["rank"], r["neighbour"], round(r["sim"], 9)) for r in embedding_topk_approx(df, 4, bucket_rows=40, **kw).orderBy("id", "rank").collect()
    ]
    assert rows() == rows(block_rows=17)
    one_cell = embedding_topk_approx(df, 3, bucket_rows=1000).orderBy("id", "rank").collect()
    exact = embedding_topk(df, 3).orderBy("id", "rank").collect()
    assert [round(r["sim"], 9) for r in one_cell] == [round(r["sim"], 9) for r in exact]
    assert embedding_topk_approx(df.limit(0)).count() == 0


# ---- edit similarity join --------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_edit_join_equals_all_pairs(spark, threshold):
    rng, texts = random.Random(7), []
    for _ in range(40):
        base = "".join(rng.choice("abcdé ") for _ in range(rng.choice([1, 2, 4, 9, 20, 60])))
        for _ in range(3):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                at = rng.randrange(len(text) + 1)
                rng.choice([lambda: text.insert(at, "z"), lambda: text.pop(at - 1) if text else None, lambda: text.append("🙂")])()
            texts.append("".join(text))
    rows = list(enumerate(texts)) + [(900, ""), (901, None), (902, texts[0]), (903, texts[0])]
    df = spark.createDataFrame(rows, "id long, text string")
    first, copies = {}, {}
    for i, t in rows:
        if t:
            first.setdefault(t, i)
            copies[t] = copies.get(t, 0) + 1
    expect = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j:
                d = edits(a, b)
                if 1 - d / max(len(a), len(b)) >= threshold - 1e-9:
                    expect[i, j] = (copies[a], copies[b], d, pytest.approx(1 - d / max(len(a), len(b))))
    got = {(r["id_a"], r["id_b"]): tuple(r)[2:] for r in levenshtein_join(df, threshold).collect()}
    assert got == expect and len(expect) > 20


def test_length_classes_cut_pieces_of_some_length():
    for t in (0.75, 0.8, 0.9, 0.99, 1.0):
        for (first, most, size), (after, _, _) in zip(length_classes(t), length_classes(t)[1:]):
            assert size >= 1 and (most + 1) * size <= first
            assert most >= int((1 - t) * ((after - 1) / t) - 1e-6)
    with pytest.raises(ValueError):
        levenshtein_join(None, 0.5)


# ---- dictionary ---------------------------------------------------------------------------------


@pytest.mark.parametrize("mode", ["substring", "word"])
def test_dictionary_equals_one_search_after_the_other(spark, mode):
    rng = random.Random(3)
    words = [v for vs in COUNTRIES.values() for v in vs] + ["limited", "ukulele", "x_uk", "uk-based", "été", "Paris", "ROMA", "the"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3]))) if i % 3 else None, " ".join(rng.choices(words, k=4))) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", "")], "id long, authors string, summary string")
    known = [(c, v, i) for i, (c, vs) in enumerate(COUNTRIES.items()) for v in vs] + [("Nowhere", "", 0), ("Nobody", None, 0)]
    dictionary = spark.createDataFrame(known, "name string, variant string, priority int")
    want = {r["id"]: r["country"] for r in tag_country(df, mode=mode).collect()}
    assert len(set(want.values())) > 5
    for most in (200_000, 10):
        got = tag_by_dictionary(df.withColumn("country", F.lit("old")), dictionary, ("authors", "summary"), "country", mode, most)
        assert {r["id"]: r["country"] for r in got.collect()} == want
    assert tag_by_dictionary(df, dictionary.limit(0), ("summary",)).where("tag is not null").count() == 0


# ---- K-Means ----------------------------------------------------------------------------------------


def test_starts_in_one_pass_cost_no_more(spark):
    x = np.random.default_rng(4).normal(size=(400, 5))
    x[:100] = x[0]
    points = spark.createDataFrame([(i, r.tolist(), 1.0) for i, r in enumerate(x)], "id long, v array<double>, copies double")
    centres, cost = best_centres(points, 4, 42, 8, 300, 1e-4)
    data = points.select(array_to_vector("v").alias("features")).cache()
    other = min(KMeans(k=4, seed=s, maxIter=300).fit(data).summary.trainingCost for s in range(8))
    assert centres.shape == (4, 5) and cost <= other * 1.01
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert near.min(axis=1).sum() == pytest.approx(cost)


def test_kmeans_with_fewer_points_than_clusters(spark):
    x = np.array([[0.0, 0], [0, 0], [5, 5], [0, 0]])
    labels = [r["label"] for r in kmeans(frame(spark, x), 3).orderBy("id").collect()]
    assert labels == [0, 0, 1, 0]
    jobs = blobs(6, 120)
    found = [r["label"] for r in kmeans(frame(spark, jobs), 4).orderBy("id").collect()]
    assert len(set(found)) == 4 and found[: 40] == [0] * 40
