"""Clustering against brute force on small point sets."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfmark.operators.components import connected_components
from shelfmark.operators.dbscan import dbscan
from shelfmark.operators.keys import dense_index, lookup_join
from shelfmark.operators.kmeans import kmeans
from shelfmark.operators.neighbours import embedding_topk
from shelfmark.operators.silhouette import density_score, silhouette
from shelfmark.operators.ward import cut_tree, ward_linkage


def points(seed=0, n=90, d=5, copies=10):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, d))) * (rng.random((n, d)) < 0.6)
    x[n - copies:] = x[0]
    x[3] = 0.0
    x[7] = x[4]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def frame(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "features"])


def ward_heights(x):
    v, n = [r for r in x], [1] * len(x)
    out = []
    while len(v) > 1:
        best = min(
            ((2 * n[i] * n[j] / (n[i] + n[j]) * ((v[i] - v[j]) ** 2).sum(), i, j)
             for i in range(len(v)) for j in range(i + 1, len(v)))
        )
        cost, i, j = best
        out.append(np.sqrt(cost))
        v[i] = (n[i] * v[i] + n[j] * v[j]) / (n[i] + n[j])
        n[i] += n[j]
        del v[j], n[j]
    return sorted(out)


@pytest.mark.parametrize("block_rows,group_rows", [(4096, 4096), (24, 24)])
def test_ward_matches_one_merge_at_a_time(spark, block_rows, group_rows):
    x = points(n=45)
    z = ward_linkage(frame(spark, x), block_rows, group_rows).orderBy("merge_id").collect()
    assert [r["merge_id"] for r in z] == list(range(len(x) - 1))
    assert np.allclose([r["height"] for r in z], ward_heights(x), atol=1e-9)
    assert z[-1]["size"] == len(x)
    used = sorted(n for r in z for n in (r["left"], r["right"]))
    assert used == list(range(2 * len(x) - 2))
    assert all(max(r["left"], r["right"]) < len(x) + r["merge_id"] for r in z)


def test_cut_tree_gives_k_groups_and_ties_fewer(spark):
    x = np.array([[0.0, 0], [0.1, 0], [5, 0], [5.1, 0], [0, 9], [0, 9.1]])
    z = ward_linkage(frame(spark, x))
    got = {r["id"]: r["label"] for r in cut_tree(z, 3).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}
    square = np.array([[0.0, 0], [1, 0], [100, 0], [101, 0]])
    # the two lowest merges have one height, so three groups cannot be had
    z = ward_linkage(frame(spark, square))
    assert len({r["label"] for r in cut_tree(z, 3).collect()}) == 2


def brute_dbscan(x, eps, min_samples):
    zero = np.linalg.norm(x, axis=1) == 0
    near = 1 - x @ x.T <= eps
    near[zero] = near[:, zero] = False
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= min_samples
    labels, current = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or labels[i] >= 0:
            continue
        todo = [i]
        labels[i] = current
        while todo:
            p = todo.pop()
            if not core[p]:
                continue
            for o in np.flatnonzero(near[p]):
                if labels[o] < 0:
                    labels[o] = current
                    todo.append(o)
        current += 1
    return labels


def test_dbscan_with_zero_vectors_in_reach(spark):
    x = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [0.0, 0.0]])
    near = {r["id"]: r["label"] for r in dbscan(frame(spark, x), 1.0, 2).collect()}
    far = {r["id"]: r["label"] for r in dbscan(frame(spark, x), 0.9, 2).collect()}
    assert set(near.values()) == {0} and far[2] == far[3] == -1


@pytest.mark.parametrize("eps,min_samples,block_rows", [(0.05, 2, 4096), (0.05, 4, 16), (0.02, 3, 16), (0.3, 2, 20)])
def test_dbscan_matches_brute_force(spark, eps, min_samples, block_rows):
    x = points(1)
    got = {r["id"]: r["label"] for r in dbscan(frame(spark, x), eps, min_samples, block_rows).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, min_samples).tolist()


def brute_silhouette(d, labels):
    s = []
    for i in range(len(d)):
        own = labels == labels[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(s)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_silhouettes_match_brute_force(spark, block_rows):
    x = points(2)
    labels = np.arange(len(x)) % 4
    labels[5] = 9
    assign = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, label int")
    euclid = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    cosine = 1 - x @ x.T
    np.fill_diagonal(cosine, 0.0)
    v = frame(spark, x)
    assert silhouette(v, assign, "euclidean", block_rows).first()[0] == pytest.approx(brute_silhouette(euclid, labels))
    assert silhouette(v, assign, "cosine", block_rows).first()[0] == pytest.approx(brute_silhouette(cosine, labels))
    one = assign.withColumn("label", F.lit(0))
    assert silhouette(v, one).first()[0] is None
    assert density_score(v, one).first()[0] == 0.0
    noisy = assign.withColumn("label", F.when(F.col("id") < 3, -1).otherwise(0))
    assert density_score(v, noisy).first()[0] == 0.0


def test_kmeans_labels_follow_smallest_ids(spark):
    x = np.array([[0.0, 0], [9, 9], [0, 0.1], [9, 9.1], [-9, 9], [-9, 9.2]])
    got = {r["id"]: r["label"] for r in kmeans(frame(spark, x), 3, n_init=3).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 2, 5: 2}


def test_components_of_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 299)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0}
    assert {got[i] for i in range(100, 130)} == {100}
    assert got[299] == got[300] == 299


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype("float32")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<float>")
    x = x.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    for rows in (4096, 13):
        got = embedding_topk(df, 3, block_rows=rows).orderBy("id", "rank").collect()
        assert [r["neighbour"] for r in got] == np.argsort(-sims, axis=1)[:, :3].ravel().tolist()


def test_lookup_join_with_a_hot_key_and_dense_index(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("twice", F.col("k") * 2)
    for hot in (1, 5):
        got = lookup_join(left, right, "k", ["twice"], "n", F.xxhash64("id"), hot_keys=hot)
        assert got.count() == 1000
        assert got.where(F.col("twice") != F.col("k") * 2).count() == 0
    numbered = dense_index(left.select("id"), [F.desc("id")], "at").collect()
    assert all(r["at"] == 999 - r["id"] for r in numbered) and len(numbered) == 1000
