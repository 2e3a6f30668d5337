"""Neighbours of all rows of a table: copies, hot vectors, ids that repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import neighbours
from shelfmark.operators.neighbours import embedding_topk


def _table():
    x = np.random.default_rng(1).normal(size=(260, 5))
    x[20:150] = x[3]  # a vector that fills half of the table
    x[200] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + rows[3:6] + [(7, rows[8][1]), (7, rows[9][1])] + [(900, None)]


def _expected(rows, k):
    rows = [(i, np.array(v)) for i, v in rows if v is not None]
    unit = [(i, v / (np.linalg.norm(v) or 1)) for i, v in rows]
    found = {}
    for i, v in unit:
        found.setdefault(i, []).extend((-round(float(v @ w), 9), j) for j, w in unit if j != i)
    return {i: sorted(pairs)[:k] for i, pairs in found.items()}


@pytest.mark.parametrize("k, block_rows, group", [(5, 4096, 32), (3, 16, 2)])
def test_copies_and_repeated_ids(spark, monkeypatch, k, block_rows, group):
    monkeypatch.setattr(neighbours, "GROUP", group)
    rows = _table()
    found = {}
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    for r in embedding_topk(frame, k, block_rows=block_rows).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((-round(r["sim"], 9), r["neighbour"], r["rank"]))
    assert {i: sorted(p[:2] for p in pairs) for i, pairs in found.items()} == _expected(rows, k)
    assert all([p[2] for p in pairs] == list(range(1, k + 1)) for pairs in found.values())


def test_groups_keep_the_best(spark):
    draw = np.random.default_rng(2)
    a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in (draw.normal(size=(700, 16)), draw.normal(size=(900, 16))))
    rows, cols, sims = neighbours._likeliest(a, b, 6)
    best = neighbours._first(rows, cols, sims, 6)
    assert (cols[best].reshape(700, 6) == np.argsort(-(a @ b.T), axis=1, kind="stable")[:, :6]).all()
    assert len(rows) < 40 * 700  # few exact products


def test_the_query_asks_for_every_row(spark, tmp_path):
    from shelfmark.plans.oracles import oracles
    from shelfmark.plans.queries import embedding_neighbours

    x = np.random.default_rng(6).normal(size=(40, 4))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = embedding_neighbours(spark, str(tmp_path)).groupBy("id").agg(F.count("*").alias("n")).collect()
    assert sorted((r["id"], r["n"]) for r in found) == [(i, 5) for i in range(40)]
    assert "% 100" not in oracles()["embedding_neighbours"]
