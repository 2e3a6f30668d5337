"""Neighbours of chosen rows among all rows."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.operators.neighbours import embedding_topk


def test_asked_rows_have_the_neighbours_of_all_rows(spark):
    x = np.random.default_rng(8).normal(size=(210, 6))
    x[30:40] = x[0]
    x[50] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    rows = lambda found: sorted((r["id"], r["rank"], r["neighbour"], round(r["sim"], 9)) for r in found.collect())
    every = rows(embedding_topk(df, 4))
    for block_rows in (4096, 40):
        assert rows(embedding_topk(df, 4, block_rows=block_rows, asked=F.col("id") % 10 == 0)) == [r for r in every if r[0] % 10 == 0]
    assert not rows(embedding_topk(df, 4, asked=F.lit(False)))
