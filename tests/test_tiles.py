"""Blocks that meet without a shuffle."""

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.operators import blocks


def _cells():
    """A kernel that gives all pairs a cell is to look at."""

    def kernel(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        i, j = np.triu_indices(a.num_rows, 1) if same else map(np.ravel, np.indices((a.num_rows, b.num_rows)))
        dots = (blocks.matrix(a)[i] * blocks.matrix(b)[j]).sum(axis=1)
        return pa.table({"dot": dots, "a": blocks.numbers(a, "rep")[i], "b": blocks.numbers(b, "rep")[j]})

    return kernel


_SCHEMA = "a long, b long, dot double"


def _frame(spark, n, seed=4):
    x = np.random.default_rng(seed).integers(-9, 9, (n, 3)).astype(float)
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, v array<double>")


@pytest.mark.parametrize("tile_bytes, rows", [(400, 3), (400, 100), (1 << 20, 7), (1 << 20, 100)])
def test_every_pair_meets_once_and_is_sent_nowhere(spark, monkeypatch, tile_bytes, rows):
    monkeypatch.setattr(blocks, "TILE_BYTES", tile_bytes)
    x, points = _frame(spark, 61)
    other, more = _frame(spark, 17, 5)
    dot = x @ x.T
    for met, expect in (
        (blocks.block_pairs(points, _cells(), _SCHEMA, rows), {(i, j): dot[i, j] for i in range(61) for j in range(i)}),
        (blocks.block_product(points, more, _cells(), _SCHEMA, rows), {(i, j): x[i] @ other[j] for i in range(61) for j in range(17)}),
        (blocks.block_product(more, points, _cells(), _SCHEMA, rows), {(i, j): x[j] @ other[i] for i in range(17) for j in range(61)}),
    ):
        found = [(r["a"], r["b"], r["dot"]) for r in met.collect()]
        if len(expect) == 61 * 30:
            found = [(max(a, b), min(a, b), d) for a, b, d in found]
        assert len(found) == len(expect) and {(a, b): d for a, b, d in found} == expect
        # a shuffle would send each point once for every tile that it meets
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()


def test_no_points(spark):
    _, points = _frame(spark, 3)
    none = points.limit(0)
    assert blocks.block_pairs(none, _cells(), _SCHEMA).count() == 0
    assert blocks.block_product(none, points, _cells(), _SCHEMA).count() == 0
