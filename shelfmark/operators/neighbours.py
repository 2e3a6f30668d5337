"""Nearest neighbours of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.operators.blocks import BLOCK_ROWS, block_pairs, block_product, chunks, matrix, numbers
from shelfmark.operators.keys import dense_index, lookup_join
from shelfmark.operators.vectors import vector_key
from shelfmark.session import cut

#: Points whose largest product stands for them, and how far a product of half the digits may be off.
GROUP, MARGIN = 32, 1e-4
#: Pairs that are multiplied one by one at a time.
PAIRS = 1 << 17


def _best(ids: np.ndarray, other: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best columns of every row, smaller ids first on ties (columns come in id order)."""
    k = min(k, sims.shape[1])
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.repeat(ids, k), other[order].ravel(), np.take_along_axis(sims, order, axis=1).ravel()


def _likeliest(va: np.ndarray, vb: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``va``, row of ``vb``, product): for every row of ``va`` its ``k`` best rows of ``vb``, and more that come near.

    Products of half the digits tell what is worth an exact one: the k-th best of the largest products of groups
    of rows is no better than the k-th best row.
    """
    rows, cols, sims = [], [], []
    short_a, short_b = va.astype(np.float32), np.ascontiguousarray(vb.astype(np.float32).T)
    groups = max(1, len(vb) // GROUP)
    for part in chunks(len(va)):
        rough = short_a[part] @ short_b
        least = np.full(len(rough), -np.inf, np.float32)
        if groups > k:
            tops = rough[:, : groups * GROUP].reshape(len(rough), groups, GROUP).max(axis=2)
            least = np.partition(tops, groups - k, axis=1)[:, groups - k]
        i, j = np.nonzero(rough >= least[:, None] - MARGIN)
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS] + part.start, j[at : at + PAIRS]
            rows.append(x)
            cols.append(y)
            # the same digits wherever a pair meets, so that equal ones stay equal
            sims.append(np.einsum("ij,ij->i", va[x], vb[y]))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _first(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best columns of every row, smaller ones first on ties."""
    order = np.lexsort((cols, -sims, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, int)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return order[rank < k]


def _top(k: int):
    def kernel(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        """(rep, partner, sim): the ``k`` best partners of each point in this cell, itself among them."""
        a, b = a.sort_by("rep"), b.sort_by("rep")
        va, vb, ida, idb = matrix(a), matrix(b), numbers(a, "rep"), numbers(b, "rep")
        pieces = []
        for x, y, idx, idy in ((va, vb, ida, idb),) if same else ((va, vb, ida, idb), (vb, va, idb, ida)):
            rows, cols, sims = _likeliest(x, y, k)
            best = _first(rows, cols, sims, k)
            pieces.append((idx[rows[best]], idy[cols[best]], sims[best]))
        rep, partner, sim = (np.concatenate(c) for c in zip(*pieces))
        return pa.table({"rep": rep, "partner": partner, "sim": sim})

    return kernel


def _top_of_asked(k: int):
    def kernel(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        b = b.sort_by("rep")
        va, vb, ida, idb = matrix(a), matrix(b), numbers(a, "rep"), numbers(b, "rep")
        pieces = []
        for part in chunks(len(va)):
            sims = va[part] @ vb.T
            sims[ida[part][:, None] == idb[None, :]] = -np.inf
            pieces.append(_best(ida[part], idb, sims, k))
        rep, partner, sim = (np.concatenate(c) for c in zip(*pieces))
        real = np.isfinite(sim)
        return pa.table({"rep": rep[real], "partner": partner[real], "sim": sim[real]})

    return kernel


def embedding_topk(
    vectors: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
    asked: Column | None = None,
) -> DataFrame:
    """(id, neighbour, rank, sim): the ``k`` most similar other rows by cosine, exactly.

    A zero vector has similarity 0 to all; rows without a vector or with a null in it are left out. All pairs of
    different vectors are compared (:func:`_topk_of_all`). With ``asked``, only the rows for which it holds have
    neighbours looked for, among all rows: the work is asked rows times rows.
    """
    schema = "rep long, partner long, sim double"
    unit = _unit(vectors, id_col, vector_col)
    if asked is None:
        return _topk_of_all(unit.where(F.forall("v", lambda x: x.isNotNull())), k, block_rows)
    some = _unit(vectors.where(asked), id_col, vector_col).select(*[F.col(c).alias(c) for c in ("rep", "v")])
    return _ranked(block_product(some, unit, _top_of_asked(k), schema, block_rows), k)


def _topk_of_all(unit: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, neighbour, rank, sim) of all rows of ``unit`` (rep, v).

    Equal vectors are one point, numbered by their smallest id, and only the smallest ids of a point can be
    neighbours of a row. So a vector that fills a third of the table is compared once and hands on k + 1 ids.
    """
    keyed = unit.select(F.col("rep").alias("id"), vector_key("v").alias("key"), "v")
    points = keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("rows"), F.first("v").alias("v"))
    points = cut(dense_index(points, ["first", "key"], "rep"))
    named = lookup_join(keyed.select("id", "key"), points.select("key", "rep", "rows"), "key", ["rep"], "rows", F.xxhash64("id"))
    members = cut(named.groupBy("rep", "id").agg(F.count("*").alias("times")))
    # an id may come with several vectors, none of which is a neighbour of the others
    most = k + (members.groupBy("id").count().agg(F.max("count")).first()[0] or 0)
    near = block_pairs(points.select("rep", "v"), _top(most), "rep long, partner long, sim double", block_rows)
    best_first = Window.partitionBy("rep").orderBy(F.desc("sim"), "partner")
    best = near.withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= most)
    by_id = Window.partitionBy("rep").orderBy("id")
    offered = members.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= most)
    offered = offered.groupBy(F.col("rep").alias("partner")).agg(F.collect_list(F.struct("id", "times")).alias("ids"))
    # the best entries of every point, of which a row skips its own id
    entries = best.join(offered, "partner").select("rep", "sim", F.inline("ids"))
    entry = F.struct((-F.col("sim")).alias("minus"), "id", "times")
    lists = entries.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, most).alias("best"))
    others = F.filter("best", lambda e: e["id"] != F.col("id"))
    rows = members.join(lists, "rep").select("id", F.col("times").alias("asked"), F.explode(F.slice(others, 1, k)).alias("e"))
    times = F.least(F.col("asked") * F.col("e.times"), F.lit(k)).cast("int")
    near = rows.select(F.col("id").alias("rep"), F.col("e.id").alias("partner"), (-F.col("e.minus")).alias("sim"), times.alias("times"))
    return _ranked(near.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("_", "times"), k)


def _unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rep, v): vectors of unit length, zero vectors as they are."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    raw = vectors.select(F.col(id_col).cast("long").alias("rep"), v.alias("v"))
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return raw.withColumn("norm", norm).select(
        "rep", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v")
    )


def _ranked(near: DataFrame, k: int) -> DataFrame:
    best_first = Window.partitionBy("rep").orderBy(F.desc("sim"), "partner")
    return (
        near.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select(F.col("rep").alias("id"), F.col("partner").alias("neighbour"), "rank", "sim")
    )


def _codes(planes: np.ndarray, probes: int):
    """Arrow function: each row at its own cell in every table, and at the ``probes`` nearest other cells."""
    tables, bits, dim = planes.shape

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            v = matrix(table)
            at = v @ planes.reshape(tables * bits, dim).T
            at = at.reshape(len(v), tables, bits)
            own = (at > 0) @ (1 << np.arange(bits, dtype=np.int64))
            nearest = np.argsort(np.abs(at), axis=2)[:, :, :probes]  # the planes that a vector is closest to
            rows = np.arange(len(v))
            for t in range(tables):
                cells = [(own[:, t], True)] + [(own[:, t] ^ (np.int64(1) << nearest[:, t, i]), False) for i in range(min(probes, bits))]
                for code, home in cells:
                    out = pa.Table.from_batches([batch]).take(pa.array(rows))
                    out = out.append_column("bucket", pa.array(code * tables + t, pa.int64())).append_column("home", pa.array(np.full(len(v), home)))
                    yield from out.to_batches()

    return run


def _best_of_bucket(k: int):
    def kernel(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
        if asked.num_rows == 0 or stored.num_rows == 0:
            empty = np.zeros(0, np.int64)
            return pa.table({"rep": empty, "partner": empty, "sim": np.zeros(0)})
        asked, stored = asked.sort_by("rep"), stored.sort_by("rep")
        va, vb, ida, idb = matrix(asked), matrix(stored), numbers(asked, "rep"), numbers(stored, "rep")
        pieces = []
        for part in chunks(len(va)):
            sims = va[part] @ vb.T
            sims[ida[part][:, None] == idb[None, :]] = -np.inf
            pieces.append(_best(ida[part], idb, sims, k))
        rep, partner, sim = (np.concatenate(c) for c in zip(*pieces))
        real = np.isfinite(sim)
        return pa.table({"rep": rep[real], "partner": partner[real], "sim": sim[real]})

    return kernel


def embedding_topk_approx(
    vectors: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "embedding", tables: int = 8, probes: int = 4,
    bucket_rows: int = 256, block_rows: int = BLOCK_ROWS, seed: int = 0,
) -> DataFrame:
    """(id, neighbour, rank, sim): as :func:`embedding_topk`, but only among vectors that share a cell.

    In each of ``tables`` sets of random hyperplanes a vector lies in the cell of its signs; there are as many
    planes as make cells of some ``bucket_rows`` vectors. Every vector is stored in its own cell and asks there and in
    the ``probes`` cells across the planes nearest to it. Similarities are exact; what can be missing
    are neighbours that share none of these cells. More tables or probes raise the recall. A cell
    with more vectors than ``block_rows`` is split, and each part of its questions meets each part of its
    vectors, so no task holds more and no neighbour in the cell is lost. A zero vector has similarity 0 to all.
    """
    unit = cut(_unit(vectors, id_col, vector_col))
    n, dim = unit.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "id long, neighbour long, rank int, sim double")
    bits = min(48, max(0, round(np.log2(max(n, 1) / bucket_rows))))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))
    schema = "rep long, v array<double>, bucket long, home boolean"
    placed = cut(unit.select("rep", "v").mapInArrow(_codes(planes, probes), schema))
    sizes = placed.groupBy("bucket").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / block_rows).cast("int").alias("stored_parts"),
        F.ceil(F.count("*") / block_rows).cast("int").alias("asked_parts"),
    ).where((F.col("stored_parts") > 1) | (F.col("asked_parts") > 1))
    rows = placed.join(sizes, "bucket", "left").fillna(1, ["stored_parts", "asked_parts"])
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("bucket", part("asked_parts").alias("p"), every("stored_parts").alias("q"), "rep", "v")
    own = [F.col(c).alias(c) for c in ("bucket", "rep", "v")]  # columns apart from those of the other side
    stored = rows.where("home").select(*own, every("asked_parts").alias("p"), part("stored_parts").alias("q"))
    near = asked.groupBy("bucket", "p", "q").cogroup(stored.groupBy("bucket", "p", "q")).applyInArrow(
        _best_of_bucket(k), "rep long, partner long, sim double"
    )
    # the same pair met in another table has the same similarity, up to rounding
    return _ranked(near.groupBy("rep", "partner").agg(F.max("sim").alias("sim")), k)
