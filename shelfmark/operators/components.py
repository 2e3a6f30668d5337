"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.operators.keys import lookup_join
from shelfmark.session import cut


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m, n): smallest id among ``u`` and its neighbours, and the number of rows of u."""
    return edges.groupBy("u").agg(
        F.least(F.min("u"), F.min("v")).alias("m"), F.count("*").alias("n")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); the component is its smallest id.

    Rounds of large star and small star: every node links its neighbours to the smallest
    one it sees, first the larger neighbours, then the smaller ones, until only stars are
    left. Hubs are looked up with :func:`lookup_join`, so a node with a third of all edges
    does not land in one task. Each round is written to the checkpoint folder.
    """
    current = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = _smallest_neighbour(both)
        # large star: neighbours above u go to the smallest
        upward = both.where(F.col("v") > F.col("u"))
        large = (
            lookup_join(upward, smallest, "u", ["m"], "n", F.xxhash64("v"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = cut(large)
        # small star: u and its lower neighbours go to the smallest of them
        lowest = _smallest_neighbour(large)
        small = lookup_join(large, lowest, "u", ["m"], "n", F.xxhash64("v"))
        linked = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        following = cut(linked.where(F.col("u") != F.col("v")).distinct())
        after = _fingerprint(following)
        if after == state:
            current = following
            break
        current, state = following, after
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash over them."""
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]
