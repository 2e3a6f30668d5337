"""Products of all points of one table with all points of another, block by block.

Some results need every distance (the exact silhouette, nearest clusters, density): their
work is n x m whatever the plan. Points are packed into tiles of bounded size, each one row that is
written once to the checkpoint folder, and every task reads the two tiles that it brings together: nothing is
sent once per pair of tiles, so disk grows with the points. A task cuts its tiles into blocks, a cell of two blocks
is one dense matrix product, and only its summary leaves the task: a best partner per row, a
sum per cluster, a spanning forest. Distances themselves are never written.

Tiles come from a hash of the id, so their sizes are even whatever the data. Callers hand
in different points only, with the number of copies as a weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, _parse_datatype_string

from shelfmark.session import cut, width

#: Points per block: two blocks of 150 doubles take 10 MB in a task.
BLOCK_ROWS = 4096
#: Rows of a cell that are multiplied at a time.
CHUNK_ROWS = 512
#: Points that are not worth a tile of their own.
TILE_ROWS = 1024
#: Bytes of a tile. A task holds two of them, and copies of them on their way to numpy.
TILE_BYTES = 48 << 20

Kernel = Callable[[pa.Table, pa.Table, bool], pa.Table]


def matrix(table: pa.Table, col: str = "v") -> np.ndarray:
    """The list column ``col`` as a dense matrix."""
    column = table.column(col).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def numbers(table: pa.Table, col: str) -> np.ndarray:
    return table.column(col).to_numpy()


def chunks(n: int) -> Iterator[slice]:
    for start in range(0, n, CHUNK_ROWS):
        yield slice(start, min(start + CHUNK_ROWS, n))


def _size(points: DataFrame) -> tuple[int, int]:
    """Rows of ``points``, and their bytes with eight for every number."""
    lists = [f.name for f in points.schema.fields if isinstance(f.dataType, ArrayType)]
    rows, inside = points.agg(F.count("*"), sum((F.sum(F.size(c)) for c in lists), F.lit(0))).first()
    return rows, 8 * ((inside or 0) + rows * len(points.columns))


def _pack(rows: DataFrame) -> DataFrame:
    """(tile, data): at most one row per partition, in the format of Arrow streams; ``tile`` is the number of the partition."""

    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batches[0].schema) as out:
                for batch in batches:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"tile": [TaskContext.get().partitionId()], "data": [sink.getvalue().to_pybytes()]})

    return cut(rows.mapInArrow(pack, "tile long, data binary"))


def _packed(points: DataFrame, tiles: int, key: str = "rep") -> DataFrame:
    """The rows of ``points`` in ``tiles`` by a hash of the ``key``."""
    return _pack(points.repartition(tiles, key))


def packed_by(rows: DataFrame, tiles: int, tile: Column) -> DataFrame:
    """The ``rows`` in the tiles that they name."""
    return _pack(rows.repartitionById(tiles, tile))


def unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _slices(table: pa.Table, rows: int) -> list[pa.Table]:
    return [table.slice(at, rows) for at in range(0, table.num_rows, rows)]


def _met(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, rows: int, half: bool) -> DataFrame:
    """Run ``kernel`` on the blocks of every tile of ``left`` with those of every tile of ``right``. With ``half`` both
    are the same tiles and each pair of blocks meets once."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same = half and batch.column("tile_a")[i] == batch.column("tile_b")[i]
                a = _slices(unpacked(batch.column("data_a")[i]), rows)
                b = a if same else _slices(unpacked(batch.column("data_b")[i]), rows)
                for x in range(len(a)):
                    for y in range(x if same else 0, len(b)):
                        found = kernel(a[x], b[y], same and x == y)
                        yield from found.select(out.names).cast(out).to_batches()

    return tiles_met(left, right, F.col("tile_a") <= F.col("tile_b") if half else None).mapInArrow(run, schema)


def tiles_met(left: DataFrame, right: DataFrame, wanted: Column | None) -> DataFrame:
    """All pairs of rows of two checkpointed tables, the columns as ``..._a`` and ``..._b``, for which ``wanted`` holds.

    A task is one partition of each side, which it reads from the checkpoint folder; nothing is shuffled.
    """
    side = lambda t, s: t.select(*[F.col(c).alias(f"{c}_{s}") for c in t.columns])
    a, b = side(left, "a").hint("shuffle_replicate_nl"), side(right, "b")
    return a.crossJoin(b) if wanted is None else a.join(b, wanted)


def _tiles(n: int, size: int, rows: int, least: int) -> int:
    """Number of tiles: of bounded bytes each, ``least`` of them so that all cores have work, but none of less than a block."""
    return max(-(-size // TILE_BYTES), min(least, -(-n // max(rows, TILE_ROWS))), 1)


def block_pairs(points: DataFrame, kernel: Kernel, schema: str, rows: int = BLOCK_ROWS, key: str = "rep") -> DataFrame:
    """Run ``kernel(a, b, same)`` on every unordered pair of blocks of ``points`` (with the different ``key``).

    Each pair of blocks is one cell, so each distance is computed once and both of its
    points see the same number. ``same`` marks a block with itself, whose rows are in the same order on both sides.
    """
    n, size = _size(points)
    tiles = _packed(points, _tiles(n, size, rows, math.ceil(math.sqrt(4 * width(points.sparkSession)))), key)
    return _met(tiles, tiles, kernel, schema, rows, half=True)


def block_product(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``kernel(a, b, False)`` on every block of ``left`` with every block of ``right``
    (both with ``rep``)."""
    (nl, size_l), (nr, size_r) = _size(left), _size(right)
    wanted = 4 * width(left.sparkSession)
    few = _tiles(min(nl, nr), min(size_l, size_r), rows, math.ceil(math.sqrt(wanted)))
    many = _tiles(max(nl, nr), max(size_l, size_r), rows, -(-wanted // few))
    a, b = (many, few) if nl >= nr else (few, many)
    return _met(_packed(left, a), _packed(right, b), kernel, schema, rows, half=False)


# ---- cells that meet through a shuffle ----------------------------------------------


def _apply(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    empty_result = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return empty_result
        return kernel(a, b, key[1].as_py())

    return (
        left.groupBy("cell", "same").cogroup(right.groupBy("cell", "same")).applyInArrow(run, schema)
    )


def _spread(df: DataFrame, cells: int) -> DataFrame:
    """One partition per cell up to the width of the session, so that cells run side by side."""
    return df.repartition(max(1, min(cells, 4 * width(df.sparkSession))), "cell", "same")
