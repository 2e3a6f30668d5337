"""CSV files cut into records by many tasks, also where quoted cells hold line breaks.

A task that reads a block in the middle of a file cannot know whether the block begins inside a
quoted cell. So the files are scanned twice. The first scan finds for every block in which state
it ends if it begins outside of quotes, and in which if it begins inside; these two answers,
put together block by block along a file, give the true state at every block. The second scan
starts each block in that state and cuts its lines into records. What a block leaves open at its
end goes on in the next one; only such pieces are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfmark.session import cut

FILES = "*.[cC][sS][vV]"

# One cell with its closing quote and what may follow it, a cell without quotes, or nothing. A quote
# opens a cell only as its first sign, is doubled inside, and after the closing one
# everything up to the comma belongs to the cell.
_CELL = rb'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
_ENDS_INSIDE = re.compile(rb"(?:" + _CELL + rb',)*+"(?:[^"]++|"")*+\Z')
_CLOSES = re.compile(rb'(?:[^"]++|"")*+"[^,]*+(,|\Z)')

#: How a piece of a block lies to the records around it.
WHOLE, OPEN, MIDDLE, CLOSING = 0, 1, 2, 3


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, if one was (not) open before it."""
    at = 0
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        if not closed.group(1):
            return False
        at = closed.end()
    return b'"' in line and _ENDS_INSIDE.match(line, at) is not None


def csv_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str = FILES) -> DataFrame:
    """(path, block, line): the lines of all files as bytes; the rows of a block are in order."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("line"),
        )
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def csv_blocks(lines: DataFrame) -> DataFrame:
    """(path, block, header, utf8, from_outside, from_inside), a row per block with a line.

    ``header`` is the first line of a file, null in later blocks. The last two tell whether the
    block ends inside of quotes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states, header, utf8 = None, [False, True], None, True

        def done() -> pa.RecordBatch:
            row = {"path": [at[0]], "block": [at[1]], "header": [header], "utf8": [utf8], "from_outside": [states[0]], "from_inside": [states[1]]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("path", pa.string()), ("block", pa.int64()), ("header", pa.binary()), ("utf8", pa.bool_()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())]))

        for path, block, line in _rows(batches):
            if (path, block) != at:
                if at is not None:
                    yield done()
                at, states, header, utf8 = (path, block), [False, True], line if block == 0 else None, True
            if b'"' in line:
                states = [ends_inside(line, s) for s in states]
            if utf8 and not line.isascii():
                try:
                    line.decode("utf-8")
                except UnicodeDecodeError:
                    utf8 = False
        if at is not None:
            yield done()

    return lines.mapInArrow(scan, "path string, block bigint, header binary, utf8 boolean, from_outside boolean, from_inside boolean")


def block_states(blocks: list) -> dict[str, dict[int, bool]]:
    """Whether each block of a file of several blocks begins inside of quotes."""
    files: dict[str, list] = {}
    for row in blocks:
        files.setdefault(row["path"], []).append(row)
    states = {}
    for path, rows in files.items():
        if len(rows) > 1:
            inside, states[path] = False, {}
            for row in sorted(rows, key=lambda r: r["block"]):
                states[path][row["block"]] = inside
                inside = row["from_inside"] if inside else row["from_outside"]
    return states


def csv_records(lines: DataFrame, states: dict[str, dict[int, bool]]) -> DataFrame:
    """(path, ord, record): every record as bytes with its line breaks, the header among them as ``ord`` 0.

    ``ord`` grows along a file. Blank lines between records are no records. A cell that is never
    closed ends with its file. The blocks must be those that ``states`` was made from; a block it
    does not know is an error, never a wrong cut.
    """
    shared = lines.sparkSession.sparkContext.broadcast(states)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        at, inside, n, parts, first, kind = None, False, 0, [], 0, OPEN
        out: list[tuple] = []

        def written() -> pa.RecordBatch:
            columns = zip(*out)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "block", "ord", "part", "record"])

        def leave() -> None:
            """At the end of a block, what is still open is a piece of a record."""
            if parts:
                out.append((*at, first, MIDDLE if kind == CLOSING else OPEN, b"\n".join(parts)))

        for batch in batches:
            for path, block, line in _rows([batch]):
                if (path, block) != at:
                    leave()
                    at, n, parts = (path, block), 0, []
                    if path in known:
                        inside = known[path][block]
                    elif block:
                        raise ValueError(f"{path} was split in another way than before")
                    else:
                        inside = False
                    first, kind = block, CLOSING if inside else WHOLE
                if not inside and not parts:
                    first, kind = block + n, WHOLE
                n += 1
                if b'"' in line:
                    inside = ends_inside(line, inside)
                if inside:
                    parts.append(line)
                elif parts or kind == CLOSING:
                    parts.append(line)
                    out.append((path, block, first, kind, b"\n".join(parts)))
                    parts, kind = [], WHOLE
                elif line.rstrip(b"\r"):
                    out.append((path, block, first, WHOLE, line))
            if out:
                yield written()
                out = []
        if at is not None:
            leave()
        if out:
            yield written()

    found = lines.mapInArrow(split, "path string, block bigint, ord bigint, part tinyint, record binary")
    if not any(inside for blocks in states.values() for inside in blocks.values()):
        return found.select("path", "ord", "record")
    found = cut(found)  # whole records and pieces are read apart
    pieces = found.where(F.col("part") != WHOLE)
    # along a file: one that opens, then those of blocks without an end, then one that closes
    along = Window.partitionBy("path").orderBy("block", F.col("part") == OPEN)
    opened = F.last(F.when(F.col("part") == OPEN, F.col("ord")), ignorenulls=True).over(along)
    whole = pieces.withColumn("opened", opened).groupBy("path", "opened").agg(
        F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts")
    )
    stitched = whole.select("path", F.col("opened").alias("ord"), F.array_join(F.transform("parts", lambda x: F.hex(x["record"])), "0A").alias("hex"))
    return found.where(F.col("part") == WHOLE).select("path", "ord", "record").unionByName(
        stitched.select("path", "ord", F.unhex("hex").alias("record"))
    )
