"""Whole texts of an Arrow batch as numpy arrays: words, their hashes, windows over them.

Everything works on the UTF-8 bytes of many texts at once, so a task spends no Python step
per word. A batch is cut into slices of bounded bytes; one very long text is a slice alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

#: Bytes that are no white space of the class [\x20\x09-\x0D].
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: A-Z to a-z on bytes; other bytes, those of longer UTF-8 sequences included, stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def tidy(run: Callable) -> Callable:
    """An Arrow function that hands the memory of a task back when the task ends.

    Python workers live on from stage to stage, and freed memory stays with the process until it is asked for."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes.astype(np.int64))
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes that ``inside`` marks; none crosses a text."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    hit = inside[buf]
    edge = offs[(offs > 0) & (offs < len(buf))]
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, hit[:-1]
    before[edge] = False
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, hit[1:]
    after[edge - 1] = False
    start = np.flatnonzero(hit & ~before)
    end = np.flatnonzero(hit & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    size = end - start
    h = mix(size.astype(np.uint64) * _GOLDEN + _GOLDEN)
    if not len(start):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at_byte = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    todo, step = np.arange(len(start)), 0
    while len(todo):
        at = start[todo] + step
        left = end[todo] - at
        chunk = at_byte[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[todo] = mix((h[todo] ^ chunk) * _GOLDEN + np.uint64(step))
        todo, step = todo[left > 8], step + 8
    return h


def windows(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` words; a row with fewer, but not none, is one run."""
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = int(runs.sum())
    out_row = np.repeat(np.arange(n_rows), runs)
    begin = np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs) + first[out_row]
    size = np.minimum(counts, width)[out_row]
    key = np.full(total, 0x51ED270B, np.uint64)
    for k in range(width):
        have = size > k
        word = h[np.minimum(begin + k, max(len(h) - 1, 0))] if len(h) else np.zeros(total, np.uint64)
        key = np.where(have, mix((key ^ word) * _GOLDEN + np.uint64(k + 1)), key)
    return key, out_row


def distinct(key: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): the sorted different keys of each row, rows one after the other."""
    # one sort by the row and the upper bits of the key; rows by both where those bits tie
    spare = np.uint64(max(int(n_rows).bit_length(), 1))
    both = (row.astype(np.uint64) << (np.uint64(64) - spare)) | (key >> spare)
    order = np.argsort(both)
    both = both[order]
    if ((both[1:] == both[:-1]) & (key[order[1:]] != key[order[:-1]])).any():
        order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n_rows))])


def shingle_sets(col: pa.Array, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): the set of ``width``-word shingles of each text, as sorted hashes."""
    buf, offs = text_bytes(col)
    if lower:
        buf = LOWER[buf]
    start, end, row = spans(buf, offs, NOT_SPACE)
    key, at = windows(hash_spans(buf, start, end), row, len(col), width)
    return distinct(key, at, len(col))
