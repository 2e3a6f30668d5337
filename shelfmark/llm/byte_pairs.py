"""Byte-level BPE encoding and decoding in two tiers.

A text is cut into pre-tokens by the pattern of the vocabulary. The first tier looks each
different pre-token up as a whole: a minimal perfect hash gives every entry of the vocabulary
a slot of its own, without empty slots, and the bytes in the slot are compared, so a hit is
exact. What misses goes to the second tier, which merges single bytes: they form a linked
list, and a heap holds the neighbouring pairs by rank, then by place.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from shelfmark.llm.words import hash_spans, mix, slices, text_bytes

#: Merged pre-tokens that a task remembers; the memory starts anew when full.
REMEMBERED = 200_000
#: A longer text (in characters) goes through the pattern and the codec in pieces of so many pre-tokens.
LONG_TEXT, PIECE = 1 << 20, 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _from_spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of all spans, one span after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether span i of ``a`` holds the bytes of span i of ``b``."""
    size = a_end - a_start
    same = size == b_end - b_start
    at = np.flatnonzero(same & (size > 0))
    if len(at):
        equal = a[_from_spans(a_start[at], size[at])] == b[_from_spans(b_start[at], size[at])]
        same[at] = np.logical_and.reduceat(equal, np.cumsum(size[at]) - size[at])
    return same


class PerfectHash:
    """A minimal perfect hash of different 64-bit numbers: n keys, n slots, by displacement.

    Keys fall into buckets of some four. From the largest bucket on, each gets the first
    displacement that sends its keys to free slots; a bucket of one key gets a free slot itself.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("two keys have one hash")
        self.n, self.buckets = n, max(1, n // 4)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        sizes = np.bincount(bucket, minlength=self.buckets)
        by_bucket = np.argsort(bucket, kind="stable")
        first = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        tries = np.arange(64, dtype=np.uint64)[:, None]
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own, base = keys[by_bucket[first[b] : first[b] + sizes[b]]], 0
            while True:
                slots = np.sort(self._slots(own[None, :], tries + np.uint64(base)), axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
                if len(good):
                    break
                base += len(tries)
            self.shift[b] = base + good[0]
            taken[slots[good[0]]] = True
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + (shift + np.uint64(1)) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot for a number that is no key."""
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(keys, np.maximum(shift, 0).astype(np.uint64)))


class ByteCodec:
    """Encoder and decoder for one vocabulary of byte strings and ranks, and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        tokens = sorted(ranks, key=ranks.get)
        self.buf = np.frombuffer(b"".join(tokens), np.uint8)
        self.end = np.cumsum([len(t) for t in tokens])
        self.start = self.end - [len(t) for t in tokens]
        hashes = hash_spans(self.buf, self.start, self.end)
        self.slot_of = PerfectHash(hashes)
        self.token_at = np.empty(len(tokens), np.int64)  # slot -> place in the list of tokens
        self.token_at[self.slot_of(hashes)] = np.arange(len(tokens))
        self.id_at = np.array([ranks[t] for t in tokens], np.int64)  # place in the list -> id
        surface, decimal = [b""] * (int(self.id_at.max()) + 1), [b""] * (int(self.id_at.max()) + 1)
        for t, i in ranks.items():
            surface[i], decimal[i] = t, b",%d" % i
        self.surface, self.decimal = pa.array(surface, pa.large_binary()), pa.array(decimal, pa.large_binary())
        self.merged_ids: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids by merging single bytes: the pair of lowest rank first, then the leftmost."""
        n, rank = len(word), self.ranks.get
        ids: list[int] = [self.ranks[word[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        now = [rank(word[i : i + 2]) for i in range(n - 1)]  # rank of the part that begins at i with the next one
        now.append(None)
        heap = [(r, i) for i, r in enumerate(now) if r is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if now[i] != r:
                continue  # the pair is no longer there
            ids[i], j = r, after[i]
            now[j], after[i] = None, after[j]
            k, p = after[i], before[i]
            now[i] = None
            if k < n:
                before[k] = i
                if (r := rank(word[i : after[k]])) is not None:
                    now[i] = r
                    heappush(heap, (r, i))
            if p >= 0:
                now[p] = r = rank(word[p:k])
                if r is not None:
                    heappush(heap, (r, p))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _missed(self, word: str) -> list[int]:
        ids = self.merged_ids.get(word)
        if ids is None:
            if len(self.merged_ids) >= REMEMBERED:
                self.merged_ids.clear()
            ids = self.merged_ids[word] = self.merge(word.encode())
        return ids

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of each of the different words."""
        buf, offs = text_bytes(words)
        start, end = offs[:-1], offs[1:]
        at = self.token_at[self.slot_of(hash_spans(buf, start, end))]
        found = same_bytes(buf, start, end, self.buf, self.start[at], self.end[at])
        missed = np.flatnonzero(~found)
        merged = [self._missed(words[int(i)].as_py()) for i in missed]
        sizes = np.ones(len(words), np.int64)
        sizes[missed] = [len(m) for m in merged]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.empty(offsets[-1], np.int64)
        ids[offsets[:-1][found]] = self.id_at[at[found]]
        if merged:
            ids[_from_spans(offsets[missed], sizes[missed])] = np.concatenate(merged)
        return ids, offsets

    def ids_of(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): all ids of these pre-tokens in order, and how many each has."""
        if not matches:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = pa.array(matches, pa.large_string()).dictionary_encode()
        ids, offsets = self.word_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = np.diff(offsets)[which]
        return ids[_from_spans(offsets[which], sizes)], sizes

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a long one's in lists of bounded length."""
        if len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while piece := [m.group() for m in islice(found, PIECE)]:
            yield piece

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.pieces(text) for i in self.ids_of(piece)[0]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.surface[i].as_py() for i in ids)

    def joined(self, table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes, offsets): the entries of a table of byte strings for these ids, side by side."""
        taken = table.take(pa.array(ids))
        offs = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        return memoryview(taken.buffers()[2] or b""), offs

    def coded(self, texts: list[str]) -> Iterator[tuple[int, str, str, np.ndarray, bytes]]:
        """For each text: n_tokens, digest of the ids, digest of the decoded bytes, ids, decoded."""
        if len(texts) > 1:
            lists = [[m for piece in self.pieces(t) for m in piece] for t in texts]
            ids, sizes = self.ids_of([m for found in lists for m in found])
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, lists)])]
            parts = [[ids[a:b]] for a, b in zip(ends, ends[1:])]
            names, n_at = self.joined(self.decimal, ids)
            back, b_at = self.joined(self.surface, ids)
            for (part,), a, b in zip(parts, ends, ends[1:]):
                name, own = names[n_at[a] + (b > a) : n_at[b]], back[b_at[a] : b_at[b]]
                yield len(part), hashlib.sha256(name).hexdigest(), hashlib.sha256(own).hexdigest(), part, own
            return
        for text in texts:  # one text, maybe a very long one: its pieces are hashed as they come
            n, of_ids, of_bytes, parts, decoded = 0, hashlib.sha256(), hashlib.sha256(), [], []
            for piece in self.pieces(text):
                ids, _ = self.ids_of(piece)
                name, own = self.joined(self.decimal, ids)[0], self.joined(self.surface, ids)[0]
                of_ids.update(name[1:] if n == 0 else name)
                of_bytes.update(own)
                n += len(ids)
                parts.append(ids)
                decoded.append(bytes(own))
            yield n, of_ids.hexdigest(), of_bytes.hexdigest(), np.concatenate(parts), b"".join(decoded)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteCodec:
    """The codec of a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return ByteCodec({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)


def byte_codes(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with ``texts`` also (ids, decoded), a row per row of ``df``.

    Each match of ``pattern`` is encoded by itself; special tokens are ordinary text. A null or
    empty text has no ids and the digests of nothing. Any id, nulls and repeated ones included,
    is passed on; other columns, of whatever name, are ignored; an empty table gives no rows. The
    file reaches the executors through the session (``addFile``). Nothing is shuffled; a task holds
    two megabytes of text at a time, and a longer text in pieces.
    """
    df.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    id_type = df.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded binary" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name), pattern)
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                rows = list(own.coded([t or "" for t in part.column(1).to_pylist()]))
                n, of_ids, of_bytes, ids, decoded = zip(*rows)
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if texts:
                    out += [pa.array([i.tolist() for i in ids], pa.list_(pa.int32())), pa.array([bytes(d) for d in decoded], pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}"
    return df.select(id_col, text_col).mapInArrow(run, schema)


def decoded_bytes(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each list of ids stands for; null for a null list, an error for an unknown id."""
    df.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    kept = [c for c in df.columns if c != out_col]
    schema = df.select(kept).withColumn(out_col, df[ids_col].cast("string").cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(name), ".")
        for batch in batches:
            back = [None if ids is None else own.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=[*kept, out_col])

    return df.select(kept).mapInArrow(run, schema)
