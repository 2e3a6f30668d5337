"""Bytes covered by long strings that start elsewhere too, over a whole corpus, exactly.

A string of ``width`` bytes has one anchor: the place of its smallest hashed piece, found from
its own bytes. Equal strings have equal anchors at the same distance, so only places of one
anchor have to be compared, a few bytes in a hundred:

1. A pass over the texts lists the anchors with the run of string starts each stands for, and
   hashes of the anchor and of all bytes of the run. Equal runs of a task are settled there
   and send one row, so a passage in a third of all texts does not meet in one task.
2. Rows of an anchor meet in a shuffle. Equal runs are settled. Where an anchor comes with
   different runs, one run of each kind asks for its bytes.
3. The bytes are cut from the texts, meet by anchor, and all their strings are put in order
   by :mod:`shelfmark.llm.suffix_sort`; equal neighbours are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfmark.llm.suffix_sort import equal_groups
from shelfmark.llm.words import mix, slices, text_bytes, tidy
from shelfmark.session import cut

#: Bytes of the hashed piece in an anchor.
PIECE = 64
#: Most list entries that travel by broadcast; beyond, texts are shuffled by id.
BROADCAST_ENTRIES = 1_000_000
#: Runs that a task holds before it writes them out.
HELD_RUNS = 1_000_000
#: Bytes of text whose anchors are sought at once; a longer text is sought alone.
ANCHOR_BYTES = 1 << 19
#: Bytes of runs sorted at once.
SORT_BYTES = 1 << 21

_SPAN, _ASK, _SEEN = 0, 1, 2
_SCHEMA = "anchor bigint, run bigint, id bigint, h bigint, at bigint, tag bigint"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchors(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, first start, anchor distance, further starts, anchor hash, run hash) of the runs of
    string starts with one anchor. Positions are those in the row."""
    none = np.zeros(0, np.int64)
    reach = width - PIECE + 1
    if len(buf) < width:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(11))
    powers, back = _powers(_BASE, len(buf)), _powers(_BACK, len(buf))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(table[buf] * powers, dtype=np.uint64)])
    piece = mix((sums[PIECE:] - sums[:-PIECE]) * back[: len(buf) - PIECE + 1])
    low = np.uint64((1 << 31) - 1)
    value = (piece & ~low) | np.arange(len(piece), dtype=np.uint64)
    # smallest value of each stretch of ``reach``: two running minima over blocks of that size
    blocks = -(-len(value) // reach)
    padded = np.full(blocks * reach, np.iinfo(np.uint64).max)
    padded[: len(value)] = value
    square = padded.reshape(blocks, reach)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    n_starts = len(buf) - width + 1
    best = (np.minimum(behind[:n_starts], ahead[reach - 1 : reach - 1 + n_starts]) & low).astype(np.int64)
    size = np.diff(offs)
    row_of = np.repeat(np.arange(len(size)), size)[:n_starts]
    valid = np.arange(n_starts) + width <= offs[1:][row_of]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = best[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (row_of[starts[1:]] != row_of[starts[:-1]])
    lead = np.flatnonzero(new)
    first, where = starts[lead], anchor[lead]
    more = np.diff(np.concatenate([lead, [len(starts)]])) - 1
    last = first + more + width
    whole = mix((sums[last] - sums[first]) * back[first]) + mix(((where - first) << 8 | more).astype(np.uint64))
    row = row_of[first]
    return row, first - offs[row], where - first, more, piece[where], whole


def _packed(first: np.ndarray, distance: np.ndarray, more: np.ndarray) -> np.ndarray:
    return first << 16 | distance << 8 | more


def _batch(*cols: np.ndarray, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "run", "id", "h", "at", "tag"]
    for i in range(0, len(cols[0]), most):
        part = [c[i : i + most] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in part], names=names)


def _heads(anchor: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by anchor and run, marks of the first of each kind, number of each kind per row)."""
    order = np.lexsort((run, anchor))
    a, r = anchor[order], run[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    kind = np.cumsum(new) - 1
    return order, new, np.bincount(kind)[kind] if len(kind) else kind


def _listed(width: int):
    """The runs of a task's texts, in pieces of a bounded number; equal ones of a piece are settled here."""

    def written(cols: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, whole, ids, h, at = (np.concatenate(c) for c in cols)
        order, new, count = _heads(anchor, whole)
        twice = order[count > 1]
        yield from _batch(mix(ids[twice].astype(np.uint64) ^ at[twice].astype(np.uint64)), whole[twice], ids[twice], h[twice], at[twice], np.full(len(twice), _SPAN))
        lead = order[new]
        yield from _batch(anchor[lead], whole[lead], ids[lead], h[lead], at[lead], np.where(count[new] > 1, _SEEN, _ASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        held = 0
        for batch in batches:
            for part in slices(batch, "text", ANCHOR_BYTES):
                row, first, distance, more, piece, whole = anchors(*text_bytes(part.column("text")), width)
                ids, h = part.column("id").to_numpy(), part.column("h").to_numpy()
                for col, x in zip(cols, (piece, whole, ids[row], h[row], _packed(first, distance, more))):
                    col.append(x)
                held += len(row)
                if held >= HELD_RUNS:
                    yield from written(cols)
                    cols, held = [[] for _ in range(5)], 0
        if held:
            yield from written(cols)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the anchors of a partition: repeats of equal runs, and runs that ask for bytes."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for batch in batches:
        values = [c.to_numpy() for c in batch.columns]
        done = values[5] == _SPAN
        if done.any():
            yield from _batch(*(v[done] for v in values))
        for col, v in zip(cols, values):
            col.append(v[~done])
    if not cols[0]:
        return
    anchor, whole, ids, h, at, tag = (np.concatenate(c) for c in cols)
    order, new, count = _heads(anchor, whole)
    fresh = order[(count > 1) & (tag[order] == _ASK)]
    yield from _batch(anchor[fresh], whole[fresh], ids[fresh], h[fresh], at[fresh], np.full(len(fresh), _SPAN))
    lead, many = order[new], count[new] > 1
    a = anchor[lead]
    kinds = np.unique(a, return_inverse=True, return_counts=True)
    mixed = kinds[2][kinds[1]] > 1 if len(a) else np.zeros(0, bool)
    ask, seen = lead[mixed], (many | (tag[lead] == _SEEN))[mixed]
    yield from _batch(anchor[ask], whole[ask], ids[ask], h[ask], at[ask], np.where(seen, _SEEN, _ASK))


_BYTES = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("tag", pa.int64()), ("bytes", pa.binary())])


def _cut_out(width: int):
    """The bytes of the runs that each text was asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_bytes(part.column("text"))
                raw = buf.tobytes()
                asked = part.column("asked")
                flat, per = asked.flatten(), np.diff(asked.offsets.to_numpy())
                row = np.repeat(np.arange(len(part)), per)
                at = flat.field("at").to_numpy()
                begin = offs[row] + (at >> 16)
                end = begin + (at & 255) + width
                got = [raw[i:j] for i, j in zip(begin.tolist(), end.tolist())]
                ids, h = part.column("id").to_numpy()[row], part.column("h").to_numpy()[row]
                for i in range(0, len(row), 20_000):
                    to = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [flat.field("anchor")[to], pa.array(ids[to]), pa.array(h[to]), pa.array(at[to]), flat.field("tag")[to], pa.array(got[to], pa.binary())], schema=_BYTES
                    )

    return run


_SPANS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _repeats(width: int):
    """Spans of repeated strings in runs that meet by anchor."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, h, at, tag = (batch.column(c).to_numpy() for c in ("id", "h", "at", "tag"))
        keep = np.sort(np.unique(np.stack([ids, h, at]), axis=1, return_index=True)[1])  # equal rows give the same run
        ids, h, at, tag = ids[keep], h[keep], at[keep], tag[keep]
        col = batch.column("bytes").take(pa.array(keep)).cast(pa.large_binary())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        buf = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        n = (at & 255) + 1
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        twice = equal_groups(buf, (offs[:-1] - offs[0])[run] + step, width) >= 0
        twice &= (tag == _ASK)[run]
        hit = np.flatnonzero(twice)
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (run[hit[1:]] != run[hit[:-1]])
        lead = np.flatnonzero(new)
        first, last = hit[lead], hit[np.concatenate([lead[1:], [len(hit)]]) - 1] if len(hit) else hit
        of = run[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (ids[of], h[of], (at[of] >> 16) + step[first], (at[of] >> 16) + step[last] + width)], schema=_SPANS
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if held.nbytes > SORT_BYTES:
                anchor = held.column("anchor").to_numpy()
                edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
                done = 0
                for edge in edges.tolist():
                    if held.slice(done, edge - done).nbytes > SORT_BYTES or edge == edges[-1]:
                        yield solve(held.slice(done, edge - done))
                        done = edge
                held = held.slice(done)
        if held is not None and len(held):
            yield solve(held)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows of equal id and text have one key, so have null ids of equal text."""
    own = F.col(id_col).cast("bigint")
    return docs.select(
        F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col), own.isNull()).alias("h"), F.col(text_col).alias("text"), own.alias("_own")
    )


def _with_lists(texts: DataFrame, lists: DataFrame, entries: int, how: str) -> DataFrame:
    """``texts`` with a list per (id, h), which is broadcast only if ``entries`` are few."""
    lists = lists.select(F.col("id").alias("_id"), F.col("h").alias("_h"), *[c for c in lists.columns if c not in ("id", "h")])
    same = (texts["id"] == F.col("_id")) & (texts["h"] == F.col("_h"))
    return texts.join(F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists.hint("shuffle_merge"), same, how)


def repeated_spans(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans): the maximal byte spans [begin, end) of a text that strings of ``width``
    bytes cover which start somewhere else too, in the same or another text."""
    texts = _keyed(docs, id_col, text_col).select("id", "h", "text")
    met = cut(texts.mapInArrow(tidy(_listed(width)), _SCHEMA).repartition("anchor").mapInArrow(tidy(_met), _SCHEMA))
    first = F.shiftright("at", 16)
    settled = met.where(F.col("tag") == _SPAN).select(
        "id", "h", first.alias("begin"), (first + F.col("at").bitwiseAND(255) + width).alias("end")
    )
    open_runs = met.where(F.col("tag") != _SPAN)
    asked = open_runs.groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "at", "tag")).alias("asked"))
    runs = _with_lists(texts, asked, open_runs.count(), "inner").select("id", "h", "text", "asked").mapInArrow(tidy(_cut_out(width)), "anchor bigint, id bigint, h bigint, at bigint, tag bigint, bytes binary")
    sorted_runs = runs.repartition("anchor").sortWithinPartitions("anchor")
    found = sorted_runs.mapInArrow(tidy(_repeats(width)), "id bigint, h bigint, begin bigint, end bigint")
    every = F.sort_array(F.collect_set(F.struct("begin", "end")))
    start = F.struct(F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("done"), F.lit(-1).cast("bigint").alias("begin"), F.lit(-1).cast("bigint").alias("end"))
    closed = lambda a: F.when(a["end"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end")))))
    merged = F.aggregate(
        every,
        start,
        lambda a, s: F.when(
            s["begin"] <= a["end"], F.struct(a["done"].alias("done"), a["begin"].alias("begin"), F.greatest(a["end"], s["end"]).alias("end"))
        ).otherwise(F.struct(closed(a).alias("done"), s["begin"].alias("begin"), s["end"].alias("end"))),
        closed,
    )
    return cut(settled.unionByName(found).groupBy("id", "h").agg(merged.alias("spans")))


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), with ``texts`` also kept_text, for every row.

    Each byte of a UTF-8 text that lies in a string of ``width`` bytes which starts anywhere
    else too goes, everywhere; strings are judged on the input and never cross texts. A null
    text is empty. Rows are told apart by id and text: equal rows count as two places and have
    the same result, null and repeated ids are passed on. kept_text leaves out what a cut
    through a character leaves of it; kept_sha256 is over the very bytes. An empty table gives
    no rows. Of ``docs`` only the named columns are read. Ids are whole numbers.
    """
    spans = repeated_spans(docs, width, id_col, text_col)
    entries = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    met = _with_lists(_keyed(docs, id_col, text_col), spans, entries, "left").select("_own", "text", "spans")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for text, cuts in zip(part.column("text"), part.column("spans")):
                    raw, cuts = (text.as_py() or "").encode(), cuts.as_py() or []
                    kept = _spared(raw, cuts)
                    for col, x in zip(out, (len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept)):
                        col.append(x)
                cols = [part.column("_own"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
                names = ["_own", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols.append(pa.array([k.decode("utf-8", "ignore") for k in out[4]], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "_own bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if texts else "")
    return met.mapInArrow(tidy(cleaned), schema).withColumnRenamed("_own", id_col)


def without_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from the text; other columns and null texts stay. What a
    cut through a character leaves of it goes too."""
    spans = repeated_spans(docs, width, id_col, text_col)
    entries = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    own = F.col(id_col).cast("bigint")
    lists = spans.select(F.col("id").alias("_cut_id"), F.col("h").alias("_cut_h"), F.col("spans").alias("_cut_spans"))
    same = (F.coalesce(own, F.lit(0)) == F.col("_cut_id")) & (F.xxhash64(F.col(text_col), own.isNull()) == F.col("_cut_h"))
    met = docs.join(F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists.hint("shuffle_merge"), same, "left").select(*docs.columns, "_cut_spans")
    names = docs.columns
    at = names.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = []
                for text, cuts in zip(part.column(at), part.column(len(names))):
                    text, cuts = text.as_py(), cuts.as_py()
                    texts.append(_spared(text.encode(), cuts).decode("utf-8", "ignore") if cuts else text)
                cols = [part.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return met.mapInArrow(tidy(cleaned), docs.schema)


def _spared(raw: bytes, cuts: list[dict]) -> bytes:
    kept, at = [], 0
    for c in cuts:
        kept.append(raw[at : c["begin"]])
        at = c["end"]
    return b"".join([*kept, raw[at:]])
