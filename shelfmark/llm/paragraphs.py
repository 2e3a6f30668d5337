"""Paragraphs and passages that repeat inside and across documents, by MinHash banding.

Paragraphs are the lines of a text with enough words. Each band is a hash of some minimum
hashes of the paragraph's shingles; the number of bands follows from the recall that is asked
for at the threshold. Paragraphs that collide in a band are candidates, their exact Jaccard
similarity decides, and of each component of similar paragraphs the first one stays.

What is left is then cut, whatever its lines, into units whose bounds are set by the words
around them. Units meet, are compared and stay as paragraphs do; repeated units side by side
make a passage, which goes if it has enough words. So passages inside longer lines and over
shorter lines go too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.near_groups import Signatures, Similarity, later_members
from shelfmark.llm.rows import placed
from shelfmark.llm.words import LOWER, NOT_SPACE, hash_spans, mix, slices, spans, text_bytes, tidy
from shelfmark.session import cut

#: Bits of a paragraph's number in its key, so the document id has the rest.
PARAGRAPH_BITS = 22
#: Words on either side of the first word of a unit; units have some twice as many words.
REACH = 10

_SPAN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def tuned_bands(threshold: float, recall: float, most_bands: int = 16) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which ``most_bands`` bands reach ``recall`` at the threshold."""
    best = (1, 1)
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands > most_bands:
            break
        best = (max(bands, 1), rows)
    return best


def minhash_signatures(bands: int, rows: int) -> Signatures:
    """Band keys of each set, from ``bands * rows`` minimum hashes."""
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64))
    factors, shifts = seeds[::2] | np.uint64(1), seeds[1::2]

    def signatures(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = np.flatnonzero(np.diff(offs))
        if not len(full):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = offs[:-1][full]
        tokens, keys = mix(sets), []
        for b in range(bands):
            key = np.full(len(full), b + 1, np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                key = mix(key ^ np.minimum.reduceat((tokens ^ shifts[r]) * factors[r], start))
            keys.append(key)
        return np.concatenate(keys), np.tile(full, bands)

    return signatures


def _paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_paragraphs(
    docs: DataFrame,
    min_words: int = 20,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    recall: float = 0.9999,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, paragraph, first_id, first_paragraph): each paragraph to remove and the one that stands for it.

    Paragraphs count from 0; those below ``min_words`` words are never removed. A paragraph
    has its different runs of ``width`` words; two are similar when ``den * |common| >= num *
    |all|``. The first of a component, by document id and number, stays. Texts of null ids or
    null texts have no part. Rows that share an id share their paragraphs' keys. Ids are whole
    numbers from 0 to 2**41 - 1 and a text has at most 2**22 lines; others raise an error.
    """
    top = F.lit(1 << PARAGRAPH_BITS)
    known = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    each = known.select("d", F.posexplode(_paragraphs(F.col("t"))).alias("p", "text"))
    words = F.size(F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), ""))
    fits = (F.col("d") >= 0) & (F.col("d") < 1 << (63 - PARAGRAPH_BITS)) & (F.col("p") < top)
    key = F.when(fits, F.col("d") * top + F.col("p")).otherwise(F.raise_error(F.lit("id or line number out of range")).cast("bigint"))
    items = each.where(words >= min_words).select(key.alias("id"), "text")
    found = later_members(items, Similarity(width, num, den), minhash_signatures(*tuned_bands(num / den, recall)))
    part = lambda c: (F.shiftright(c, PARAGRAPH_BITS), F.col(c).bitwiseAND(top - 1).cast("int"))
    (d, p), (fd, fp) = part("id"), part("component")
    return found.select(
        d.alias(id_col), p.alias("paragraph"), fd.alias("first_id"), fp.alias("first_paragraph")
    ).distinct()


def passage_units(buf: np.ndarray, offs: np.ndarray, gone: list[list[int] | None]) -> tuple[np.ndarray, ...]:
    """(begin, end, row, number, words, segment) of the units of texts, without the lines ``gone`` of each.

    A unit begins at a word where the hash of it and the next word is the smallest among
    ``REACH`` words on either side, so it is known by its own surroundings wherever lines break,
    and holds more than ``REACH`` words but for the ends of a text. Units lie next to one another
    and cross the ends of lines, but no line that is gone."""
    start, end, row = spans(buf, offs, NOT_SPACE)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, none, none, none, none
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, start) - np.searchsorted(breaks, offs[:-1])[row]
    out = np.array([r << 32 | p for r, lines in enumerate(gone) for p in lines or ()], np.int64)
    kept = np.flatnonzero(~np.isin(row << 32 | line, out))
    if not len(kept):
        return none, none, none, none, none, none
    start, end, row = start[kept], end[kept], row[kept]
    apart = np.ones(len(kept), bool)
    apart[1:] = (kept[1:] != kept[:-1] + 1) | (row[1:] != row[:-1])
    segment = np.cumsum(apart)
    h = hash_spans(LOWER[buf], start, end)
    v = mix(h ^ mix(np.append(h[1:], np.uint64(0)) + np.uint64(5)))
    least = np.ones(len(v), bool)
    for k in range(1, REACH + 1):
        same = segment[k:] == segment[:-k]
        least[k:] &= ~same | (v[k:] < v[:-k])
        least[:-k] &= ~same | (v[:-k] <= v[k:])
    lead = np.flatnonzero(least | apart)
    last = np.append(lead[1:], len(v)) - 1
    own = row[lead]
    first = np.searchsorted(own, own)
    return start[lead], end[last], own, np.arange(len(lead)) - first, last - lead + 1, segment[lead]


def _cut_units(width: int):
    """(id, text) of the units with at least ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                buf, offs = text_bytes(part.column("t"))
                begin, end, row, number, words, _ = passage_units(buf, offs, part.column("removed").to_pylist())
                d = part.column("d").to_numpy()
                if len(d) and (d.min() < 0 or d.max() >= 1 << (63 - PARAGRAPH_BITS)) or (len(number) and number.max() >= 1 << PARAGRAPH_BITS):
                    raise ValueError("id or unit number out of range")
                raw, take = buf.tobytes(), np.flatnonzero(words >= width)
                key = d[row[take]] << PARAGRAPH_BITS | number[take]
                for i in range(0, len(take), 20_000):
                    at = take[i : i + 20_000]
                    text = [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 20_000]), pa.array(text, pa.binary()).cast(pa.string())], names=["id", "text"])

    return run


def _lists(docs: DataFrame, min_words: int = 20, width: int = 5, num: int = 80, den: int = 100, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_gone_id, removed, units): numbers of the lines to remove, and of the repeated units of what is left."""
    gone = repeated_paragraphs(docs, min_words, width, num, den, recall, id_col, text_col)
    lines = cut(gone.groupBy(F.col(id_col).alias("_gone_id")).agg(F.sort_array(F.collect_set("paragraph")).alias("removed")))
    known = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    left = known.join(placed(lines, F.size("removed")), F.col("d") == F.col("_gone_id"), "left").select("d", "t", "removed")
    items = left.mapInArrow(tidy(_cut_units(width)), "id bigint, text string")
    found = later_members(items, Similarity(width, num, den), minhash_signatures(*tuned_bands(num / den, recall)))
    units = found.groupBy(F.shiftright("id", PARAGRAPH_BITS).alias("_unit_id")).agg(
        F.sort_array(F.collect_set(F.col("id").bitwiseAND((1 << PARAGRAPH_BITS) - 1))).alias("units")
    )
    met = lines.join(units, F.col("_gone_id") == F.col("_unit_id"), "full")
    return cut(met.select(F.coalesce("_gone_id", "_unit_id").alias("_gone_id"), "removed", "units"))


def _entries(*lists: str) -> Column:
    """Numbers in the lists beside an id, null ones counted as none."""
    return sum((F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in lists), F.lit(0))


def _passages(text: pa.Array, removed: list, units: list, min_words: int) -> list[list[dict]]:
    """Byte spans of the passages of each text: repeated units side by side, with ``min_words`` words or more."""
    out: list[list[dict]] = [[] for _ in range(len(text))]
    rows = [i for i, u in enumerate(units) if u]
    if not rows:
        return out
    buf, offs = text_bytes(text.take(pa.array(rows)))
    begin, end, row, number, words, segment = passage_units(buf, offs, [removed[i] for i in rows])
    marked = np.isin(row << 32 | number, np.array([k << 32 | n for k, i in enumerate(rows) for n in units[i]], np.int64))
    at = np.flatnonzero(marked)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]])
    for run in np.split(at, np.flatnonzero(new)[1:]) if len(at) else ():
        if words[run].sum() >= min_words:
            k = row[run[0]]
            out[rows[k]].append({"begin": int(begin[run[0]] - offs[k]), "end": int(end[run[-1]] - offs[k])})
    return out


def paragraph_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_paragraphs, n_removed, removed, n_passages, passages) per row of ``docs``: numbers of the
    lines to remove, and byte spans of the passages to remove from the other lines.

    Null texts have no lines, an empty text has one. Rows with a null id keep all. An
    empty table gives no rows. Parameters are those of :func:`repeated_paragraphs`.
    """
    lists, least = _lists(docs, id_col=id_col, text_col=text_col, **how), how.get("min_words", 20)
    own = docs.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(text_col).alias("_text"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_paragraphs(F.col(text_col)))).cast("long").alias("_n"),
    )
    met = own.join(placed(lists, _entries("removed", "units")), F.col("_id") == F.col("_gone_id"), "left").select("_id", "_text", "_n", "removed", "units")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                removed = part.column("removed").to_pylist()
                found = _passages(part.column("_text"), removed, part.column("units").to_pylist(), least)
                removed = [r or [] for r in removed]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id"), part.column("_n"), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())),
                        pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(_SPAN)),
                    ],
                    names=[id_col, "n_paragraphs", "n_removed", "removed", "n_passages", "passages"],
                )

    return met.mapInArrow(
        tidy(written), f"`{id_col}` bigint, n_paragraphs bigint, n_removed bigint, removed array<int>, n_passages bigint, passages array<struct<begin:bigint,end:bigint>>"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with repeated paragraphs and passages taken out of the text; other columns stay.
    A line of which a passage leaves only white space goes whole."""
    lists, least = _lists(docs, id_col=id_col, text_col=text_col, **how), how.get("min_words", 20)
    lists = lists.select("_gone_id", F.col("removed").alias("_gone_lines"), F.col("units").alias("_gone_units"))
    met = docs.join(placed(lists, _entries("_gone_lines", "_gone_units")), docs[id_col].cast("bigint") == F.col("_gone_id"), "left").select(*docs.columns, "_gone_lines", "_gone_units")
    names = docs.columns
    at = names.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, units = (batch.column(len(names) + k).to_pylist() for k in (0, 1))
            found = _passages(batch.column(at), removed, units, least)
            texts = [t if not r and not f else _spared(t, r or [], f) for t, r, f in zip(batch.column(at).to_pylist(), removed, found)]
            yield pa.RecordBatch.from_arrays([batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))], names=names)

    return met.mapInArrow(tidy(cleaned), docs.schema)


def _spared(text: str, removed: list[int], passages: list[dict]) -> str:
    kept, begin = [], 0
    for p, line in enumerate(text.encode().split(b"\n")):
        end = begin + len(line)
        if p not in removed:
            hit = [(max(s["begin"], begin), min(s["end"], end)) for s in passages if s["begin"] < end and s["end"] > begin]
            rest, at = [], begin
            for a, b in hit:
                rest.append(line[at - begin : a - begin])
                at = b
            left = b"".join([*rest, line[at - begin :]])
            if not hit or left.strip():
                kept.append(left)
        begin = end + 1
    return b"\n".join(kept).decode()
