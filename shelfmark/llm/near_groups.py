"""Groups of texts whose shingle sets reach a Jaccard similarity, without pairs being written.

1. A pass over the texts makes the shingle set of each and, from it, keys: texts that are
   similar enough share a key. Equal sets inside a task stand for one another, and a key that
   comes up again in a task leaves only a link there. So a group of copies, or a key in a third
   of all texts, sends one row per task.
2. Rows of a key meet in one shuffle; each text is linked to the smallest one of the key.
3. Components of these links hold all possible partners. Only texts in them are read again.
   Components are dealt out in cells of bounded weight and each cell is joined exactly by
   :mod:`shelfmark.llm.signature_tree`, or by :mod:`shelfmark.llm.band_links` where sharing a
   band is part of being linked. A component of more than one cell shares a few pivot
   texts among its cells, and what is still apart then meets in cells of two parts each; parts
   of one found group do not meet again.
4. Components of the verified links are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.band_links import banded
from shelfmark.llm.signature_tree import linked
from shelfmark.llm.words import SLICE_BYTES, mix, shingle_sets, slices, tidy
from shelfmark.operators.components import connected_components
from shelfmark.operators.keys import lookup_join
from shelfmark.session import cut, width

#: Shingles in one cell; a heavier component is split.
CELL_WEIGHT = 1_000_000
#: Shingles that a smaller set counts for where bands of minimum hashes bring unlike sets together.
SET_WEIGHT = 40
#: The same where only sets that share a band are compared.
BAND_WEIGHT = 10
#: Pivots that all cells of a split component share.
PIVOTS = 4
#: Keys that a task holds before it writes them out.
HELD_KEYS = 1_000_000
#: Buckets of keys a task, and rows packed together at most.
BUCKETS, PACK_ROWS = 4, 1000
#: Most members sent by broadcast to pick their texts; beyond, the texts are shuffled by id.
BROADCAST_ROWS = 500_000

#: (keys, offsets) of the sets of many rows -> (key, row) of each signature.
Signatures = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Similarity:
    """Jaccard of sets of ``width``-word shingles: den * intersection >= num * union."""

    width: int
    num: int
    den: int


def _class_hash(keys: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, together with its size an identity of 128 bits and more."""
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out = []
    for seed in (0x1234567F, 0x7E57ED):
        acc = np.zeros(len(offs) - 1, np.uint64)
        np.add.at(acc, rows, mix(keys ^ np.uint64(seed)))
        out.append(mix(acc + np.diff(offs).astype(np.uint64)))
    return out[0], out[1]


_DOC, _KEY, _LINK = 0, 1, 2
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _pack(cols: tuple[np.ndarray, ...]) -> bytes:
    """Columns of 64-bit numbers as bytes; a column that ascends takes a byte or two a number."""
    steps = np.stack([np.diff(c.view(np.int64), prepend=np.int64(0)) for c in cols])
    return len(cols[0]).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n_cols: int) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n * n_cols * 8, "zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).reshape(n_cols, n)
    return tuple(np.cumsum(c) for c in steps)


def _packed(kind: int, bucket: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, at most ``PACK_ROWS`` together; rows of a bucket come one after the other."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(bucket)]):
        for at in range(lo, hi, PACK_ROWS):
            to = min(at + PACK_ROWS, hi)
            rows.append((int(bucket[at]), kind, _pack(tuple(c[at:to] for c in cols))))
    for at in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 1000]), _PACKED)], schema=_PACKED)


def _signed(sim: Similarity, signatures: Signatures, buckets: int):
    """Texts and the keys of their sets; a set that comes up again before the keys are written has none."""

    def written(classes: dict, ids: list, of_class: list, sizes: list, keys: list, key_class: list) -> Iterator[pa.RecordBatch]:
        ids, of_class, sizes = np.concatenate(ids), np.concatenate(of_class), np.concatenate(sizes)
        rep = np.full(len(classes) + 1, np.iinfo(np.int64).max)
        np.minimum.at(rep, of_class, ids)
        node = np.where(of_class < 0, ids, rep[of_class])
        head = np.array([h for _, h, _ in classes], np.uint64)
        any_bucket = int(mix(ids[:1].astype(np.uint64))[0] % np.uint64(buckets))
        order = np.argsort(ids, kind="stable")
        yield from _packed(_DOC, np.full(len(ids), any_bucket), ids[order], node[order], sizes[order].astype(np.int64))
        all_keys = np.concatenate([head, *keys]) if len(head) else np.zeros(0, np.uint64)
        holders = rep[np.concatenate([np.arange(len(head)), *key_class])] if len(head) else np.zeros(0, np.int64)
        own, holder, link = _by_key(all_keys, holders)
        order = np.argsort(holder, kind="stable")
        bucket = ((own >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        yield from _packed(_KEY, bucket[order].astype(np.int64), holder[order], own[order])
        if link.shape[1]:
            yield from _packed(_LINK, np.full(link.shape[1], any_bucket), link[0], link[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, int, int], int] = {}
        ids, of_class, sizes, keys, key_class, held = [], [], [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                sets, offs = shingle_sets(part.column("text"), sim.width)
                n = np.diff(offs)
                h1, h2 = _class_hash(sets, offs)
                start, mine = len(classes), np.empty(len(n), np.int64)
                for i, c in enumerate(zip(n.tolist(), h1.tolist(), h2.tolist())):
                    mine[i] = classes.setdefault(c, len(classes)) if c[0] else -1
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                of_class.append(mine)
                sizes.append(n)
                held += len(n)
                fresh = np.zeros(len(n), bool)
                found, first = np.unique(mine, return_index=True)
                fresh[first[found >= start]] = True
                if fresh.any():
                    take = np.repeat(fresh, n)
                    key, row = signatures(sets[take], np.concatenate([[0], np.cumsum(n[fresh])]))
                    keys.append(key)
                    key_class.append(mine[fresh][row])
                    held += len(key)
                if held >= HELD_KEYS:
                    yield from written(classes, ids, of_class, sizes, keys, key_class)
                    classes, held = {}, 0
                    ids, of_class, sizes, keys, key_class = [], [], [], [], []
        if ids:
            yield from written(classes, ids, of_class, sizes, keys, key_class)

    return run


def _by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, smallest id of each, different links (id, smallest id of its key))."""
    if not len(keys):
        return keys, ids, np.zeros((2, 0), np.int64)
    order = np.argsort(keys)
    k, own = keys[order], ids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    least = np.minimum.reduceat(own, start)
    to = np.repeat(least, np.diff(np.append(start, len(k))))
    far = own != to
    a, b = own[far], to[far]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return k[start], least, np.stack([a[new], b[new]])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed texts and links; the rows of a bucket of keys come one after the other and leave links."""
    current, held = -1, []

    def links() -> Iterator[pa.RecordBatch]:
        ids, keys = (np.concatenate(c) for c in zip(*held))
        link = _by_key(keys.view(np.uint64), ids)[2]
        if link.shape[1]:
            yield from _packed(_LINK, np.full(link.shape[1], current), link[0], link[1])

    for batch in batches:
        waits = batch.column("kind").to_numpy() == _KEY
        if not waits.all():
            yield batch.filter(pa.array(~waits))
        for i in np.flatnonzero(waits).tolist():
            bucket = batch.column("bucket")[i].as_py()
            if bucket != current and held:
                yield from links()
                held = []
            current = bucket
            held.append(_unpack(batch.column("data")[i].as_py(), 2))
    if held:
        yield from links()


def _spread(n_cols: int, names: list[str]):
    """Packed rows one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpack(data.as_py(), n_cols)], names=names)

    return run


def candidate_links(items: DataFrame, sim: Similarity, signatures: Signatures) -> tuple[DataFrame, DataFrame]:
    """(texts, links) of ``items`` (id, text): texts (id, node, n), where node is an id with the
    same set, and links (a, b) between nodes such that similar nodes are connected.

    Keys are most rows by far. They travel in packed lists by bucket of the key, several buckets
    a task, and a task holds the keys of one bucket at a time."""
    tasks = width(items.sparkSession)
    schema = "bucket int, kind int, data binary"
    signed = items.select("id", "text").mapInArrow(tidy(_signed(sim, signatures, tasks * BUCKETS)), schema)
    dealt = signed.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    met = cut(dealt.mapInArrow(tidy(_met), schema))
    texts = met.where(F.col("kind") == _DOC).mapInArrow(tidy(_spread(3, ["id", "node", "n"])), "id bigint, node bigint, n bigint")
    links = met.where(F.col("kind") == _LINK).mapInArrow(tidy(_spread(2, ["a", "b"])), "a bigint, b bigint").distinct()
    return texts, links


def _verified(sim: Similarity, with_groups: bool, bands: Signatures | None):
    """Links (a, b) found inside each cell; rows of a cell come one after the other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = batch.column("cell").to_numpy()
        ids = batch.column("id").to_numpy()
        groups = batch.column("comp").to_numpy() if with_groups else None
        sets, offs = shingle_sets(batch.column("text"), sim.width)
        if bands is not None:
            found = [ids[np.stack(pair)] for pair in banded(sets, offs, cell, bands, sim.num, sim.den, groups)]
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        pairs = []
        for lo, hi in zip(edge, [*edge[1:], len(cell)]):
            own = None if groups is None else groups[lo:hi]
            pairs += [(ids[lo + i], ids[lo + j]) for i, j in linked(sets, offs[lo : hi + 1], sim.num, sim.den, own)]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                cell = part.column("cell").to_numpy()
                held.append(part)
                size += part.nbytes
                last = np.flatnonzero(cell != cell[-1])
                whole = held[:-1] if not len(last) else [*held[:-1], part.slice(0, int(last[-1]) + 1)]
                if size > SLICE_BYTES and (len(last) or (len(held) > 1 and held[-2].column("cell")[-1].as_py() != cell[0])):
                    yield solve(pa.concat_batches(whole))
                    held = [part] if not len(last) else [part.slice(int(last[-1]) + 1)]
                    size = held[0].nbytes
        if held:
            yield solve(pa.concat_batches(held))

    return run


def _verify(items: DataFrame, placed: DataFrame, sim: Similarity, bands: Signatures | None, with_groups: bool = False) -> DataFrame:
    """Links (a, b) between members that share a cell; ``placed`` (id, cell) or (id, cell, comp)."""
    texts = _pick(items, placed)
    cols = ["cell", "id", "text", *(["comp"] if with_groups else [])]
    dealt = texts.select(*cols).repartition("cell").sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(tidy(_verified(sim, with_groups, bands)), "a bigint, b bigint")


def _pick(items: DataFrame, placed: DataFrame) -> DataFrame:
    small = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return items.join(F.broadcast(placed) if small else placed.hint("shuffle_merge"), "id")


def _parts(weight: str) -> Column:
    return F.greatest(F.ceil(F.col(weight) / CELL_WEIGHT), F.lit(1)).cast("int")


def similar_groups(items: DataFrame, sim: Similarity, signatures: Signatures, set_weight: int = 1) -> DataFrame:
    """(id, n, component) per row of ``items`` (id bigint not null, text): set size and smallest
    id that links reach. A text without shingles is alone. Rows that share an id are one node.

    A set weighs its shingles in a cell, ``set_weight`` at least."""
    texts, found = _linked_nodes(items, sim, signatures, set_weight, None)
    return (
        texts.join(found.select(F.col("id").alias("node"), "component"), "node", "left")
        .select("id", "n", F.coalesce("component", "node").alias("component"))
    )


def later_members(items: DataFrame, sim: Similarity, bands: Signatures) -> DataFrame:
    """(id, component) of the ``items`` (id, text) that an item of a smaller id stands for.

    Two sets link if they share a key of ``bands`` and reach the similarity."""
    texts, found = _linked_nodes(items, sim, bands, BAND_WEIGHT, bands)
    found = cut(found)
    copies = texts.where(F.col("id") != F.col("node")).join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    both = copies.select("id", F.coalesce("component", "node").alias("component")).unionByName(found)
    return both.where(F.col("id") != F.col("component")).distinct()


def _linked_nodes(items: DataFrame, sim: Similarity, signatures: Signatures, set_weight: int, bands: Signatures | None) -> tuple[DataFrame, DataFrame]:
    """(texts of :func:`candidate_links`, components (id, component) of the nodes with a link)."""
    texts, links = candidate_links(items, sim, signatures)
    size_of = texts.where(F.col("id") == F.col("node")).groupBy(F.col("id").alias("size_id")).agg(F.max("n").alias("n"))
    wide = cut(connected_components(links))
    members = wide.join(size_of, F.col("id") == F.col("size_id")).select("id", F.col("component").alias("wide"), F.greatest("n", F.lit(set_weight)).alias("n"))
    spread = F.xxhash64("id")
    pivot = [F.min(F.struct(F.xxhash64(F.lit(p), "id").alias("h"), "id"))["id"].alias(f"p{p}") for p in range(PIVOTS)]
    weights = cut(members.groupBy("wide").agg(F.sum("n").alias("weight"), F.count("*").alias("size"), *pivot))
    dealt = lookup_join(members, weights.withColumn("parts", _parts("weight")), "wide", ["parts"], "size", spread)
    dealt = cut(dealt)
    split = weights.where(F.col("weight") > CELL_WEIGHT)
    pivots = (
        split.select("wide", _parts("weight").alias("parts"), F.explode(F.array_distinct(F.array(*[f"p{p}" for p in range(PIVOTS)]))).alias("id"))
        .select("id", "wide", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    placed = (
        dealt.select("id", "wide", F.pmod(spread, F.col("parts")).cast("int").alias("part")).unionByName(pivots)
        .select("id", F.xxhash64("wide", "part").alias("cell")).distinct()
    )
    sure = cut(_verify(items, cut(placed), sim, bands))
    if not split.isEmpty():
        sure = cut(sure.unionByName(_across(items, dealt.where(F.col("parts") > 1), sure, sim, bands)))
    return texts, connected_components(sure)


def _across(items: DataFrame, members: DataFrame, sure: DataFrame, sim: Similarity, bands: Signatures | None) -> DataFrame:
    """Links between the groups found so far inside each split component."""
    found = connected_components(sure)
    grouped = cut(
        members.join(found.select(F.col("id").alias("fid"), "component"), F.col("id") == F.col("fid"), "left")
        .select("id", "wide", "n", F.coalesce("component", "id").alias("comp"))
    )
    groups = grouped.groupBy("wide", "comp").agg(F.sum("n").alias("w"))
    large = F.col("w") * 2 > CELL_WEIGHT
    rest = groups.where(~large).groupBy("wide").agg(F.sum("w").alias("rest"))
    per = cut(groups.join(rest, "wide", "left").select(
        "wide", "comp", F.when(large, F.col("comp")).alias("big"),
        F.when(large, _parts("w")).otherwise(_parts("rest")).alias("parts"),
    ))
    sizes = grouped.groupBy("comp").agg(F.count("*").alias("size"))
    plan = per.join(sizes, "comp")
    slot = F.when(F.col("big").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("comp"), F.col("parts")))
    placed = cut(
        lookup_join(grouped, plan.select("comp", "big", "parts", "size"), "comp", ["big", "parts"], "size", F.xxhash64("id"))
        .select("id", "wide", "comp", "big", F.xxhash64("wide", F.coalesce("big", F.lit(-1)), slot).alias("unit"))
    )
    units = cut(placed.groupBy("wide", "unit").agg(F.max("big").alias("big")))
    other = units.select(F.col("wide").alias("wide_b"), F.col("unit").alias("unit_b"), F.col("big").alias("big_b"))
    pairs = units.join(other, (F.col("wide") == F.col("wide_b")) & (F.col("unit") <= F.col("unit_b"))).where(
        F.col("big").isNull() | F.col("big_b").isNull() | (F.col("big") != F.col("big_b"))
    )
    cells = pairs.select(F.xxhash64("unit", "unit_b").alias("cell"), F.explode(F.array_distinct(F.array("unit", "unit_b"))).alias("unit"))
    sided = placed.select("id", "comp", "unit").join(cells, "unit").select("id", "cell", "comp")
    return _verify(items, cut(sided), sim, bands, with_groups=True)
