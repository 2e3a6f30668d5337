"""The prefix trie of conversations as a table of its nodes.

A turn becomes an id of a fixed number of big-endian bytes: the MD5 of role and text, then the
number of words of the text. A conversation is the string of its ids. Tasks put such strings into
adaptive radix trees of a bounded number of bytes. A tree branches at any byte and keeps
unbranched stretches as one path, but only at byte depths that are whole turns does it give a
node, also inside a compressed path. A node is known everywhere by a digest of its turns, so the
nodes of all trees add up: a first turn that a third of all conversations share leaves each tree
as one row.

Sums over the distinct nodes of a subtree add up over conversations as well: each node belongs to
its smallest member, whose nodes are the lower end of its path, and a second pass counts them there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.llm.radix_tree import Node, RadixTree
from shelfmark.operators.keys import lookup_join
from shelfmark.session import cut

#: Bytes of a turn id: 16 of the digest, 4 of the number of words.
ID = 20
WORD = r"[^\x20\x09-\x0D]+"
#: Key bytes of one tree; its nodes take some twenty times as much.
TREE_BYTES = 4 << 20
#: Ids of one node that agree in all but so many bits are joined to one text.
CHUNK_BITS = 12

ROOT = hashlib.md5(b"").digest()


def turn_id(role: Column, text: Column) -> Column:
    """The fixed-width id of a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(WORD))
    return F.unhex(F.concat(digest, F.lpad(F.hex(words.cast("bigint")), 8, "0")))


def heads_of(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one its head comes from (0 to 3)."""
    return (F.crc32(conv_id.cast("string")) % 4).cast("int")


def rebuilt_paths(turns: DataFrame, group: int = 20) -> DataFrame:
    """(conv_id, path): every conversation as the ids of its rebuilt turns, in one byte string."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "id")
    own = (
        turns.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), turn_id(F.col("role"), F.col("text")).alias("id"))
        .withColumn("pos", F.row_number().over(order))
    )
    own = cut(own.select("conv_id", "pos", "id"))
    base = F.col("conv_id") - F.col("conv_id") % group
    # at most 2 * group conversations take their head from one
    heads = own.where((F.col("conv_id") % group == 0) & (F.col("pos") <= 3)).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("at"), "id"
    )
    wanted = own.where(F.col("pos") == 1).select("conv_id", base.alias("base"))
    taken = wanted.join(heads, "base").where(F.col("at") <= heads_of(F.col("conv_id"))).select(
        "conv_id", F.col("at").alias("pos"), "id"
    )
    # the first row stays, if need be without its id, so that conversations without turns are there too
    later = F.col("pos") > heads_of(F.col("conv_id"))
    rest = own.where(later | (F.col("pos") == 1)).withColumn("id", F.when(later, F.col("id")))
    placed = rest.unionByName(taken).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []  # the conversation that the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            conv = batch.column("conv_id").to_numpy()
            ids = batch.column("id").cast(pa.large_binary())
            data = memoryview(ids.buffers()[2] or b"")
            offs = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            ends = np.concatenate([first[1:], [len(conv)]])
            names, found = [], []
            for a, b in zip(first.tolist(), ends.tolist()):
                if last is not None and conv[a] != last:
                    names.append(last)
                    found.append(b"".join(parts))
                    parts = []
                last = int(conv[a])
                parts.append(bytes(data[offs[a] : offs[b]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], names=["conv_id", "path"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["conv_id", "path"])

    return placed.mapInArrow(paths, "conv_id bigint, path binary")


def _walk(tree: RadixTree, enter: Callable, leave: Callable) -> None:
    """Visit the nodes at whole turns, ``enter(parent digest, turn id) -> digest`` downwards and
    ``leave(node, turn ends, digest above)`` upwards, where turn ends are the (digest, turn id) inside
    the path of the node from the top down. Without recursion, since a path may have many turns."""
    stack: list[tuple] = [(tree.root, ROOT, b"", None, iter(tree.root.items()))]
    while stack:
        node, digest, open_bytes, turns, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            leave(node, turns, stack[-1][0] if stack else None)
            continue
        text, made = open_bytes + child.path, []
        at, whole = 0, len(text) - len(text) % ID
        below = digest
        while at < whole:
            below_next = enter(below, text[at : at + ID])
            made.append((below_next, below, text[at : at + ID]))
            below, at = below_next, at + ID
        stack.append((child, below, text[whole:], made, iter(child.items())))


def _digest(above: bytes, turn: bytes) -> bytes:
    return hashlib.md5(above + turn).digest()


class _Rows:
    """Columns of output rows."""

    def __init__(self, fields: list[tuple[str, pa.DataType]]):
        self.schema = pa.schema(fields)
        self.columns: list[list] = [[] for _ in fields]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)


def _trees(batches: Iterator[pa.RecordBatch], new: Callable, add: Callable, emit: Callable) -> Iterator[pa.RecordBatch]:
    """Fill trees of a bounded number of bytes with the paths of the batches; ``emit`` gives their rows."""
    tree, held = RadixTree(new), 0
    for batch in batches:
        paths = batch.column("path")
        others = [batch.column(c).to_pylist() for c in batch.schema.names if c != "path"]
        for i, row in enumerate(zip(*others)):
            path = paths[i].as_py() or b""
            add(tree.insert(path), *row)
            held += len(path) + ID
            if held >= TREE_BYTES:
                yield from emit(tree)
                tree, held = RadixTree(new), 0
    if held:
        yield from emit(tree)


_NONE = (1 << 63) - 1


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: nodes with members and their words, and for each conversation the node it ends at."""

    def emit(tree: RadixTree) -> Iterator[pa.RecordBatch]:
        rows = _Rows([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])
        sums: dict[int, list[int]] = {id(tree.root): [_NONE, 0, 0]}  # of the members below: smallest, number, words
        depth = {ROOT: 0}

        def enter(above: bytes, turn: bytes) -> bytes:
            own = _digest(above, turn)
            depth[own] = depth[above] + 1
            return own

        def leave(node: Node, turns: list | None, above: Node | None) -> None:
            least, n, total = sums.pop(id(node), (_NONE, 0, 0))
            if node.value is not None:
                least, n = min(least, min(node.value)), n + len(node.value)
                end = turns[-1][0] if turns else ROOT
                for c in node.value:
                    rows.add(end, None, -1, c, 0, 0)
            if above is None:
                rows.add(ROOT, None, 0, least, n, total)
                return
            for own, parent, turn in reversed(turns):
                total += n * int.from_bytes(turn[16:], "big")
                rows.add(own, parent, depth.pop(own), least, n, total)
            up = sums.setdefault(id(above), [_NONE, 0, 0])
            up[0], up[1], up[2] = min(up[0], least), up[1] + n, up[2] + total

        _walk(tree, enter, leave)
        yield from rows.batches()

    return _trees(batches, list, lambda members, conv_id: members.append(conv_id), emit)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: leaves, and words of distinct nodes, in the subtree of each node.

    ``top`` is the depth at which the nodes of a conversation begin, ``leaf`` 1 if its last has no child."""

    def emit(tree: RadixTree) -> Iterator[pa.RecordBatch]:
        rows = _Rows([("node", pa.binary()), ("leaves", pa.int64()), ("once", pa.int64())])
        sums: dict[int, list[int]] = {}
        depth = {ROOT: 0}

        def enter(above: bytes, turn: bytes) -> bytes:
            own = _digest(above, turn)
            depth[own] = depth[above] + 1
            return own

        def leave(node: Node, turns: list | None, above: Node | None) -> None:
            top, leaves, once = sums.pop(id(node), (_NONE, 0, 0))
            if node.value is not None:
                top, leaves = min(top, node.value[0]), leaves + node.value[1]
            if above is None:
                rows.add(ROOT, leaves, once)
                return
            for own, _, turn in reversed(turns):
                if top <= depth.pop(own):  # the smallest member of all is in this tree
                    once += int.from_bytes(turn[16:], "big")
                rows.add(own, leaves, once)
            up = sums.setdefault(id(above), [_NONE, 0, 0])
            up[0], up[1], up[2] = min(up[0], top), up[1] + leaves, up[2] + once

        _walk(tree, enter, leave)
        yield from rows.batches()

    def add(held: list, top: int, leaf: int) -> None:
        held[0], held[1] = min(held[0], top), held[1] + leaf

    return _trees(batches, lambda: [_NONE, 0], add, emit)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids that end at each node, ascending, joined by commas.

    Ids are joined in pieces first, over the cluster; a digest then reads the pieces of its node
    in order, one at a time.
    """
    pieces = (
        ends.groupBy("node", F.shiftright("conv_id", CHUNK_BITS).alias("piece"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("node", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows([("node", pa.binary()), ("ends_sha256", pa.string())])
        last, held = None, None
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                if node != last:
                    if held is not None:
                        rows.add(last, held.hexdigest())
                    last, held = node, hashlib.sha256(text.encode())
                else:
                    held.update(b"," + text.encode())
            yield from rows.batches()
            rows.columns = [[], []]
        if held is not None:
            rows.add(last, held.hexdigest())
            yield from rows.batches()

    placed = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "text")
    return placed.mapInArrow(digests, "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, group: int = 20) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    Turns stand in the order of ``turn``, null first; turns of one number in the order of role, then of their
    id. Null role or text is empty, an empty text has no words. Repeated rows are turns of their own. Rows
    without ``conv_id`` belong to no conversation. Other columns are ignored; an empty table
    gives no node. Turns are told apart by 128 bits of digest. The remainder of a negative ``conv_id`` is
    negative, as in SQL, so its head comes from the next multiple above.

    A conversation's path (20 bytes a turn) is one key in one task, as is the list of a node's ends while
    it is hashed, piece by piece; all else is combined before it is shuffled.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    paths = cut(rebuilt_paths(turns, group))
    made = cut(
        paths.mapInArrow(_members, "node binary, parent binary, depth bigint, conv_id bigint, n bigint, total bigint")
    )
    merged = cut(
        made.where(F.col("depth") >= 0).groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n_convs"), F.sum("total").alias("total"),
        )
    )
    kids = merged.where(F.col("depth") > 0).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut(merged.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf")
    )
    marked = paths.join(own, "conv_id", "left").select(
        "path", F.coalesce("top", F.lit(_NONE)).alias("top"), F.coalesce("leaf", F.lit(0)).cast("bigint").alias("leaf")
    )
    owned = marked.mapInArrow(_owned, "node binary, leaves bigint, once bigint").groupBy("node").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("once").alias("once")
    )
    ends = _end_digests(made.where(F.col("depth") < 0).select("node", "conv_id"))
    whole = nodes.join(owned, "node").join(ends, "node", "left")
    above = nodes.where(F.col("n_children") > 0).select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    found = lookup_join(whole, above, "parent", ["parent_conv_id"], "n_children", F.xxhash64("node"), how="left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("total") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
