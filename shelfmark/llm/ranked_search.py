"""Ranked lexical search of a set of items over all documents, by trees of documents.

Only the terms that some item holds matter, so a document becomes its *restricted vector*: those
terms, the most frequent of the corpus first, with their counts. A task puts the vectors of a
bounded number of documents in order and shares their beginnings in a trie (a frequent-pattern
tree over documents). Every node knows the largest count of its term and the smallest length
value m among the documents below; a term weighs most at the largest count and the smallest m,
so a path of nodes bounds the score of every document under it.

Each item is searched on its own, depth first over the nodes that carry its terms: a subtree whose
best path stays below the tenth best score so far is stepped over as a whole, the documents of
the others are scored exactly. Every task hands on ten documents an item, and Spark keeps the
ten best of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from shelfmark.llm.byte_pairs import same_bytes
from shelfmark.llm.words import LOWER, hash_spans, slices, spans, text_bytes
from shelfmark.session import cut

#: Most (item, term) entries searched for at once, some 40 bytes each in every task; more items take further passes.
BLOCK_TERMS = 200_000
#: Entries (document, term) of one tree, some 100 bytes each while it is built and searched.
TREE_ENTRIES = 1_000_000

#: Bytes of terms: all but the ASCII signs below 0x30, 3A-40, 5B-60 and 7B-7F.
TERM_BYTE = np.ones(256, bool)
TERM_BYTE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False

#: The same class for column expressions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered_terms(text: str):
    """Column: the terms of a text, A-Z lower-cased; null has none."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Terms:
    """The different terms of a block of items, sorted by hash: their bytes and hashes."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Terms:
        buf, offs = text_bytes(pa.array(words, pa.string()))
        hashes = hash_spans(buf, offs[:-1], offs[1:])
        if len(np.unique(hashes)) != len(words):
            raise ValueError("two terms have one hash")
        order = np.argsort(hashes)
        return cls(buf, offs[:-1][order], offs[1:][order], hashes[order])

    def numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the term that each span holds, -1 for other words; bytes are compared."""
        if not len(self.hashes):
            return np.full(len(start), -1, np.int64)
        hashes = hash_spans(buf, start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[at] == hashes)
        out = np.full(len(start), -1, np.int64)
        held = at[maybe]
        same = same_bytes(buf, start[maybe], end[maybe], self.buf, self.start[held], self.end[held])
        out[maybe[same]] = held[same]
        return out


def restricted(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) per row of ``docs``: n counts all terms, the lists hold the wanted ones by number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                buf, offs = text_bytes(part.column(1))
                buf = LOWER[buf]
                start, end, row = spans(buf, offs, TERM_BYTE)
                n = np.bincount(row, minlength=len(part))
                number = own.numbers(buf, start, end)
                held = number >= 0
                key, tf = np.unique(row[held] * max(len(own.hashes), 1) + number[held], return_counts=True)
                rows, which = np.divmod(key, max(len(own.hashes), 1))
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(part)))])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (which.astype(np.int32), tf.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), *lists], names=["id", "n", "terms", "tf"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n bigint, terms array<int>, tf array<bigint>")


def _value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term gives before its weight; grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class DocumentTree:
    """The trie of a bounded number of restricted vectors, as arrays over its nodes in preorder.

    ``place`` of a document is its place among the sorted vectors; a node covers the places from
    ``begin`` to ``stop`` (exclusive). ``nodes_of`` lists the nodes of a term.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, offs: np.ndarray, rank: np.ndarray, tf: np.ndarray):
        """``ids`` are numbers in the order of the ids; ``rank`` (0: most frequent) ascends in each vector."""
        size = np.diff(offs)
        code = rank.astype(">u4").tobytes()
        order = np.array(sorted(range(len(ids)), key=lambda d: code[4 * offs[d] : 4 * offs[d + 1]]), np.int64)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size[order]) - size[order] - offs[:-1][order], size[order])
        self.ids, self.m, size = ids[order], m[order], size[order]
        self.rank, self.tf = rank[at], tf[at]
        self.offs = np.concatenate([[0], np.cumsum(size)])
        doc = np.repeat(np.arange(len(ids)), size)
        depth = np.arange(len(at)) - self.offs[doc]
        # an entry makes a node unless the document before has the same beginning up to it
        same = np.zeros(len(at), bool)
        back = (doc > 0) & (depth < np.concatenate([[0], size[:-1]])[doc])
        same[back] = self.rank[back] == self.rank[(self.offs[doc - 1] + depth)[back]]
        broken = np.where(same, len(at), np.arange(len(at)))
        first_break = np.minimum.reduceat(broken, self.offs[:-1][size > 0]) if len(at) else np.zeros(0, np.int64)
        shared = np.zeros(len(ids), np.int64)
        shared[size > 0] = np.minimum(first_break, self.offs[1:][size > 0]) - self.offs[:-1][size > 0]
        made = np.flatnonzero(depth >= shared[doc])
        self.begin, node_depth, self.term = doc[made], depth[made], self.rank[made]
        n = len(made)
        self.stop, self.most_tf, self.least_m = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        # level by level: the documents that reach a depth lie in runs, one run a node
        by_depth = np.argsort(node_depth, kind="stable")
        level_ends = np.cumsum(np.bincount(node_depth)) if n else np.zeros(0, np.int64)
        reach = np.arange(len(ids))
        for d, (a, b) in enumerate(zip(np.concatenate([[0], level_ends[:-1]]) if n else [], level_ends)):
            reach = reach[size[reach] > d]
            nodes = by_depth[a:b]
            runs = np.searchsorted(reach, self.begin[nodes])
            last = np.concatenate([runs[1:], [len(reach)]]) - 1
            self.stop[nodes] = reach[last] + 1
            self.most_tf[nodes] = np.maximum.reduceat(self.tf[self.offs[reach] + d], runs)
            self.least_m[nodes] = np.minimum.reduceat(self.m[reach], runs)
        by_term = np.argsort(self.term, kind="stable")
        terms, first = np.unique(self.term[by_term], return_index=True)
        self.nodes_of = dict(zip(terms.tolist(), np.split(by_term, first[1:])))

    def scores(self, a: int, b: int, weight: np.ndarray) -> np.ndarray:
        """Exact scores of the documents at places a to b."""
        lo, hi = self.offs[a], self.offs[b]
        doc = np.repeat(np.arange(b - a), np.diff(self.offs[a : b + 1]))
        w = weight[self.rank[lo:hi]]
        own = np.flatnonzero(w)
        out = np.zeros(b - a, np.int64)
        np.add.at(out, doc[own], w[own] * _value(self.tf[lo:hi][own], self.m[a + doc[own]]))
        return out

    def search(self, ranks: np.ndarray, weights: np.ndarray, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``k`` best documents with a score above 0, equal scores by id.

        ``weight`` is a table of zeros over all ranks, put back after use.
        """
        lists = [self.nodes_of[r] for r in ranks.tolist() if r in self.nodes_of]
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not lists:
            return best, scores
        weight[ranks] = weights
        node = np.sort(np.concatenate(lists))  # in preorder: below a node come the nodes under it
        own = weight[self.term[node]] * _value(self.most_tf[node], self.least_m[node])
        begin, stop = self.begin[node], self.stop[node]
        # preorder, a node's subtree is a run: by places, and for equal places by depth
        after = self._after(begin, stop)
        change = np.zeros(len(node) + 1, np.int64)
        change[:-1] += own
        np.subtract.at(change, after, own)
        path = np.cumsum(change[:-1])  # bound of the documents whose last wanted node this is
        below = _range_max(path, after)  # bound of all documents under the node
        floor = 0

        def take(a: int, b: int) -> None:
            nonlocal best, scores, floor
            if a >= b:
                return
            found = self.scores(a, b, weight)
            good = np.flatnonzero((found > 0) & (found >= floor))
            if len(good):
                places, values = np.concatenate([best, a + good]), np.concatenate([scores, found[good]])
                kept = np.lexsort((self.ids[places], -values))[:k]
                best, scores = places[kept], values[kept]
                floor = int(scores[-1]) if len(scores) == k else 0

        # the documents of the best paths first, for a high floor from the start
        visited = set()
        for i in np.argsort(-path, kind="stable")[:k].tolist():
            visited.add(i)
            self._own(i, begin, stop, after, take)
        i, n = 0, len(node)
        after_list, below_list, path_list = after.tolist(), below.tolist(), path.tolist()
        while i < n:
            if below_list[i] < floor:
                i = after_list[i]  # no document under this node can enter: on to the next subtree
                continue
            if path_list[i] >= floor and i not in visited:
                self._own(i, begin, stop, after, take)
            i += 1
        weight[ranks] = 0
        return best, scores

    @staticmethod
    def _after(begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For nodes in preorder, the first node behind the subtree of each."""
        return np.searchsorted(begin, stop, "left")

    @staticmethod
    def _own(i: int, begin: np.ndarray, stop: np.ndarray, after: np.ndarray, take) -> None:
        """Hand over the documents under node i that are under none of its children."""
        at, child = int(begin[i]), i + 1
        while child < after[i]:
            take(at, int(begin[child]))
            at, child = int(stop[child]), int(after[child])
        take(at, int(stop[i]))


def _range_max(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each i the largest of values[i : after[i]], by maxima over runs of powers of two."""
    size = after - np.arange(len(values))
    level = np.frexp(size.astype(np.float64))[1] - 1  # largest power of two within the run
    out, maxima = np.empty_like(values), values
    for j in range(int(level.max()) + 1 if len(values) else 0):
        if j:
            half = 1 << (j - 1)
            maxima = np.maximum(maxima, np.concatenate([maxima[half:], maxima[len(maxima) - half :]])) if len(maxima) > half else maxima
        at = np.flatnonzero(level == j)
        out[at] = np.maximum(maxima[at], maxima[after[at] - (1 << j)])
    return out


@dataclass(frozen=True)
class Block:
    """What a task needs for a block of items: per term its rank by frequency, and per item ranks and weights."""

    rank_of: np.ndarray
    offs: np.ndarray
    ranks: np.ndarray
    weights: np.ndarray


def _best_of_trees(vectors: DataFrame, block: Block, n_docs: int, n_terms: int, k: int, id_type: str) -> DataFrame:
    """(item, id, score): for each item the ``k`` best documents of each tree."""
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weight = np.zeros(len(own.rank_of), np.int64)

        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("id").combine_chunks()
            order = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)
            n = table.column("n").to_numpy()
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            terms, tfs = table.column("terms").combine_chunks(), table.column("tf").combine_chunks()
            offs = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())]).astype(np.int64)
            rank, tf = own.rank_of[terms.flatten().to_numpy()], tfs.flatten().to_numpy()
            by_rank = np.lexsort((rank, np.repeat(np.arange(len(n)), np.diff(offs))))
            # the row a place stands for is kept next to the order of its id
            tree = DocumentTree(order * len(n) + np.arange(len(n)), m, offs, rank[by_rank], tf[by_rank])
            items, rows, scores = [], [], []
            for i in range(len(own.offs) - 1):
                part = slice(own.offs[i], own.offs[i + 1])
                places, values = tree.search(own.ranks[part], own.weights[part], k, weight)
                items.append(np.full(len(places), i, np.int64))
                rows.append(tree.ids[places] % len(n))
                scores.append(values)
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), ids.take(pa.array(rows)), pa.array(np.concatenate(scores))], names=["item", "id", "score"])

        held, entries = [], 0
        for batch in batches:
            step = max(1, len(batch) * TREE_ENTRIES // max(TREE_ENTRIES, len(batch.column("terms").flatten())))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                size = len(part.column("terms").flatten())
                if held and entries + size > TREE_ENTRIES:
                    yield from found(held)
                    held, entries = [], 0
                held.append(part)
                entries += size
        if held:
            yield from found(held)

    return vectors.where(F.size("terms") > 0).mapInArrow(run, f"item bigint, id {id_type}, score bigint")


def _blocks(pairs: DataFrame) -> Iterator[list]:
    """The rows (item, term) in order of items, in lists of at most BLOCK_TERMS rows or one item."""
    rows, item = [], []
    for row in pairs.orderBy("item", "term").toLocalIterator():
        if item and row["item"] != item[0]["item"]:
            if rows and len(rows) + len(item) > BLOCK_TERMS:
                yield rows
                rows = []
            rows += item
            item = []
        item.append(row)
    if rows and len(rows) + len(item) > BLOCK_TERMS:
        yield rows
        rows = []
    if rows + item:
        yield rows + item


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item, rank, id, score): for every item the ``k`` documents of highest score above 0, equal scores by id.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document's score sums over the item's
    different terms weight * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L, with N documents that
    hold a term, L terms in all, n terms of the document; all but the logarithm is in 64-bit integers.

    Null and empty texts have no terms: such documents are never found and not counted, such items find
    nothing. Rows of one item id are one item with the terms of all of them; a null id is an item too.
    Every row of ``docs`` is a document: repeated rows are found side by side, a null id comes after all others. Other
    columns are ignored. An empty table on either side gives no rows.

    Items are taken in blocks of a bounded number of terms, which every task holds. For a block all
    documents are read once; their vectors are written to the checkpoint folder, so that counting
    and searching see the same rows. A tree holds a bounded number of entries, at least one document.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    terms_of = items.select(F.col(item_col).alias("item_id"), F.explode(lowered_terms(item_text)).alias("term")).distinct()
    named = cut(terms_of.groupBy("item_id").agg(F.collect_set("term").alias("terms")).withColumn("item", F.monotonically_increasing_id()))
    names = named.select("item", "item_id")
    found = None
    for rows in _blocks(named.select("item", F.explode("terms").alias("term"))):
        part = _search_block(docs, rows, k, id_col, text_col, id_type)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item bigint, id {id_type}, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(names, "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(docs: DataFrame, rows: list, k: int, id_col: str, text_col: str, id_type: str) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({r["term"] for r in rows})
    terms = Terms.of(words)
    # numbers of terms follow their hashes
    number = dict(zip(words, terms.numbers(*_spans_of(words)).tolist()))
    vectors = cut(restricted(docs, terms, id_col, text_col))
    total = vectors.where(F.col("n") > 0).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(words), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    order = np.lexsort((np.arange(len(words)), -df))
    rank_of = np.empty(len(words), np.int64)
    rank_of[order] = np.arange(len(words))
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    ids, offs, ranks = [], [0], []
    for r in rows:
        if not ids or ids[-1] != r["item"]:
            ids.append(r["item"])
            offs.append(offs[-1])
        ranks.append(number[r["term"]])
        offs[-1] += 1
    ranks = np.array(ranks, np.int64)
    block = Block(rank_of, np.array(offs, np.int64), rank_of[ranks], weight[ranks])
    best = _best_of_trees(vectors, block, total["docs"], max(total["terms"], 1), k, id_type)
    own = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "at bigint, _item bigint")
    return best.withColumnRenamed("item", "at").join(F.broadcast(own), "at").select(F.col("_item").alias("item"), "id", "score")


def _spans_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = text_bytes(pa.array(words, pa.string()))
    return buf, offs[:-1], offs[1:]
