"""Toxic documents and the sentences that make them so, learned from document labels.

Multiple-instance learning: a document is a bag of sentences, each with a chance from a linear
model, and the document's chance is their noisy-or, 1 - prod(1 - p). Only documents are
labelled; the gradient of the noisy-or tells which sentences must have been meant. The features
of a sentence are its words and the first four, five and six bytes of them.

The model is fitted on a bounded sample of labelled rows (``most_labels``, chosen by a hash of
the id); every text is scored whole, in numpy on Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.words import LOWER, distinct, hash_spans, mix, slices, spans, text_bytes

#: Bytes that end a sentence.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True
#: Letters and digits of ASCII, and all bytes of longer UTF-8 sequences.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PREFIXES = (4, 5, 6)
#: Texts whose features are held at once while fitting.
FIT_TEXTS = 100


def sentence_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, row of each sentence; feature, sentence of each feature) of many texts."""
    begin, end, row = spans(buf, offs, ~ENDS)
    low = LOWER[buf]
    ws, we, _ = spans(buf, offs, WORD)
    of = np.searchsorted(begin, ws, "right") - 1
    keys = [hash_spans(low, ws, we)]
    keys += [mix(hash_spans(low, ws, np.minimum(we, ws + n)) + np.uint64(n)) for n in PREFIXES]
    return begin, end, row, np.concatenate(keys), np.tile(of, len(keys))


@dataclass
class BagModel:
    """Weights of the kept features, sorted by key, and the bias of a sentence."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def sentence_logits(self, keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Logit of each sentence; a feature counts once however often a sentence has it."""
        at = np.flatnonzero(self.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = np.searchsorted(self.keys, keys[at])
        hit = np.flatnonzero(np.append(self.keys, np.uint64(0))[slot] == keys[at]) if len(self.keys) else np.zeros(0, np.int64)
        pairs = np.unique(of[at[hit]] * (len(self.keys) + 1) + slot[hit])
        return self.bias + np.bincount(pairs // (len(self.keys) + 1), self.weights[pairs % (len(self.keys) + 1)], minlength=n)


def fit_bags(texts: list[str], toxic: np.ndarray, weight: np.ndarray, min_docs: int = 3, contrast: float = 3.0, rounds: int = 500, l1: float = 1e-5) -> BagModel:
    """Weighted noisy-or likelihood by adaptive gradient steps, with a shrinking of weights.

    Features of fewer than ``min_docs`` documents, and those whose share of toxic documents is
    less than ``contrast`` standard errors off the mean, are left out.
    """
    parts = [(i, pa.array(texts[i : i + FIT_TEXTS], pa.string())) for i in range(0, len(texts), FIT_TEXTS)]
    kept, n_docs, n_toxic = np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32)
    for i, part in parts:
        _, _, row, keys, of = sentence_features(*text_bytes(part))
        every, at = distinct(keys, row[of], len(part))
        is_toxic = np.repeat(toxic[i : i + len(part)], np.diff(at)).astype(np.float32)
        keys = np.concatenate([kept, every])
        kept, which = np.unique(keys, return_inverse=True)
        n_docs = np.bincount(which, np.concatenate([n_docs, np.ones(len(every), np.float32)]), minlength=len(kept)).astype(np.float32)
        n_toxic = np.bincount(which, np.concatenate([n_toxic, is_toxic]), minlength=len(kept)).astype(np.float32)
    mean = toxic.mean() if len(toxic) else 0.0
    off = np.abs(n_toxic - mean * n_docs) / np.sqrt(np.maximum(n_docs * mean * (1 - mean), 1e-9))
    kept = kept[(n_docs >= min_docs) & (off >= contrast)]
    bias = -4.0
    if not len(kept) or not toxic.any() or toxic.all():
        rate = float(np.average(toxic, weights=weight)) if len(toxic) else 0.0
        return BagModel(kept[:0], np.zeros(0), float(np.log(max(rate, 1e-3)) - 2))
    cells, rows, n_sentences = [], [], 0
    for i, part in parts:
        begin, _, row, keys, of = sentence_features(*text_bytes(part))
        slot = np.minimum(np.searchsorted(kept, keys), len(kept) - 1)
        hit = kept[slot] == keys
        cells.append(np.unique((of[hit] + n_sentences) * len(kept) + slot[hit]))
        rows.append(row + i)
        n_sentences += len(begin)
    cell, row = np.concatenate(cells), np.concatenate(rows)
    sent, feat = cell // len(kept), cell % len(kept)
    w, step_w, step_b = np.zeros(len(kept)), np.full(len(kept), 1e-8), 1e-8
    share = weight / weight.sum()
    for _ in range(rounds):
        z = bias + np.bincount(sent, w[feat], minlength=n_sentences)
        total = np.bincount(row, np.logaddexp(0, z), minlength=len(texts))
        pull = share * np.where(toxic, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
        g = pull[row] / (1 + np.exp(-z))
        grad = np.bincount(feat, g[sent], minlength=len(kept))
        step_w += grad**2
        step_b += g.sum() ** 2
        rate = 0.3 / np.sqrt(step_w)
        w -= rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        bias -= 0.5 * g.sum() / np.sqrt(step_b)
    used = np.abs(w) > 1e-3
    return BagModel(kept[used], w[used], float(bias))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, id_col: str, text_col: str):
    """(texts, label == 1, weight) of at most ``most`` rows of each label, chosen by a hash of
    the id; the weights make up for the choice. Nulls and unlabelled rows are left out, the
    largest label of an id counts."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(id_col).alias("_id")).agg(
        (F.max(label) == 1).alias("_y")
    )
    counts = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    texts, ys, weights = [], [], []
    for y, n in counts.items():
        chosen = marks.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        known = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
        got = known.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_doc", "_text").orderBy("_doc", "_text").toArrow()
        texts += got.column("_text").to_pylist()
        ys += [bool(y)] * len(got)
        weights += [n / max(min(n, most), 1)] * len(got)
    return texts, np.array(ys, bool), np.array(weights, float)


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    most_labels: int = 3000,
    threshold: float = 0.3,
    offence: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(id, score, predicted, worst_begin, worst_end, worst_score, sentences) for every row of ``docs``.

    ``learn`` says which rows of ``labels`` may be learned from. The worst sentence is given
    by its byte span in the text, offence or not; ``sentences`` are the spans and chances of all
    sentences whose chance is ``offence`` or more, in their order. Null texts and texts without sentences score 0 with a null
    span. Null and repeated ids are passed on with their own score; ties go to the first
    sentence. Without labels of both kinds the score is a small constant per sentence. Of the
    inputs only the named columns are read.
    """
    model = fit_bags(*labelled_sample(docs, labels, label_col, F.lit(True) if learn is None else learn, most_labels, id_col, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                buf, offs = text_bytes(part.column("_text"))
                begin, end, row, keys, of = sentence_features(buf, offs)
                z = model.sentence_logits(keys, of, len(begin))
                total = np.bincount(row, np.logaddexp(0, z), minlength=len(part))
                order = np.lexsort((begin, -z, row))
                lead = order[np.flatnonzero(np.diff(row[order], prepend=-1))] if len(order) else order
                span = [np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.zeros(len(part))]
                none = np.ones(len(part), bool)
                none[row[lead]] = False
                for col, x in zip(span, (begin[lead] - offs[row[lead]], end[lead] - offs[row[lead]], 1 / (1 + np.exp(-z[lead])))):
                    col[row[lead]] = x
                chance = 1 / (1 + np.exp(-z))
                bad = np.flatnonzero(chance >= offence)
                bad = bad[np.lexsort((begin[bad], row[bad]))]
                at = np.concatenate([[0], np.cumsum(np.bincount(row[bad], minlength=len(part)))])
                shift = offs[row[bad]]
                each = pa.StructArray.from_arrays([pa.array(begin[bad] - shift), pa.array(end[bad] - shift), pa.array(chance[bad])], names=["begin", "end", "score"])
                score = -np.expm1(-total)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(pa.array(c, mask=none) for c in span), pa.ListArray.from_arrays(pa.array(at, pa.int32()), each)],
                    names=[id_col, "score", "predicted", "worst_begin", "worst_end", "worst_score", "sentences"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(scored, f"`{id_col}` {id_type}, score double, predicted int, worst_begin bigint, worst_end bigint, worst_score double, sentences array<struct<begin:bigint,end:bigint,score:double>>")
