"""Document quality from preference pairs, by Bradley-Terry ranking.

A pair says that one document is better than another. The score of a document is linear in its
features, and the chance that a beats b is the logistic function of the difference of their
scores, so the weights are those of a logistic loss on feature differences. Pairs are made of
a good and a bad labelled document each. The cut between good and bad is a quantile of the
scores of the labelled documents: the share of bad ones among them.

The features are counts of shape, not of words: length, white space, letters, capitals,
signs, repeated words, lines and five-word runs, taken once from every whole text. The model is fitted on
all labelled rows: tasks add up the loss of their pairs, the driver holds a table of features by features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.words import LOWER, NOT_SPACE, distinct, hash_spans, slices, spans, text_bytes, windows
from shelfmark.operators.keys import dense_index
from shelfmark.session import cut

#: Signs whose share of the bytes is a feature each.
SIGNS = "#*$%&|<>!?.,;:-_/\\()[]{}\"'=+@~^"
FEATURES = 13 + len(SIGNS)
#: Labelled rows that are paired in one task.
GROUP_ROWS = 4096


def shape_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) numbers; an empty text has zeros."""
    n = len(offs) - 1
    size = np.diff(offs)
    per_byte = 1 / np.maximum(size, 1)
    row = np.repeat(np.arange(n), size)
    ws, we, wr = spans(buf, offs, NOT_SPACE)
    n_words = np.bincount(wr, minlength=n)
    per_word = 1 / np.maximum(n_words, 1)
    h = hash_spans(LOWER[buf], ws, we)
    different = np.diff(distinct(h, wr, n)[1])
    run, run_row = windows(h, wr, n, 5)
    runs = np.bincount(run_row, minlength=n)
    different_runs = np.diff(distinct(run, run_row, n)[1])
    line_mark = np.ones(256, bool)
    line_mark[10] = False
    ls, le, lr = spans(buf, offs, line_mark)
    n_lines = np.bincount(lr, minlength=n)
    different_lines = np.diff(distinct(hash_spans(buf, ls, le), lr, n)[1])
    length = we - ws
    counts = np.zeros((n, 256), np.int64)
    np.add.at(counts, (row, buf), 1)
    letters = counts[:, 65:91].sum(1) + counts[:, 97:123].sum(1) + counts[:, 128:].sum(1)
    columns = [
        np.log1p(n_words),
        np.log1p(n_lines),
        np.bincount(wr, length, minlength=n) * per_word,
        np.sqrt(np.bincount(wr, length.astype(float) ** 2, minlength=n) * per_word),
        different * per_word,
        1 - different_runs / np.maximum(runs, 1),
        1 - different_lines / np.maximum(n_lines, 1),
        letters * per_byte,
        counts[:, 65:91].sum(1) / np.maximum(letters, 1),
        counts[:, 48:58].sum(1) * per_byte,
        counts[:, 128:].sum(1) * per_byte,
        (n_words < 10).astype(float),
        np.bincount(wr, length == 1, minlength=n) * per_word,
        *[np.sqrt(counts[:, ord(c)] * per_byte) for c in SIGNS],
    ]
    out = np.stack(columns, axis=1).astype(float)
    out[size == 0] = 0
    return out


@dataclass
class Ranking:
    """Standardised linear score; ``cut`` is the score between bad and good, ``unit`` its spread."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    unit: float

    def chance(self, features: np.ndarray) -> np.ndarray:
        s = np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.cut) / self.unit, -30, 30)))


def _per_task(rows: DataFrame, sums, *cols: str) -> list[np.ndarray]:
    """``sums`` of the matrix of an array column and of the other columns, for each task that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = sums(_matrix(batch.column(0)), *(np.asarray(batch.column(i)) for i in range(1, len(cols))))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    return [np.array(r["v"]) for r in rows.select(*cols).mapInArrow(run, "v array<double>").collect()]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _added(parts: list[np.ndarray], size: int) -> np.ndarray:
    return np.sum(parts, axis=0) if parts else np.zeros(size)


def _pairs(rows: DataFrame, good: int, bad: int, standard, least: int, each: int) -> DataFrame:
    """(d): differences of a good and a bad row each. Rows are dealt evenly into groups that hold both kinds;
    every row of a group is in ``each`` pairs or more, and there are ``least`` pairs or more in all."""
    groups = max(1, min((good + bad) // GROUP_ROWS, good, bad))
    turns = max(each, -(-least // max(good, bad)))
    dealt = [
        dense_index(rows.where(F.col("y") == y), [F.xxhash64("id"), "id", "f"], "at").withColumn("group", F.col("at") % groups) for y in (True, False)
    ]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        z, y = standard(_matrix(table.column("f").combine_chunks())), np.asarray(table.column("y"))
        better, worse = z[y], z[~y]
        n = np.arange(max(len(better), len(worse)))
        d = np.concatenate([better[n % len(better)] - worse[(n + 7 * t) % len(worse)] for t in range(turns)])
        offs = np.arange(0, d.size + 1, FEATURES, dtype=np.int32)
        return pa.table({"d": pa.ListArray.from_arrays(pa.array(offs), pa.array(d.ravel()))})

    return dealt[0].unionByName(dealt[1]).select("group", "at", "y", "f").groupBy("group").applyInArrow(run, "d array<double>")


def fit_ranking(rows: DataFrame, pairs: int = 20_000, each: int = 4, rounds: int = 30, l2: float = 1e-3) -> Ranking:
    """Weights of the logistic loss on differences good - bad, from all ``rows`` (id, y, f); every row is in
    ``each`` pairs or more. Newton steps, one job each, of which every task gives its sums. The cut is the
    quantile of the share of bad rows, over all rows."""

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x), y.sum()], x.sum(0)])

    rows = cut(rows)
    total = _added(_per_task(rows, moments, "f", "y"), 2 + FEATURES)
    n, good = int(total[0]), int(total[1])
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if n:
        mean = total[2:] / n
        scale = np.maximum(np.sqrt(_added(_per_task(rows, lambda x: ((x - mean) ** 2).sum(0), "f"), FEATURES) / n), 1e-6)
    if not 0 < good < n:
        return Ranking(mean, scale, np.zeros(FEATURES), 0.0 if n > good else -1.0, 1.0)
    standard = lambda x: np.clip((x - mean) / scale, -8, 8)
    diff = cut(_pairs(rows, good, n - good, standard, pairs, each))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, slope and curvature."""

        def sums(d: np.ndarray) -> np.ndarray:
            m = d @ w
            p = 1 / (1 + np.exp(np.clip(m, -30, 30)))
            return np.concatenate([[len(d), np.logaddexp(0, -m).sum()], -p @ d, (d.T @ (d * (p * (1 - p))[:, None])).ravel()])

        v = _added(_per_task(diff, sums, "d"), 2 + FEATURES + FEATURES**2)
        v = v[1:] / v[0]
        return v[0] + l2 / 2 * (w @ w), v[1 : FEATURES + 1] + l2 * w, v[FEATURES + 1 :].reshape(FEATURES, FEATURES) + l2 * np.eye(FEATURES)

    w = np.zeros(FEATURES)
    loss, slope, curve = at(w)
    step = -np.linalg.solve(curve, slope)
    for _ in range(rounds):
        found = at(w + step)
        if found[0] > loss + 1e-12:
            step = step / 2
            continue
        w, last, (loss, slope, curve) = w + step, loss, found
        step = -np.linalg.solve(curve, slope)
        if last - loss < 1e-9:
            break

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(standard(_matrix(batch.column(0))) @ w), batch.column(1)], names=["s", "h"])

    # copies have one score: the hash lets the sort deal them out
    scores = rows.select("f", F.xxhash64("id").alias("h")).mapInArrow(score, "s double, h long")
    scores = dense_index(scores, ["s", "h"], "at").cache()
    spread = scores.agg(F.stddev_pop("s")).first()[0]
    bad = n - good
    ends = [r["s"] for r in scores.where(F.col("at").isin(bad - 1, min(bad, n - 1))).collect()]
    scores.unpersist()
    return Ranking(mean, scale, w, float(sum(ends) / len(ends)), float(max(spread / 4, 1e-6)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(id, score, predicted) for every row of ``docs``; label 1 is the better one.

    All labelled rows that ``learn`` allows are learned from; the largest label of an id counts. Null texts count as empty ones and are scored too. Null and repeated ids are
    passed on. Without labels of both kinds all documents have one score. Of the inputs only
    the named columns are read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                f = shape_features(*text_bytes(part.column("_text")))
                offs = pa.array(np.arange(0, f.size + 1, FEATURES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_text").is_valid(), pa.ListArray.from_arrays(offs, pa.array(f.ravel()))], names=["id", "known", "f"]
                )

    # a hundredth of a long text, and read by the fit and by the scores
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = cut(read.mapInArrow(features, f"id {id_type}, known boolean, f array<double>"))
    allowed = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.lit(True) if learn is None else learn)
    marks = labels.where(allowed).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) == 1).alias("y"))
    model = fit_ranking(rows.where("known").join(marks, "id").select("id", "y", "f"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.chance(_matrix(batch.column("f")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"]
            )

    return rows.select("id", "f").mapInArrow(scored, f"`{id_col}` {id_type}, score double, predicted int")
