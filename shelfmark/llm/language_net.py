"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads stretches of a text forwards and backwards, gives every byte position the
chances of the languages, and a document has the mean over its letter positions. It is trained
in numpy by backpropagation through time on stretches of a bounded sample of labelled texts.
Gates and candidates are piecewise linear (clipped lines), so a step is a few cheap operations
on many stretches at once. Every text is read whole, in stretches of ``SPAN`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.words import LOWER, slices, text_bytes

#: Bytes of a stretch; units of a direction; stretches computed at once.
SPAN, UNITS, WIDE = 64, 8, 1024
#: Bytes that count as letters: those of ASCII, and all of longer UTF-8 sequences.
LETTER = np.zeros(256, np.float32)
LETTER[[*range(97, 123), *range(128, 256)]] = 1
UNDETERMINED = "und"


def _half(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


@dataclass
class Direction:
    """Per byte the input part of both gates and the candidate, and the recurrent part."""

    byte: np.ndarray  # (256, 3 UNITS)
    state: np.ndarray  # (UNITS, 3 UNITS)

    def run(self, text: np.ndarray, keep: bool = False):
        """States (steps, stretches, UNITS) for bytes (steps, stretches); ``keep`` adds what learning needs."""
        steps, n = text.shape
        h = np.zeros((n, UNITS), np.float32)
        out, notes = np.empty((steps, n, UNITS), np.float32), []
        for t in range(steps):
            pre, rec = self.byte[text[t]], h @ self.state
            gates = _half(pre[:, : 2 * UNITS] + rec[:, : 2 * UNITS])
            r, z = gates[:, :UNITS], gates[:, UNITS:]
            a = pre[:, 2 * UNITS :] + r * rec[:, 2 * UNITS :]
            c = np.clip(a, -1, 1)
            if keep:
                notes.append((h, r, z, a, c, rec[:, 2 * UNITS :]))
            h = c + z * (h - c)
            out[t] = h
        return (out, notes) if keep else out

    def learn(self, text: np.ndarray, notes: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``byte`` and ``state``, through all steps."""
        steps, n = text.shape
        d_state, d_pre = np.zeros_like(self.state), np.empty((steps, n, 3 * UNITS), np.float32)
        d_h = np.zeros((n, UNITS), np.float32)
        for t in range(steps - 1, -1, -1):
            h, r, z, a, c, rec = notes[t]
            d = d_h + d_out[t]
            d_a = d * (1 - z) * (np.abs(a) < 1)
            d_r = d_a * rec * 0.25 * ((r > 0) & (r < 1))
            d_z = d * (h - c) * 0.25 * ((z > 0) & (z < 1))
            d_rec = np.concatenate([d_r, d_z, d_a * r], axis=1)
            d_pre[t] = np.concatenate([d_r, d_z, d_a], axis=1)
            d_state += h.T @ d_rec
            d_h = d * z + d_rec @ self.state.T
        flat, rows = d_pre.reshape(-1, 3 * UNITS), text.ravel()
        d_byte = np.stack([np.bincount(rows, flat[:, k], minlength=256) for k in range(3 * UNITS)], axis=1)
        return d_byte.astype(np.float32), d_state


@dataclass
class ByteNet:
    ahead: Direction
    back: Direction
    out: np.ndarray  # (2 UNITS + 1, languages)
    languages: list[str]

    def position_chances(self, text: np.ndarray) -> np.ndarray:
        """(steps, stretches, languages) for bytes (steps, stretches)."""
        return _softmax(self.ahead.run(text) @ self.out[:UNITS] + self.back.run(text[::-1])[::-1] @ self.out[UNITS:-1] + self.out[-1])

    def chances(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, languages): the mean over the letters of each text, zeros where there are none."""
        row, text = stretches(LOWER[buf], offs)
        total = np.zeros((len(offs) - 1, len(self.languages)))
        letters = np.zeros(len(offs) - 1)
        for i in range(0, len(row), WIDE):
            part = np.ascontiguousarray(text[i : i + WIDE].T)
            weight = LETTER[part]
            sums = np.einsum("tsl,ts->sl", self.position_chances(part), weight)
            np.add.at(total, row[i : i + WIDE], sums)
            np.add.at(letters, row[i : i + WIDE], weight.sum(0))
        return total / np.maximum(letters, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=2, keepdims=True)
    return x


def stretches(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bytes) of the stretches of many texts, the last of a text filled up with zeros."""
    size = np.diff(offs)
    each = -(-size // SPAN)
    row = np.repeat(np.arange(len(size)), each)
    begin = offs[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * SPAN
    at = begin[:, None] + np.arange(SPAN)
    inside = at < offs[1:][row][:, None]
    if not len(buf):
        return row, np.zeros(at.shape, np.uint8)
    return row, np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8)


def train(parts: np.ndarray, lang: np.ndarray, languages: list[str], rounds: int = 6, at_once: int = 256, rate: float = 0.01) -> ByteNet:
    """Adam on the cross-entropy of every letter position; ``parts`` (stretches, SPAN) bytes."""
    draw = np.random.default_rng(3)
    near = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
    net = ByteNet(Direction(near(256, 3 * UNITS), near(UNITS, 3 * UNITS)), Direction(near(256, 3 * UNITS), near(UNITS, 3 * UNITS)), near(2 * UNITS + 1, len(languages)), languages)
    values = [net.ahead.byte, net.ahead.state, net.back.byte, net.back.state, net.out]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, n_steps = 0, rounds * -(-len(parts) // at_once)
    for _ in range(rounds):
        order = draw.permutation(len(parts))
        for i in range(0, len(order), at_once):
            pick = order[i : i + at_once]
            text = np.ascontiguousarray(parts[pick].T)
            fwd, fwd_notes = net.ahead.run(text, keep=True)
            bwd, bwd_notes = net.back.run(text[::-1], keep=True)
            both = np.concatenate([fwd, bwd[::-1], np.ones((*text.shape, 1), np.float32)], axis=2)
            d = _softmax(both @ net.out)
            d[:, np.arange(len(pick)), lang[pick]] -= 1
            weight = LETTER[text]
            d *= (weight / max(weight.sum(), 1))[:, :, None]
            d_out = np.einsum("tsk,tsl->kl", both, d)
            d_both = d @ net.out.T
            grads = [
                *net.ahead.learn(text, fwd_notes, d_both[:, :, :UNITS]),
                *net.back.learn(text[::-1], bwd_notes, d_both[::-1, :, UNITS : 2 * UNITS]),
                d_out,
            ]
            step += 1
            pace = rate * (1 - 0.9 * step / n_steps)
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample_stretches(docs: DataFrame, learn: Column, most_docs: int, per_doc: int, id_col: str, text_col: str, lang_col: str):
    """(stretches, language numbers, languages): up to ``per_doc`` stretches, evenly spread, of
    about ``most_docs`` texts of each language, chosen by a hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "") & learn)
    counts = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, SPAN), np.uint8), np.zeros(0, np.int64), languages
    share = F.coalesce(*[F.when(F.col(lang_col) == la, F.lit(min(most_docs / n, 1.0))) for la, n in counts.items()])
    chosen = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text")
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = text_bytes(part.column("text"))
                row, text = stretches(LOWER[buf], offs)
                n = np.bincount(row, minlength=len(part))
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                some = place * per_doc % np.maximum(n[row], 1) < per_doc
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(row[some])), part.column("h").take(pa.array(row[some])), pa.array(place[some]), pa.array([t.tobytes() for t in text[some]], pa.binary())],
                    names=["lang", "h", "place", "bytes"],
                )

    got = chosen.mapInArrow(cut_out, "lang string, h bigint, place bigint, bytes binary").orderBy("lang", "h", "place").toArrow()
    parts = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, SPAN)
    index = {la: i for i, la in enumerate(languages)}
    return parts, np.array([index[la] for la in got.column("lang").to_pylist()], np.int64), languages


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predicted_languages(
    docs: DataFrame, learn: Column | None = None, most_docs: int = 400, per_doc: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``.

    Languages are those of the rows that ``learn`` allows; the score is the pooled chance of
    the predicted one. A null text, or one without a letter, is ``und`` with score 0, and so is
    every text where nothing could be learned. Ties go to the first language by name. Null and
    repeated ids are passed on. Of ``docs`` only the named columns are read.
    """
    parts, lang, languages = sample_stretches(docs, F.lit(True) if learn is None else learn, most_docs, per_doc, id_col, text_col, lang_col)
    net = train(parts, lang, languages) if languages else None
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                names, scores = [UNDETERMINED] * len(part), np.zeros(len(part))
                if net is not None:
                    buf, offs = text_bytes(part.column("_text"))
                    p = net.chances(buf, offs)
                    for i, text in enumerate(part.column("_text")):
                        if has_letter(text.as_py()):
                            best = int(p[i].argmax())
                            names[i], scores[i] = net.languages[best], min(float(p[i, best]), 1.0)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(scored, f"`{id_col}` {id_type}, lang_pred string, score double")
