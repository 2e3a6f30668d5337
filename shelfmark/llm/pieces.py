"""SentencePiece encoding of merge-type (BPE) models, and decoding.

The encoder never merges a text from single characters. It walks over it with the longest
pieces that an Aho-Corasick automaton finds, keeps a piece only if merging the pair (last
piece, this piece) anew gives back just these two, and steps back when nothing fits; a bit
field marks the positions from which no way on exists. The result is the one encoding that
merging gives, since an encoding all of whose neighbouring pairs are stable is the merged one.

Two neighbouring characters that no piece holds side by side can never be merged. A text is
cut there, so runs between such cuts are encoded on their own and remembered in the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from shelfmark.llm.words import slices, tidy

SPACE = "▁"
#: Entries that a task remembers for runs and for pairs of pieces; the memory starts anew when full.
REMEMBERED = 150_000


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.eos = own.eos_id()
        self.surface: dict[str, bytes] = {}
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        for i in range(own.get_piece_size()):
            piece = own.id_to_piece(i)
            self.surface[str(i)] = b""
            if own.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[str(i)] = bytes([int(piece[3:5], 16)])
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                self.rank[piece], self.id_of[piece] = -own.get_score(i), i
                self.surface[str(i)] = piece.replace(SPACE, " ").encode()
        self.id_text = [f" {i}" for i in range(own.get_piece_size())]
        pairs = {piece[k : k + 2] for piece in self.rank for k in range(len(piece) - 1)}
        signs = sorted(set("".join(pairs)))
        self.sign = np.zeros(0x110000, np.int32)  # 0: a character that no piece joins with others
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.joined = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for a, b in pairs:
            self.joined[self.sign[ord(a)], self.sign[ord(b)]] = True
        self.finder = ahocorasick.Automaton()
        for piece in self.rank:
            if self.merged(piece) == [piece]:  # a piece that merging never makes cannot occur
                self.finder.add_word(piece, len(piece))
        self.finder.make_automaton()
        self.stable: dict[tuple[str, str], bool] = {}
        self.known: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging, best score first, then leftmost."""
        parts, rank, none = list(text), self.rank, float("inf")
        while len(parts) > 1:
            best, at = none, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1], none)
                if score < best:
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether pieces a and b can stand side by side: merging both anew gives them back."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= REMEMBERED:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(a + b) == [a, b]
        return known

    def walk(self, text: str) -> list[str]:
        """Pieces of a text of known characters, by longest matches and steps back."""
        longest = [text[last - size + 1 : last + 1] for last, size in self.finder.iter_long(text)]
        if all(map(self.fits, longest, longest[1:])):
            return longest  # no step back was needed
        n, stable = len(text), self.stable
        starting: list[list[int]] = [[] for _ in range(n)]
        for last, size in self.finder.iter(text):
            starting[last - size + 1].append(size)
        failed = 0  # bit i: no encoding of the rest continues from position i
        path: list[str] = []
        left: list[list[int]] = []  # shorter choices at each piece of the path
        at, last, ways = 0, "", starting[0]
        while at < n:
            while ways:
                to = at + ways.pop()
                if failed >> to & 1:
                    continue
                piece = text[at:to]
                if not last or (stable[last, piece] if (last, piece) in stable else self.fits(last, piece)):
                    path.append(piece)
                    left.append(ways)
                    at, last = to, piece
                    ways = starting[at].copy() if at < n else []
                    break
            else:
                if not path:
                    raise AssertionError(f"no encoding of {text!r}")
                failed |= 1 << at
                at -= len(path.pop())
                last, ways = path[-1] if path else "", left.pop()
        return path

    def run_ids(self, text: str) -> list[int]:
        """Ids of a text without cuts."""
        if text in self.id_of:
            return [self.id_of[text]]
        if len(text) == 1:
            return [self.byte_id[b] for b in text.encode()]
        return [self.id_of[p] for p in self.walk(text)]

    def run(self, text: str) -> str:
        """The ids of a text without cuts, in decimal, each with a space in front; remembered."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        out = self.known[text] = "".join([self.id_text[i] for i in self.run_ids(text)])
        return out

    def runs(self, text: str) -> list[str]:
        """The text cut between neighbours that no piece holds side by side."""
        sign = self.sign[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        at = (np.flatnonzero(~self.joined[sign[:-1], sign[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]

    def id_line(self, text: str) -> str:
        """Ids of a raw text with the end id, in decimal, joined by one space."""
        find = self.known.get
        parts = [find(r) or self.run(r) for r in self.runs(normalised(text))] if text else []
        return ("".join(parts) + self.id_text[self.eos])[1:]

    def text_of(self, line: str) -> str:
        """The text of such a line; bytes that are no UTF-8 become U+FFFD, the added space goes."""
        out = b"".join(map(self.surface.__getitem__, line.split(" "))) if line else b""
        return out.decode("utf-8", "replace").removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them, with the end id."""
        return [int(i) for i in self.id_line(text).split(" ")]

    def decode(self, ids: list[int]) -> str:
        return self.text_of(" ".join(map(str, ids)))


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


@lru_cache(maxsize=2)
def _codec(path: str) -> PieceCodec:
    with open(path, "rb") as f:
        return PieceCodec(f.read())


def piece_codes(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with ``texts`` also (ids, decoded), a row per row of ``df``.

    The model must be of the merge type, with identity normalisation, a space added in
    front and byte fallback, and hold each character of a piece as a piece (checked). Null and empty texts have
    the end id alone; any id, nulls and repeated ones included, is passed on; other columns
    are ignored. The file reaches the executors through the session (``addFile``). A task
    holds one batch and the codec; nothing is shuffled.
    """
    check_model(model_path)
    name = model_path.rsplit("/", 1)[-1]
    df.sparkSession.sparkContext.addFile(model_path)
    id_type = df.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if texts else ""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(SparkFiles.get(name))
        for batch in (part for whole in batches for part in slices(whole, whole.schema.names[1])):
            counts, ids_hash, text_hash, all_ids, all_texts = [], [], [], [], []
            for text in batch.column(1):
                line = codec.id_line(text.as_py() or "")
                back = codec.text_of(line)
                counts.append(line.count(" ") + 1)
                ids_hash.append(hashlib.sha256(line.encode()).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if texts:
                    all_ids.append([int(i) for i in line.split(" ")])
                    all_texts.append(back)
            out = {id_col: batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if texts:
                out |= {"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(all_texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return df.select(id_col, text_col).mapInArrow(tidy(coded), f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")


@lru_cache(maxsize=8)
def check_model(path: str) -> None:
    """Raise unless every character of a piece is a piece, so that cut runs encode alone."""
    codec = _codec(path)
    if any(len(p) > 1 and any(c not in codec.rank for c in p) for p in codec.rank):
        raise ValueError("a piece holds a character that is no piece")
