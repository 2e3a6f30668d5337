"""Tags by a dictionary of any size: one pass over each text, whatever the number of variants."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Variants of one automaton at most, some 300 bytes each in every task; a larger dictionary takes several passes.
VARIANTS = 200_000

Entry = tuple[str, int, int]


def _word_sign(c: str) -> bool:
    """Whether a character is part of a word, as in a Unicode word boundary."""
    return c.isalnum() or c == "_" or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nl", "Pc")


@lru_cache(maxsize=1 << 16)
def _word(c: str) -> bool:
    return _word_sign(c)


def _bounded(text: str, begin: int, end: int) -> bool:
    """Whether a word boundary lies at both ends of text[begin:end]."""
    before = begin > 0 and _word(text[begin - 1])
    after = end < len(text) and _word(text[end])
    return before != _word(text[begin]) and after != _word(text[end - 1])


class Finder:
    """The name of highest priority (0 first) with a variant in a text, by an Aho-Corasick automaton."""

    def __init__(self, entries: Sequence[Entry], names: Sequence[str], words: bool):
        import ahocorasick

        self.names, self.words, self.best = names, words, len(names)
        self.automaton = ahocorasick.Automaton()
        for variant, priority, name in entries:
            known = self.automaton.get(variant, None)
            if known is None or priority < known[0]:
                self.automaton.add_word(variant, (priority, name, len(variant)))
        self.first = min((e[1] for e in entries), default=0)
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        best = None
        if text and len(self.automaton):
            for last, (priority, name, size) in self.automaton.iter(text):
                if (best is None or priority < best[0]) and (not self.words or _bounded(text, last + 1 - size, last + 1)):
                    best = priority, name
                    if priority == self.first:
                        break
        return None if best is None else self.names[best[1]]


def dictionary_tag(cols: Sequence[str | Column], entries: Sequence[Entry], names: Sequence[str], words: bool, spark) -> Column:
    """The tag of the first of ``cols`` (lower-cased texts) that has one; only these columns leave the JVM."""
    shared = spark.sparkContext.broadcast((list(entries), list(names)))
    held: list[Finder] = []

    def tags(batches: Iterator) -> Iterator[pa.Array]:
        if not held:
            held.append(Finder(*shared.value, words))
        find = held[0]
        for batch in batches:
            parts = batch if isinstance(batch, tuple) else (batch,)
            out: list[str | None] = [None] * len(parts[0])
            for part in parts:
                for i in range(len(out)):
                    if out[i] is None:
                        out[i] = find(part[i].as_py())
            yield pa.array(out, pa.string())

    if len(cols) == 1:
        def run(a: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from tags(a)
    else:
        def run(a: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from tags(a)

    return F.arrow_udf(run, T.StringType())(*cols)


def tag_by_dictionary(
    df: DataFrame, dictionary: DataFrame, cols: Sequence[str], name: str = "tag", mode: str = "substring",
    most: int = VARIANTS,
) -> DataFrame:
    """``df`` with the name from ``dictionary`` (name, variant, priority) that the first of ``cols`` holds.

    Of several names in one text the one of lowest ``priority`` is taken, ties by name. Texts are lower-cased, variants
    are compared as they are; null and empty variants never match. ``mode="substring"`` takes any occurrence, ``"word"`` asks
    for a word boundary at both ends. A text is read once, whatever the number of variants.

    The dictionary travels in parts of ``most`` variants, in order of priority; a later part only
    fills what the parts before left empty, column by column.
    """
    if mode not in ("substring", "word"):
        raise ValueError("mode is 'substring' or 'word'")
    spark = df.sparkSession
    ordered = dictionary.where(F.length("variant") > 0).select("name", "variant", "priority").distinct()
    lowered = df.select("*", *[F.lower(c).alias(f"_low_{c}") for c in cols])
    tags: dict[str, list[Column]] = {c: [] for c in cols}
    part, single = [], []

    def add(rows: list) -> None:
        names = sorted({r["name"] for r in rows})
        at = {n: i for i, n in enumerate(names)}
        entries = [(r["variant"], k, at[r["name"]]) for k, r in enumerate(rows)]
        single.append((entries, names))
        for c in cols:
            tags[c].append(dictionary_tag([F.col(f"_low_{c}")], entries, names, mode == "word", spark))

    for row in ordered.orderBy("priority", "name", "variant").toLocalIterator():
        part.append(row)
        if len(part) == most:
            add(part)
            part = []
    if part:
        add(part)
    if not single:
        found = F.lit(None).cast("string")
    elif len(single) == 1:
        found = dictionary_tag([F.col(f"_low_{c}") for c in cols], *single[0], mode == "word", spark)
    else:
        found = F.coalesce(*[tag for c in cols for tag in tags[c]])
    return lowered.select(*[c for c in df.columns if c != name], found.alias(name))
