"""Main text of web pages by markup zones and by suffix arrays over the pages of a host.

A page is parsed into blocks. Each block has a zone: what markup says is no article (menus,
headers and footers of the page, sidebars, notices, adverts, forms, comments), what it says is
the article, and the rest, of which markup says nothing.

The blocks of a page outside a marked article are its token stream. The streams of a host are
dealt out in cells of bounded size, one after the other, and the suffixes of a cell are put in
order by doubling, with the common prefix of neighbours. Suffixes that agree on ``run`` tokens or
more stand side by side; the pages among them are counted. A run is boilerplate if ``min_pages``
pages and ``share`` per cent of the pages of the host hold it. A host of many cells is counted
twice: a run that reaches the share in all its pages reaches it in one cell at least, so the runs
of single cells are candidates, and these are counted in all cells.

Pages that hold less than a tenth of tokens of their own beside such runs are copies of others:
they have no vote, and the runs are counted again without them. So an article at many addresses
is no boilerplate. Of blocks of which markup says nothing, tokens covered by boilerplate go and
runs that a page has alone are kept. Blocks that markup calls no article go whole, shared or not.
Inside a marked article nothing goes: passages that articles share are text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.rows import placed
from shelfmark.llm.suffix_order import holders, marked, run_hashes, spans_of, suffix_order
from shelfmark.llm.words import hash_spans, slices, spans, text_bytes, tidy
from shelfmark.session import cut

# ---- fixed values: the vocabulary of HTML --------------------------------------------
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video map head title select datalist button".split())
CHROME = frozenset("nav footer aside form menu dialog textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu sidebar breadcrumb breadcrumbs "
    "cookie cookies consent notice newsletter subscribe popup modal share sharing social related comment comments disqus "
    "respond footer masthead toolbar pagination pager".split()
)
#: Words that may stand beside one of CHROME_WORDS in a class name that still means no article.
FRAME_WORDS = frozenset(
    "area bar block body bottom box button buttons center container content footer group header inner item left link links list "
    "main mobile outer page panel primary reader right row secondary section site slot top unit user widget wrap wrapper".split()
)
# --------------------------------------------------------------------------------------

CHROME_ZONE, ARTICLE, OPEN, SILENCE, NAMED = 0, 1, 2, 3, 4
#: Tokens of one cell of a host; a longer stream is a cell of its own size.
CELL_TOKENS = 500_000
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PART = re.compile(r"[a-z]+")


#: Comments, declarations, tags (name and attributes), and what is left open at the end.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]*)))?")
#: Start tags that end an open element of the first group, unless one of the second lies between.
_SIBLINGS = {
    "p": ("p",), "li": ("li",), "tr": ("tr",), "option": ("option",),
    "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
}
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False
_CLOSE = {tag: re.compile(f"</{tag}", re.I) for tag in ("script", "style", "textarea", "xmp")}
_HOLDERS = frozenset("ul ol dl table article div section main nav footer aside header body td th li blockquote".split())


def _names_chrome(names: str) -> bool:
    """Whether a class or id is made of words for what is no article, alone or with words for boxes."""
    for name in names.lower().split():
        parts = _PART.findall(name)
        if any(p in CHROME_WORDS for p in parts) and all(p in CHROME_WORDS or p in FRAME_WORDS for p in parts):
            return True
    return False


def _zone_of(tag: str, raw: str, inside: int) -> int:
    """Zone of an element in one of zone ``inside``."""
    if inside == SILENCE or tag in SILENT:
        return SILENCE
    if inside == CHROME_ZONE or tag in CHROME or (tag == "header" and inside != ARTICLE):
        return CHROME_ZONE
    role = ""
    if raw and not raw.isspace():
        attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)}
        role = attrs.get("role", "").lower()
        if role in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return CHROME_ZONE
        if tag not in ("html", "body", "article", "main") and _names_chrome(f"{attrs.get('class', '')} {attrs.get('id', '')}"):
            return NAMED if inside != ARTICLE else CHROME_ZONE
    if inside == NAMED:
        return NAMED
    return ARTICLE if tag in ("article", "main") or role in ("main", "article") else inside


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in its order; where an article is marked, what lies
    outside it is chrome. Markup that is never closed ends with the page. A block of which markup
    says nothing is a menu if all its text is links and it is no heading. What only its class name
    calls no article is kept as unmarked text if less than a tenth of the page's text is beside it.
    The time is linear in the tags."""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a tag are
    words: list[str] = []
    zone, plain = OPEN, False

    def close_block() -> None:
        nonlocal plain
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            menu = zone == OPEN and not plain
            blocks.append((CHROME_ZONE if menu else zone, text))
        plain = False

    def last(tags: tuple[str, ...] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def end(tags: tuple[str, ...], holders: frozenset[str], block: bool) -> None:
        nonlocal zone
        k = last(tags)
        if k < 0 or k < last(holders):
            return
        if block or any(t not in INLINE for t, _ in stack[k:]) or (stack[k - 1][1] if k else OPEN) != zone:
            close_block()
        for t, _ in stack[k:]:
            places[t].pop()
        del stack[k:]
        zone = stack[-1][1] if stack else OPEN

    html, at = html or "", 0
    n = len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        text = html[at : m.start() if m else n]
        if text and zone != SILENCE:
            words.append(unescape(text) if "&" in text else text)
            plain = plain or not (places["a"] or text.isspace()) or any(places[h] for h in _HEADINGS)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        inline = tag in INLINE
        if m[1]:
            if tag in ("p", "br"):
                close_block()
            end((tag,), _HOLDERS if inline else frozenset(), not inline)
            continue
        if not inline:
            close_block()
        if tag in VOID:
            continue
        if tag in ("script", "style", "textarea", "xmp"):  # nothing in them is markup
            stop = _CLOSE[tag].search(html, at)
            at = stop.start() if stop else n
            if tag != "textarea":
                continue
        if tag in _SIBLINGS:
            end(_SIBLINGS[tag], _HOLDERS - {"li", "td", "th"} | ({"table"} if tag[0] == "t" else set()), True)
        inner = _zone_of(tag, m[3], zone)
        if inner != zone:
            close_block()
            zone = inner
        places[tag].append(len(stack))
        stack.append((tag, inner))
    close_block()
    size = defaultdict(int)
    for z, text in blocks:
        size[z] += len(text)
    if size[ARTICLE]:
        return [(z if z == ARTICLE else CHROME_ZONE, text) for z, text in blocks]
    named = OPEN if 10 * (size[OPEN] + size[CHROME_ZONE]) < size[NAMED] else CHROME_ZONE
    return [(named if z == NAMED else z, text) for z, text in blocks]


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the tokens of many texts, which single spaces part."""
    buf, offs = text_bytes(pa.array(texts, pa.large_string()))
    start, stop, row = spans(buf, offs, _NOT_BLANK)
    return hash_spans(buf, start, stop).view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])


@tidy
def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token hashes of each page outside a marked article, and the number of all its tokens."""
    for batch in batches:
        for part in slices(batch, "html"):
            texts, inside = [], []
            for html in part.column("html"):
                blocks = page_blocks(html.as_py())
                texts.append(" ".join(t for z, t in blocks if z != ARTICLE))
                inside.append(sum(t.count(" ") + 1 for z, t in blocks if z == ARTICLE))
            hashes, offs = _tokens(texts)
            lists = pa.LargeListArray.from_arrays(pa.array(offs), pa.array(hashes)).cast(pa.list_(pa.int64()))
            size = pa.array(np.diff(offs) + np.asarray(inside, np.int64))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("host"), size, lists], names=["key", "host", "size", "tokens"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _cell_streams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets) of the streams of a cell."""
    col = table.column("tokens").combine_chunks()
    offs = col.offsets.to_numpy()
    return col.values.to_numpy()[offs[0] : offs[-1]], offs - offs[0]


def bar(pages: int, share: int, least: int) -> int:
    """Pages that must hold a run: ``share`` per cent of ``pages``, ``least`` at least."""
    return max(least, -(-share * pages // 100))


def _candidates(table: pa.Table, run: int, share: int, least: int) -> pa.Table:
    """The runs of a cell that enough of its pages hold, each by a hash of its tokens."""
    tokens, offs = _cell_streams(table)
    cells = table.column("cells")[0].as_py()
    need = bar(table.num_rows, share, least if cells == 1 else 1)
    at, n = holders(*suffix_order(tokens, offs), tokens, offs, run, need)
    host = table.column("host")[0].as_py()
    return pa.table({
        "host": pa.array([host] * len(at), pa.string()), "cells": pa.array(np.full(len(at), cells, np.int64)),
        "window": pa.array(run_hashes(tokens, at, run)), "n": pa.array(n, pa.int64()),
    })


def _counted(table: pa.Table, runs: pa.Table, run: int) -> pa.Table:
    """In how many pages of a cell each of the given runs of its host occurs."""
    tokens, offs = _cell_streams(table) if table.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    at, page = marked(tokens, offs, run, runs.column("window").to_numpy())
    held = np.unique(np.stack([run_hashes(tokens, at, run), page]), axis=1)[0] if len(at) else np.zeros(0, np.int64)
    window, n = np.unique(held, return_counts=True)
    host = table.column("host")[0].as_py() if table.num_rows else None
    return pa.table({"host": pa.array([host] * len(window), pa.string()), "window": pa.array(window, pa.int64()), "n": pa.array(n, pa.int64())})


def _covered(table: pa.Table, runs: pa.Table, run: int) -> pa.Table:
    """Of each page of a cell: the spans of tokens that runs cover, and whether it has a vote."""
    keys = table.column("key").to_numpy()
    lists, vote = [], []
    if table.num_rows:
        tokens, offs = _cell_streams(table)
        at, page = marked(tokens, offs, run, runs.column("window").to_numpy())
        lists = spans_of(at, page, offs, run)
        size = table.column("size").to_numpy()
        vote = [10 * (n - sum(b - a for a, b in zip(s[::2], s[1::2]))) >= n for s, n in zip(lists, size.tolist())]
    host = [table.column("host")[0].as_py()] * len(keys) if len(keys) else []
    return pa.table({"key": pa.array(keys, pa.int64()), "host": pa.array(host, pa.string()), "spans": pa.array(lists, pa.list_(pa.int32())), "vote": pa.array(vote, pa.bool_())})


def _to_cells(runs: DataFrame, cells: DataFrame) -> DataFrame:
    """``runs`` once for every cell of their host."""
    places = cells.select(F.col("host").alias("of"), F.col("cell").alias("part")).distinct()
    return runs.select(F.col("host").alias("run_host"), "window").join(places, F.col("run_host") == F.col("of")).select("of", "part", "window")


def _with_cells(streams: DataFrame, most: int) -> DataFrame:
    """``streams`` dealt out: a host of more than ``most`` tokens has a cell for each ``most`` of them."""
    weight = streams.groupBy("host").agg(F.sum(F.size("tokens") + 1).alias("weight"))
    heavy = placed(weight.where(F.col("weight") > most).select("host", F.ceil(F.col("weight") / most).alias("parts")))
    cells = F.coalesce(F.col("parts"), F.lit(1)).cast("long")
    return streams.join(heavy, "host", "left").select("key", "host", "size", "tokens", cells.alias("cells"), F.pmod(F.xxhash64("key"), cells).alias("cell"))


def _by_cell(cells: DataFrame, runs: DataFrame, run: Callable, schema: str) -> DataFrame:
    return cells.groupBy("host", "cell").cogroup(_to_cells(runs, cells).groupBy("of", "part")).applyInArrow(run, schema)


def host_runs(cells: DataFrame, run: int, share: int, min_pages: int) -> DataFrame:
    """(host, window): the runs of ``run`` tokens that enough pages of their host hold.

    ``cells`` holds key, host, size, tokens, cells and cell."""
    found = cut(cells.groupBy("host", "cell").applyInArrow(
        lambda table: _candidates(table, run, share, min_pages), "host string, cells long, window long, n long"
    ))
    whole = found.where(F.col("cells") == 1).select("host", "window")
    parted = found.where(F.col("cells") > 1).select("host", "window").distinct()
    if parted.isEmpty():
        return whole
    many = cells.where(F.col("cells") > 1)
    count = many.groupBy("host").agg(F.count("*").alias("pages"))
    totals = _by_cell(many, parted, lambda a, b: _counted(a, b, run), "host string, window long, n long").groupBy("host", "window").agg(F.sum("n").alias("n"))
    need = F.greatest(F.lit(min_pages), F.ceil(share * F.col("pages") / 100))
    return whole.unionByName(totals.join(count, "host").where(F.col("n") >= need).select("host", "window"))


def boilerplate(streams: DataFrame, run: int, share: int, min_pages: int, cell_tokens: int = CELL_TOKENS) -> DataFrame:
    """(key, spans): the token spans of each stream that boilerplate of its host covers.

    ``streams`` holds key, host, size (tokens of the whole page) and tokens, each key once."""
    cells = _with_cells(cut(streams.where("size > 0")), cell_tokens)
    schema = "key long, host string, spans array<int>, vote boolean"
    covered = lambda runs: cut(_by_cell(cells, runs, lambda a, b: _covered(a, b, run), schema))
    runs = host_runs(cells, run, share, min_pages)
    first = covered(runs)
    mute = first.where(~F.col("vote")).select("key", "host")
    if mute.isEmpty():
        return first.where(F.size("spans") > 0).select("key", "spans")
    hosts = mute.select("host").distinct()
    voters = cells.join(hosts, "host", "left_semi").join(mute.select("key"), "key", "left_anti")
    second = covered(runs.join(hosts, "host", "left_anti").unionByName(host_runs(voters, run, share, min_pages)))
    return second.where(F.size("spans") > 0).select("key", "spans")


def main_texts(
    pages: DataFrame, run: int = 8, min_pages: int = 3, share: int = 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars, n_shared) for every row of ``pages``.

    n_shared counts the tokens outside a marked article that boilerplate of the host covers.

    Character references are decoded, white space inside a block is one space, blocks are
    joined in page order by one space. Null and empty pages have an empty text; a null url is
    a host of its own kind. Null and repeated ids are passed on; pages of a host with equal html
    count once. An empty table gives no rows. Of ``pages`` only the named columns are read.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(host_of(F.col(url_col)), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), F.xxhash64(host, F.col(html_col)).alias("_key"), F.col(html_col).alias("_html")
    )
    around = rows.select(F.col("_key").alias("key"), F.col("_host").alias("host"), F.col("_html").alias("html"))
    # pages are parsed again for their text: streams are a small part of them, texts are not written
    streams = around.mapInArrow(_around, "key bigint, host string, size bigint, tokens array<bigint>").dropDuplicates(["key"])
    gone = boilerplate(streams, run, share, min_pages).withColumnRenamed("key", "_gone")
    met = rows.join(placed(gone, F.size("spans")), F.col("_key") == F.col("_gone"), "left")

    @tidy
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                kept = [kept_text(page_blocks(h.as_py()), s.as_py()) for h, s in zip(part.column("_html"), part.column("spans"))]
                texts = [t for t, _ in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in kept], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars", "n_shared"],
                )

    return met.select("_id", "_url", "_html", "spans").mapInArrow(written, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint, n_shared bigint")


def kept_text(blocks: list[tuple[int, str]], spans: list[int] | None) -> tuple[str, int]:
    """The text of a page without its chrome and without tokens of open blocks that ``spans``
    (begin and end, one after the other) cover, and the number of covered tokens."""
    covered = {t for a, b in zip((spans or [])[::2], (spans or [])[1::2]) for t in range(a, b)}
    out, at = [], 0
    for zone, text in blocks:
        if zone == ARTICLE:
            out.append(text)
            continue
        tokens = text.split(" ")
        if zone == OPEN:
            own = [t for k, t in enumerate(tokens, at) if k not in covered]
            out += [" ".join(own)] if own else []
        at += len(tokens)
    return " ".join(out), len(covered)
