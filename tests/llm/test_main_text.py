"""Suffix arrays over the pages of a host and page markup, next to plain Python."""

import random
import time

import numpy as np

from shelfmark.llm import main_text, suffix_order as so
from shelfmark.llm.main_text import ARTICLE, CHROME_ZONE, OPEN, bar, boilerplate, main_texts, page_blocks

SCHEMA = "page_id long, url string, html string"


def streams_of(draw, n):
    """Streams over few words, so that runs repeat, some empty, some copies."""
    rows = [[draw.randrange(4) for _ in range(draw.randrange(30))] for _ in range(n)]
    return rows + [list(rows[0]), [], [1], [2] * 20]


def laid(rows):
    return np.array([t for r in rows for t in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def test_suffixes_are_in_order_with_their_common_prefixes():
    draw = random.Random(3)
    for n in (1, 2, 9, 25):
        rows = streams_of(draw, n)
        tokens, offs = laid(rows)
        order, lcp = so.suffix_order(tokens, offs)
        flat = [x for i, r in enumerate(rows) for x in r + [100 + i]]
        assert order.tolist() == sorted(range(len(flat)), key=lambda i: flat[i:])
        for a, b, size in zip(order, order[1:], lcp[1:]):
            x, y = flat[a:], flat[b:]
            assert size == next(k for k in range(min(len(x), len(y))) if x[k] != y[k])
    empty = so.suffix_order(*laid([]))
    assert len(empty[0]) == len(empty[1]) == 0


def pages_of_runs(rows, run):
    held = {}
    for p, r in enumerate(rows):
        for k in range(len(r) - run + 1):
            held.setdefault(tuple(r[k : k + run]), set()).add(p)
    return {w: len(p) for w, p in held.items()}


def test_runs_and_the_pages_that_hold_them():
    draw = random.Random(4)
    for run, need in ((1, 1), (3, 2), (5, 3), (8, 1)):
        rows = streams_of(draw, 20)
        tokens, offs = laid(rows)
        at, n = so.holders(*so.suffix_order(tokens, offs), tokens, offs, run, need)
        got = {tuple(tokens[a : a + run].tolist()): int(k) for a, k in zip(at, n)}
        assert len(got) == len(at)
        assert got == {w: k for w, k in pages_of_runs(rows, run).items() if k >= need}
        at, page = so.marked(tokens, offs, run, so.run_hashes(tokens, at, run))
        lists = so.spans_of(at, page, offs, run)
        for r, found in zip(rows, lists):
            covered = {t for k in range(len(r) - run + 1) if tuple(r[k : k + run]) in got for t in range(k, k + run)}
            assert {t for a, b in zip(found[::2], found[1::2]) for t in range(a, b)} == covered


def plain_spans(pages, run, share, least):
    """{key: covered tokens}, counted again without the pages that have no tokens of their own."""

    def covered(held, voters):
        need = bar(voters, share, least)
        return {
            k: {t for i in range(len(r) - run + 1) if held.get(tuple(r[i : i + run]), 0) >= need for t in range(i, i + run)} for k, _, size, r in pages
        }

    pages = [p for p in pages if p[2]]
    first = covered(pages_of_runs([p[3] for p in pages], run), len(pages))
    voters = [p for p in pages if 10 * (p[2] - len(first[p[0]])) >= p[2]]
    return covered(pages_of_runs([p[3] for p in voters], run), len(voters))


def test_boilerplate_is_the_same_in_one_cell_and_in_many(spark):
    draw = random.Random(5)
    bar_words = list(range(1000, 1012))
    pages = []
    for k in range(60):
        host = "big" if k < 45 else "small"
        own = [draw.randrange(10**6) for _ in range(draw.randrange(40))]
        body = own if k % 9 else list(range(2000, 2080))  # an article at many addresses
        stream = bar_words + body + (list(range(3000, 3010)) if k % 4 == 0 else [])
        pages.append((k, host, len(stream), stream))
    pages += [(100, "big", 0, []), (101, "big", 5, []), (102, None, 3, [1, 2, 3])]
    rows = [(k, h or "", n, s) for k, h, n, s in pages]
    frame = spark.createDataFrame(rows, "key long, host string, size long, tokens array<long>")
    want = {}
    for host in {r[1] for r in rows}:
        want |= plain_spans([r for r in rows if r[1] == host], 4, 30, 3)
    for cell in (10**6, 300):
        got = {r.key: r.spans for r in boilerplate(frame, 4, 30, 3, cell_tokens=cell).collect()}
        spread = {k: {t for a, b in zip(s[::2], s[1::2]) for t in range(a, b)} for k, s in got.items()}
        assert spread == {k: c for k, c in want.items() if c}
    assert boilerplate(frame.limit(0), 4, 30, 3).count() == 0


def words_of(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def texts_of(spark, rows):
    return {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_an_article_at_two_addresses_stays_and_its_menu_goes(spark):
    links = lambda k: "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", str(k), "News", "Sport", "About"))
    article = f"<h1><a href='/'>Title of it</a></h1><p>{words_of('w', 200)}</p>"
    got = texts_of(spark, [(k, f"http://a.example.com/{k}", f"<ul>{links(k)}</ul>{article}") for k in (1, 2)])
    assert got == {k: "Title of it " + words_of("w", 200) for k in (1, 2)}


def test_copies_quotes_and_phrases_stay_where_a_host_has_other_pages(spark):
    menu = "<div>home 7 news sport weather maps about us and all rights reserved</div>"
    quote = f"<p>{words_of('q', 20)}</p>"
    rows = [(k, f"http://h.example.com/{k}", f"{menu}<p>{words_of(f'w{k}x', 60)}</p>{quote if k < 3 else ''}") for k in range(12)]
    rows += [(20 + k, f"http://h.example.com/c{k}", f"{menu}<p>{words_of('copy', 200)}</p><p>at {k}</p>") for k in range(8)]
    rows += [(40 + k, f"http://h.example.com/m{k}", f"{menu}<article><p>{words_of('same', 50)}</p></article>{menu}<i>{k}</i>") for k in range(8)]
    got = texts_of(spark, rows)
    for k in range(12):
        assert got[k] == words_of(f"w{k}x", 60) + (" " + words_of("q", 20) if k < 3 else "")
    for k in range(8):
        assert got[20 + k] == words_of("copy", 200) + f" at {k}"
        assert got[40 + k] == words_of("same", 50)


def test_columns_of_other_names_and_clashing_ones(spark):
    rows = [(1, "http://h.example.com/1", "<p>a&amp;b  c</p>", 5, "x"), (1, "http://h.example.com/1", "<p>a&amp;b  c</p>", 5, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, spans long, host string")
    assert [r.text for r in main_texts(frame).collect()] == ["a&b c"] * 2


def zones(html):
    return [(z, t) for z, t in page_blocks(html)]


def test_class_names_decide_as_whole_words():
    assert zones('<article><p>a</p><section id="related-work"><p>b</p></section></article>') == [(ARTICLE, "a"), (ARTICLE, "b")]
    assert zones('<div class="social-sciences"><p>a</p></div>') == [(OPEN, "a")]
    assert zones('<p>a long text of it</p><div class="site-footer">b</div>')[1] == (CHROME_ZONE, "b")
    assert zones('<p>a long text of it</p><div class="post social">b</div>')[1] == (CHROME_ZONE, "b")
    assert zones(f'<div class="page share">{words_of("w", 50)}</div><p>b</p>') == [(OPEN, words_of("w", 50)), (OPEN, "b")]
    assert zones(f'<nav class="x">{words_of("w", 50)}</nav><p>b</p>')[0][0] == CHROME_ZONE


def test_broken_and_deep_markup_takes_linear_time():
    pages = [
        "<div>" * 20_000 + "x" + "</span>" * 20_000,
        "<i><div>" + "<b>" * 20_000 + "x" + "</i>" * 20_000,
        "<ul>" + "<li>" * 20_000 + "x" + "</td>" * 20_000,
        "<" * 50_000,
    ]
    begun = time.perf_counter()
    for html in pages:
        assert len(page_blocks(html)) <= 1
    assert time.perf_counter() - begun < 5


def test_a_very_long_page(spark):
    body = words_of("w", 400_000)
    got = texts_of(spark, [(1, "http://l.example.com/1", f"<p>{body}</p>"), (2, "http://l.example.com/2", "<p>b</p>")])
    assert got == {1: body, 2: "b"}
    assert main_text.CELL_TOKENS > 400_000
