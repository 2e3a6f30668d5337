"""Encoding, page texts and the learned operators on small made tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import words
from shelfmark.llm.language_net import has_letter, predicted_languages, stretches
from shelfmark.llm.main_text import main_texts, page_blocks
from shelfmark.llm.pieces import PieceCodec, piece_codes
from shelfmark.llm.quality_ranking import quality_scores
from shelfmark.llm.queries import tokenizer_path
from shelfmark.llm.toxicity import toxicity_scores

DOCS = "doc_id long, text string, lang string, score string, _id string"
BITS = [
    "a", "th", "e", " ", "  ", "\n", "\t", "é", "ß", "日", "😀", "\u0000", "▁", "ing", "!!!", "***", "12", "Ł", "\r\n", ".com", "<s>", "</s>", "�",
    "tion", "Hello", "world", "▁▁", "'s", "http://",
]


def made_texts(n=400, seed=9):
    draw = random.Random(seed)
    return ["".join(draw.choice(BITS) for _ in range(draw.randrange(40))) for _ in range(n)] + ["", " ", "\n", "▁", "word " * 20000]


def test_encoding_equals_the_library(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    texts = made_texts()
    rows = [(i, t, None, "s", "x") for i, t in enumerate(texts)] + [(None, None, None, None, None), (1, texts[1], None, "s", "x")]
    got = piece_codes(spark.createDataFrame(rows, DOCS), tokenizer_path(), texts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = own.encode((texts[r.doc_id] if r.doc_id is not None else ""), add_eos=True)
        back = own.decode(ids)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == back
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert piece_codes(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_walk_steps_back_to_the_merged_pieces():
    with open(tokenizer_path(), "rb") as f:
        codec = PieceCodec(f.read())
    draw = random.Random(3)
    letters = "abcdeghilnorstu"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(2, 14)))
        assert codec.walk(text) == codec.merged(text)


def test_word_hashes_and_windows():
    col = pa.array(["One two  three\n", None, "", "one TWO", "x" * 100 + " " + "x" * 101, "\t\x0b é"])
    buf, offs = words.text_bytes(col.slice(0))
    start, end, row = words.spans(buf, offs, words.NOT_SPACE)
    found = [(r, bytes(buf[a:b]).decode()) for a, b, r in zip(start, end, row)]
    assert found == [(i, w) for i, t in enumerate(col.to_pylist()) for w in (t or "").split()]
    keys, at = words.shingle_sets(col, 2)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 1, 1]
    assert keys[at[3]] in keys[at[0] : at[1]]


PAGE_SCHEMA = "page_id long, url string, html string, text string, key string"


def test_blocks_of_a_page():
    article = '<nav>m</nav><article><h1>T &amp; U</h1><p>a <b>b</b>c<br>d<p>e&nbsp; f<script>x="</p>"</script><aside>no</aside><div class="user-comments"><p>no</p></div></article><footer>no</footer>'
    assert [t for z, t in page_blocks(article) if z == 1] == ["T & U", "a bc", "d", "e f"]
    assert page_blocks(None) == [] and page_blocks("") == []
    assert [t for z, t in page_blocks("<p>a < b<p>open <i>end") if z == 2] == ["a < b", "open end"]
    assert all(z == 0 for z, _ in page_blocks('<form>a</form><div role="navigation">b</div><div id="cookie-bar">c</div><header>d</header>'))


def test_shared_runs_of_a_host_go(spark):
    bar = "<div>home news sport weather maps about us and all rights reserved</div>"
    body = lambda i: f"<p>{' '.join(f'w{i}x{k}' for k in range(30))}</p>"
    rows = [(i, f"http://h.example.com/{i}", f"<body>{bar}{body(i)}{bar}</body>", "t", "k") for i in range(6)]
    rows += [(10, "http://other.example.com/1", f"<body>{bar}{body(3)}</body>", "t", "k")]
    rows += [(20 + i, "http://h.example.com/a", f"<body>{bar}<article>{body(0)}</article></body>", "t", "k") for i in range(2)]
    rows += [(30, None, None, None, None), (None, "http://h.example.com/x", "", "t", "k"), (5, rows[5][1], rows[5][2], "t", "k")]
    got = {}
    for r in main_texts(spark.createDataFrame(rows, PAGE_SCHEMA)).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    for i in range(6):
        assert got[i] == [(text(i), len(text(i)))] * (2 if i == 5 else 1)
    assert got[10][0][0] == "home news sport weather maps about us and all rights reserved " + text(3)
    assert got[20] == got[21] == [(text(0), len(text(0)))]  # copies of an article are text
    assert got[30] == got[None] == [("", 0)]
    assert main_texts(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0


def made_documents(n=300):
    draw = random.Random(5)
    syllables = {"en": ["th", "ing", "er", "an"], "de": ["sch", "ung", "ü", "ver"], "es": ["ción", "ll", "ar", "que"]}
    rows, toxic, quality = [], [], []
    for i in range(n):
        lang = draw.choice(list(syllables))
        word = lambda: "".join(draw.choice(syllables[lang]) for _ in range(draw.randrange(1, 4)))
        sentences = [" ".join(word() for _ in range(12)) for _ in range(draw.randrange(2, 9))]
        bad, poor = i % 4 == 0, i % 5 == 0
        if bad:
            sentences[draw.randrange(len(sentences))] += draw.choice([" vileword", " nastyword"])
        text = ". ".join(sentences)
        rows.append((i, text.replace(" ", "*** ") if poor else text, lang, "s", "x"))
        toxic.append((i, int(bad)))
        quality.append((i, int(not poor)))
    return rows, toxic, quality


ODD = [(9001, None, None, None, None), (9002, "", "en", "s", "x"), (None, "a word", "en", "s", "x"), (9003, "12 --- 34", "en", "s", "x"), (9004, "😀 …", None, None, None)]


def test_toxic_documents_and_sentences(spark):
    rows, toxic, _ = made_documents()
    docs = spark.createDataFrame(rows + ODD, DOCS)
    labels = spark.createDataFrame(toxic + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels, learn=F.col("doc_id") < 200).collect()}
    assert len(got) == len(rows) + len(ODD)
    held = [(i, y) for i, y in toxic if i >= 200]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    for i, y in held:
        if y and got[i].predicted:
            worst = rows[i][1].encode()[got[i].worst_begin : got[i].worst_end]
            assert b"vileword" in worst or b"nastyword" in worst
    assert got[9001].score == got[9002].score == 0 and got[9001].worst_begin is None
    none = toxicity_scores(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in none)


def test_all_toxic_sentences_of_a_document(spark):
    rows, toxic, _ = made_documents()
    two = "er an ing. the vileword er. an an ing th. a nastyword too. an er"
    docs = spark.createDataFrame(rows + [(8000, two, "en", "s", "x")] + ODD, DOCS)
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labels).collect()}
    assert [two.encode()[s.begin : s.end].decode().strip() for s in got[8000].sentences] == ["the vileword er", "a nastyword too"]
    assert all(s.score >= 0.3 for r in got.values() for s in r.sentences)
    for r in got.values():
        spans = [(s.begin, s.end) for s in r.sentences]
        assert spans == sorted(spans) and ((r.worst_begin, r.worst_end) in spans) == (r.worst_score is not None and r.worst_score >= 0.3)
    assert got[9001].sentences == got[9002].sentences == []


def test_quality_ranking(spark):
    rows, _, quality = made_documents()
    docs = spark.createDataFrame(rows + ODD, DOCS)
    labels = spark.createDataFrame(quality + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(docs, labels, learn=F.col("doc_id") < 200).collect()}
    held = [(i, y) for i, y in quality if i >= 200]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    assert quality_scores(docs, labels.limit(0)).count() == len(rows) + len(ODD)


def test_languages(spark):
    rows, _, _ = made_documents()
    docs = spark.createDataFrame(rows + ODD, DOCS)
    got = {r.doc_id: r for r in predicted_languages(docs, learn=F.col("doc_id") < 200).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert {got[i].lang_pred for i in (9001, 9002, 9003, 9004)} == {"und"}
    assert {r.lang_pred for r in predicted_languages(docs.where("false").unionByName(docs.limit(3)), learn=F.lit(False)).collect()} == {"und"}


def test_stretches_hold_every_byte():
    buf, offs = words.text_bytes(pa.array(["x" * 64, "", None, "é" * 70, "ab"]))
    row, text = stretches(buf, offs)
    assert row.tolist() == [0, 3, 3, 3, 4]
    assert text[text > 0].tobytes() == buf.tobytes()
    assert has_letter("1é") and not has_letter("12 …") and not has_letter(None)


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_empty_tables(spark, name):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], f"doc_id long, {name} int")
    assert (toxicity_scores if name == "toxic" else quality_scores)(docs, labels).count() == 0
    assert predicted_languages(docs).count() == 0
