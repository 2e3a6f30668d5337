"""The stages of the pipeline one after the other, next to plain Python on some 200 documents."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from shelfmark.llm.queries import tokenizer_path
from test_duplicates import plain_components
from test_rules_and_hits import plain_stats, plain_words

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def made(seed=21):
    """(documents, items): own texts, near copies, long shared passages, benchmark text, poor and odd rows."""
    draw = random.Random(seed)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    items = [(1, " ".join(words(25))), (2, "Tiny item here"), (3, None), (4, "")]
    passages = [" ".join(words(60)) for _ in range(3)]
    texts = [" ".join(words(draw.randrange(12, 160))) for _ in range(110)]
    for k in range(30):  # one word of an earlier text differs
        base = texts[k].split()
        base[draw.randrange(len(base))] = f"e{k}"
        texts.append(" ".join(base))
    texts += [texts[40], texts[40], texts[41].upper()]
    texts += [" ".join([*words(70), passages[k % 3], *words(70)]) for k in range(24)]
    texts += [" ".join([*words(50), *items[0][1].split()[k : k + 9 + k % 3], *words(50)]) for k in range(12)]
    texts += [" ".join([*words(30), "tiny ITEM here" if k % 2 else "tiny here item", *words(30)]) for k in range(6)]
    texts += [None, "", " \n", "too short", "a b c d e " * 12, "word " * 4000, " ".join(words(20_000))]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(d, texts[k]) for d, k in enumerate(order)], items


def plain_pipeline(rows, items):
    import sentencepiece

    kept = []
    for d, t in rows:
        n, _, _, _, again = plain_stats(t)
        if n >= 10 and 100 * again <= 20 * n:
            kept.append((d, t))
    group, _ = plain_components(kept, 5, 80, 100)
    kept = [(d, t) for d, t in kept if group[d] == d]
    kept = cut_texts(kept)
    runs = set()
    for _, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        runs |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    out = set()
    for d, t in kept:
        w = plain_words(t)
        if any(tuple(w[i : i + n]) in runs for n in {len(r) for r in runs} for i in range(len(w) - n + 1)):
            continue
        ids = own.encode(t, add_eos=True)
        back = own.decode(ids)
        out.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return out


def cut_texts(rows, width=200):
    """(id, text without each character that a string of 200 covers which starts elsewhere too); texts are ASCII."""
    count = Counter(t[i : i + width] for _, t in rows for i in range(len(t) - width + 1))
    out = []
    for d, t in rows:
        mark = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                mark[i : i + width] = b"\x01" * width
        out.append((d, "".join(c for c, m in zip(t, mark) if not m)))
    return out


def folder(path, rows, items, labels=()):
    docs = [(d, t, "en", "clash", None if t is None else len(t)) for d, t in rows]
    for name, schema, values in (("documents", DOCUMENTS, docs), ("benchmark", ITEMS, items), ("labels", LABELS, labels)):
        columns = list(zip(*values)) or [()] * len(schema)
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), path / f"{name}.parquet")
    return str(path)


def test_stages_equal_plain_python_and_keep_the_columns(spark, tmp_path):
    rows, items = made()
    want = plain_pipeline(rows, items)
    sf_dir = folder(tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, len(rows)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        before, left = left, docs.count()
        assert left == before if name in ("suffix_array_dedup", "sentencepiece") else left < before
        assert docs.columns == columns or name == "sentencepiece"
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(tmp_path, [], [])).count() == 0


def test_odd_rows_and_repeated_ids_go_through(spark, tmp_path):
    draw = random.Random(2)
    a, b = (" ".join(f"w{draw.randrange(5000)}" for _ in range(40)) for _ in range(2))
    rows = [(1, a), (1, b), (1, b), (None, "x" + " ".join(reversed(a.split()))), (None, None), (None, ""), (7, "word"), (8, None)]
    got = corpus_pipeline.run(spark, folder(tmp_path, rows, [(1, "nothing of it")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert len({r.ids_sha256 for r in got}) == 3
