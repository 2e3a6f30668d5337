"""Conversation trie, byte-level encoding and ranked search next to plain Python or the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import conversation_trie as ct, ranked_search as rs
from shelfmark.llm.byte_pairs import ByteCodec, PerfectHash, byte_codes, codec, decoded_bytes, same_bytes
from shelfmark.llm.queries import RANKS, tokenizer_path
from shelfmark.llm.radix_tree import RadixTree
from shelfmark.llm.words import mix

# ---- conversation trie ----------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    """The nodes by prefixes held in dictionaries."""
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            conv[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    conv = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in conv.items()}
    rebuilt = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = conv.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * words
    out = []
    for k, m in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), kids[k], leaves[k], saved[k], digest))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(spark, rows):
    found = ct.conversation_trie(spark.createDataFrame(rows, TURNS).withColumn("node", F.lit(1)).withColumn("path", F.lit("x")))
    return sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr)


def random_turns(seed, convs=120):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-25, 200), convs):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            text = rng.choice(["a b", "a b", "", None, "c\td e", f"own {c}", "é ü"]) if t else "hello there"
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, "bot"]) if t else "user", text))
    return rows


def test_trie_equals_plain_python(spark, monkeypatch):
    rows = random_turns(1)
    assert trie_rows(spark, rows) == plain_trie(rows)
    monkeypatch.setattr(ct, "TREE_BYTES", 100)  # many small trees a task give the same sums
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_copies_long_conversations_and_odd_rows(spark):
    hot = [(c, t, "user", f"same {t}") for c in range(300) for t in range(5)]
    long = [(1000, t, "user", f"turn {t} of many") for t in range(300)]
    odd = [(None, 1, "user", "lost"), (2001, 0, "u", "x"), (2001, 0, "u", "x"), (2020, None, None, None), (2043, 0, "u", "only head")]
    chain = [(3000 + 20 * k, t, "u", f"step {t}") for k in range(30) for t in range(k + 1)]  # each goes on where the last ends
    rows = hot + long + odd + chain
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == []


def test_radix_tree_layouts_and_paths():
    tree, rng = RadixTree(list), random.Random(3)
    keys = {bytes(rng.choices(range(256), k=3)) * rng.choice([1, 2, 40]) for _ in range(3000)} | {b"", b"\0", b"\0\0\1"}
    for i, k in enumerate(sorted(keys, key=hash)):
        tree.insert(k).append(i)
        tree.insert(k).append(-i)
    seen, layouts, todo = {}, set(), [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        layouts.add(node.layout)
        children = list(node.items())
        assert node is tree.root or node.value is not None or len(children) > 1  # paths are compressed
        assert [c.path[0] for c in children] == sorted(c.path[0] for c in children)
        assert all(node.child(c.path[0]) is c for c in children)
        if node.value is not None:
            seen[above + node.path] = node.value
        todo += [(c, above + node.path) for c in children]
    assert set(seen) == keys and tree.size == len(keys) and all(len(v) == 2 for v in seen.values())
    assert layouts == {4, 16, 48, 256}


# ---- byte-level BPE -------------------------------------------------------------------


def own_codec():
    import public_tokenizers

    return codec(tokenizer_path(RANKS), public_tokenizers.PATTERN)


def library(own):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_perfect_hash_has_a_slot_for_each_key():
    for n in (1, 2, 3, 17, 5000):
        keys = mix(np.arange(n, dtype=np.uint64))
        slots = PerfectHash(keys)(keys)
        assert sorted(slots.tolist()) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash(np.array([3, 3], np.uint64))


def test_same_bytes_compares_spans():
    a, b = np.frombuffer(b"abcabd", np.uint8), np.frombuffer(b"xabcab", np.uint8)
    s = lambda *x: np.array(x)
    assert same_bytes(a, s(0, 3, 2, 1), s(3, 6, 2, 3), b, s(1, 1, 0, 2), s(4, 4, 0, 3)).tolist() == [True, False, True, False]


def test_codec_equals_the_library():
    own = own_codec()
    lib, rng = library(own), random.Random(5)
    texts = ["", " ", "\n\n  x", "don't  we'll", "a" * 3000, "<|endoftext|>", "漢字🙂🙂 ñandú  x", "1234 5 678", "xyzq" * 500 + " \t" * 300]
    texts += ["".join(rng.choice("abc é\n\t 12'st<|>漢🙂 ") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for text, (n, of_ids, of_bytes, ids, back) in zip(texts, own.coded(texts)):
        want = lib.encode_ordinary(text)
        assert ids.tolist() == want == own.encode(text) and n == len(want) and bytes(back) == text.encode() == own.decode(want)
        assert of_ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert of_bytes == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError):
        ByteCodec({b"a": 0}, ".")


def test_a_long_text_in_pieces_gives_the_same_rows(monkeypatch):
    import shelfmark.llm.byte_pairs as bp

    own, text = own_codec(), "Some wörds, and  more\n" * 400
    whole = list(own.coded([text, "x"]))[0]
    monkeypatch.setattr(bp, "LONG_TEXT", 100)
    monkeypatch.setattr(bp, "PIECE", 7)
    monkeypatch.setattr(own, "merged_ids", {})
    cut = list(own.coded([text]))[0]
    assert cut[:3] == whole[:3] and cut[3].tolist() == whole[3].tolist() and cut[4] == bytes(whole[4])


def test_byte_codes_of_a_table(spark):
    import public_tokenizers

    path = tokenizer_path(RANKS)
    rows = [(1, "Hello  wörld"), (1, "Hello  wörld"), (None, "x y"), (2, None), (3, ""), (4, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash")).withColumn("ids", F.lit(0))
    got = byte_codes(df, path, public_tokenizers.PATTERN, texts=True)
    lib, found = library(own_codec()), got.collect()
    assert len(found) == len(rows)
    want = Counter((i, len(lib.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in found) == want
    back = decoded_bytes(got.select("doc_id", "ids", "decoded"), path, out_col="again").collect()
    assert all(bytes(r["again"]) == bytes(r["decoded"]) for r in back)
    assert byte_codes(df.limit(0), path, public_tokenizers.PATTERN).collect() == []


# ---- ranked search --------------------------------------------------------------------

TERM = re.compile(rs.TERM)


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // max(total, 1)
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m))
                for t in words if t in b
            )
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("terms", F.lit(1))
    return sorted((tuple(r) for r in rs.ranked_documents(d, q, k).collect()), key=repr)


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "été", *[f"w{i}" for i in range(60)]]
    weights = [40, 30, 20, 10, *[100 / (i + 1) for i in range(60)]]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(n)]
    return docs, [(q, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for q in range(12)]


def test_search_equals_plain_python(spark, monkeypatch):
    docs, items = some_docs(1, 400)
    docs += [(i + 1000, docs[0][1]) for i in range(60)]  # a large group of copies, all scores equal
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, "été w3"), (2000, None), (2001, ""), (2002, "- / _"), (2003, "w1 " * 20_000)]
    items += [(3, "w1 W1 w2"), (None, "ÜBER Über w9"), (50, None), (51, ""), (52, "unheard")]
    assert searched(spark, docs, items) == plain_search(docs, items)
    monkeypatch.setattr(rs, "BLOCK_TERMS", 30)  # several blocks of items, many trees a task
    monkeypatch.setattr(rs, "TREE_ENTRIES", 150)
    assert searched(spark, docs, items, 3) == plain_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] and searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, "b"), (2, None)], [(1, "a")]) == []


def test_tree_bounds_hold_and_subtrees_are_skipped():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 500)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.concatenate([np.sort(rng.choice(40, s, replace=False)) for s in sizes])
    tf, m = rng.integers(1, 5, offs[-1]), rng.integers(10, 400, 500)
    tree, weight = rs.DocumentTree(np.arange(500), m, offs, rank, tf), np.zeros(40, np.int64)
    for node in range(0, len(tree.term), 7):
        for place in range(tree.begin[node], tree.stop[node]):
            own = tree.rank[tree.offs[place] : tree.offs[place + 1]].tolist()
            at = own.index(tree.term[node])
            assert tree.tf[tree.offs[place] + at] <= tree.most_tf[node] and tree.m[place] >= tree.least_m[node]
    scored = []
    real = tree.scores
    tree.scores = lambda a, b, w: scored.append(b - a) or real(a, b, w)
    ranks = np.array([3, 20, 39])
    places, values = tree.search(ranks, np.array([10, 4000, 7000]), 5, weight)
    weight[ranks] = [10, 4000, 7000]
    every = real(0, 500, weight)
    assert values.tolist() == sorted(every.tolist(), reverse=True)[:5]
    assert tree.ids[places].tolist() == tree.ids[np.lexsort((tree.ids, -every))[:5]].tolist()
    assert sum(scored) < 250  # most documents are never scored


def test_range_maxima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 100, 57)
    after = np.minimum(np.arange(57) + rng.integers(1, 57, 57), 57)
    assert rs._range_max(values, after).tolist() == [int(values[i:j].max()) for i, j in enumerate(after)]
