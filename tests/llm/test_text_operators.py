import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import LONG, messy_documents, prose, words
from pyspark.sql import functions as F

from tasklens.llm import decontaminate as D
from tasklens.llm import fm_index, packing
from tasklens.llm import suffix_dedup as S
from tasklens.llm.queries import tokenizer_file
from tasklens.llm.suffix_array import suffix_array


# --- suffix arrays -------------------------------------------------------
def test_two_stage_suffix_array():
    r = random.Random(1)
    for _ in range(150):
        b = bytes(r.randrange(1, r.choice([2, 3, 4, 250])) for _ in range(r.randrange(1, 150))) * r.choice([1, 3])
        sa = suffix_array(np.frombuffer(b, np.uint8), 10_000)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix_array(np.frombuffer(b, np.uint8), 16)
        assert sorted(sa) == list(range(len(b)))
        assert [b[i:i + 16] for i in sa] == sorted(b[i:i + 16] for i in range(len(b)))


def brute_removed(docs, length):
    seen, out = set(), []
    for k, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                m[i:i + length] = True
            seen.add(b[i:i + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~m[:-1]])
        out.append((k, len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeating():
    r = random.Random(2)
    passages, line, docs = [prose(i, 40) for i in range(6)], prose(99, 30), []
    for k in range(160):
        p = [prose(1000 + k, r.randrange(0, 60))]
        if r.random() < 0.4:
            p += [r.choice(passages), prose(3000 + k, r.randrange(20))]
        if r.random() < 0.35:
            p.append(line)
        if r.random() > 0.95:
            p.append("ab " * 150)
        if r.random() > 0.9 and docs:
            p = [r.choice(docs)[1]]
        docs.append((k * 3, " ".join(p)))
    return docs + [(1, None), (2, ""), (4, "x" * 250), (5, "x" * 99), (7, "ü" * 70 + "é" * 60)]


@pytest.mark.parametrize("limits", [{}, {"group": 20, "shard": 5000}, {"gram": 12, "group": 3, "shard": 400}])
def test_substring_dedup_matches_brute_force(spark, repeating, limits):
    df = spark.createDataFrame(repeating, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in S.remove_repeats(df, ["doc_id"], **limits).collect())
    assert got == brute_removed(repeating, 100)


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S._parts, "__defaults__", (700,))
    docs = [(i, prose(i % 3, 400) + prose(50 + i, 100)) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [r for p in S._parts([batch(docs)], 100) for r in S.anchor_rows(p, 100, 24).itertuples()]
    starts = {}
    for r in rows:
        for s in range(r.lo, r.hi + 1):
            assert s not in starts.setdefault(r.k, set())
            starts[r.k].add(s)
    assert {k: len(v) for k, v in starts.items()} == {k: len(t.encode()) - 99 for k, t in docs}
    assert sorted(tuple(x) for x in S.remove_repeats(df, ["doc_id"]).collect()) == brute_removed(docs, 100)


def batch(docs):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]),
                                       pa.array([d[1].encode() for d in docs])], names=["k", "data"])


def test_repeated_ids_and_clashing_columns(spark):
    df = messy_documents(spark)
    got = S.remove_repeats(df, ["doc_id"]).collect()
    assert len(got) == df.count()
    long = [(r.n_bytes, r.n_removed) for r in got if r.doc_id == 4]
    inner = brute_removed([(0, LONG), (1, LONG)], 100)      # the second of two equal rows goes as a whole
    assert sorted(long) == sorted((r[1], r[2]) for r in inner)
    out = S.deduplicate(df.select(*df.columns, F.lit(5).cast("long").alias("n_chars")))
    assert out.columns == [*df.columns, "n_chars"]
    rows = {(r.doc_id, r["_k"], r.k) for r in out.collect()}
    assert (1, "x6", "x0") in rows
    assert S.deduplicate(df.limit(0)).collect() == []


# --- FM-index ------------------------------------------------------------
def test_fm_index_finds_all_places():
    r = np.random.default_rng(4)
    text = r.integers(0, 5, 400)
    text[-1] = 0
    index = fm_index.FMIndex(text, 6)
    pats = np.zeros((200, 6), np.int64)
    size = r.integers(1, 7, 200)
    for i, m in enumerate(size):
        pats[i, 6 - m:] = r.integers(1, 6, m)
    lo, hi = index.search(pats, size)
    for i, m in enumerate(size):
        p = pats[i, 6 - m:].tolist()
        want = [k for k in range(len(text) - m + 1) if text[k:k + m].tolist() == p]
        got = index.locate(np.arange(lo[i], hi[i])) if hi[i] > lo[i] else []
        assert sorted(got) == want


def brute_hits(docs, items, window):
    out = []
    for _, t in docs:
        w, hit, found = words(t), set(), set()
        for item, body in items:
            x = words(body)
            for p in [x[k:k + window] for k in range(len(x) - window + 1)] or ([x] if x else []):
                for s in range(len(w) - len(p) + 1):
                    if w[s:s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        found |= {item} - {None}
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def contaminated():
    r = random.Random(5)
    v = "a b c dé e f g ça".split()
    items = [(str(i), prose(i, r.choice([3, 6, 12, 20]), v)) for i in range(25)] + [("x", ""), ("n", None), (None, "zz yy")]
    docs = [(0, None), (1, ""), (2, "...")]
    for i in range(120):
        w = [r.choice([*v, "q"]) for _ in range(r.randrange(60))]
        if r.random() < 0.5:
            w[len(w) // 2:len(w) // 2] = r.choice(items[:25])[1].upper().split()
        docs.append((i + 3, r.choice(["-", " ", "\n"]).join(w) + r.choice(["", ".", "zz!yy"])))
    return docs, items


@pytest.mark.parametrize("window,shard", [(10, D.SHARD), (5, 40), (4, 25)])
def test_hits_match_brute_force(contaminated, window, shard):
    docs, items = contaminated
    n, spans, found = D.scan_texts([t for _, t in docs], D.Phrases(items, window), shard)
    got = [(int(a), sum(y - x for x, y in s), sorted(f)) for a, s, f in zip(n, spans, found, strict=True)]
    assert got == brute_hits(docs, items, window)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 300])
def test_scan_in_blocks_of_items(spark, contaminated, block):
    docs, items = contaminated
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = sorted(D.scan(d, b, ["doc_id"], 10, block_bytes=block).collect())
    got = [(r.n_words, sum(s.hi - s.lo for s in r.spans), r["items"]) for r in rows]
    assert got == brute_hits(docs, items, 10)


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = f"Keep this, {item.upper().replace(' ', '-')}! and this."
    df = messy_documents(spark, [(50, text, "en"), (51, "clean  text\n", "en")])
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    out = D.decontaminate(df, bench)
    assert out.columns == df.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[50].text == "Keep this, ! and this." and by[51].text == "clean  text\n"
    assert by[1].text is None and by[50].spans == "x3"
    assert D.decontaminate(df, bench.limit(0)).count() == df.count()
    assert D.decontaminate(df.limit(0), bench).collect() == []


# --- packing -------------------------------------------------------------
def check_pieces(rows, docs, encode, window=1024):
    by, left = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        left.setdefault(r.sequence_id, []).append(r)
    for k, t in docs:
        ids, at = np.array([*encode(t or ""), 0], "<u4"), 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for seq in left.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0      # nothing is padded


def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    docs = [(i, prose(i, (i * 37) % 900)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, LONG), (103, "漢字   <|endoftext|> ǅ  x"), (104, "\x85\xa0 \x1c\t")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ids string").repartition(3)
    rows = packing.pack_documents(df, tokenizer_file(), shard_tokens=20_000).collect()
    check_pieces(rows, docs, tokenizer())


def test_packing_puts_like_texts_together(spark):
    topics = [f"topic{t}a topic{t}b topic{t}c ".replace("topic", c * 5) for t, c in enumerate("qzxvkj")]
    docs = [(i, topics[i % 6] * 20) for i in range(48)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    seqs = {}
    for r in packing.pack_documents(df, tokenizer_file()).collect():
        seqs.setdefault(r.sequence_id, set()).add(r.doc_id % 6)
    assert sum(map(len, seqs.values())) <= 2 * len(seqs)


def test_packing_brings_like_texts_into_one_shard(spark):
    topics = [f"topic{t}a topic{t}b topic{t}c ".replace("topic", c * 5) for t, c in enumerate("qzxvkj")]
    docs = [(i, topics[i % 6] * 20) for i in range(96)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    seqs = {}
    for r in packing.pack_documents(df, tokenizer_file(), shard_tokens=3000).collect():
        seqs.setdefault(r.sequence_id, set()).add(r.doc_id % 6)
    assert sum(map(len, seqs.values())) <= 1.5 * len(seqs)


def test_neighbours_share_any_term():
    rare = np.arange(100, 140, dtype="<u4")             # in no other document of the shard
    docs = [np.append(rare, [5, 6, 7]).astype("<u4"), np.array([5, 6, 7, 8], "<u4"), np.array([9, 8], "<u4")]
    counts = np.zeros(202, np.int64)
    counts[:2] = 1000, 20000
    counts[2:] = 2
    counts[2 + np.array([5, 6, 7, 8, 9])] = 300
    index = packing.Shard(docs, counts)
    assert list(index.neighbours(0, np.array([False, True, True]))) == [1]
    assert np.isclose(index.scores(0)[1], 3 * index.scores(2)[1])
    index.narrow(np.array([False, True, False]))        # used documents leave the postings
    assert set(index.doc.tolist()) == {1} and np.isclose(index.scores(0)[1], 3 * index.scores(2)[1])


def test_bm25_scores():
    docs = [np.array(x, "<u4") for x in ([5, 5, 7], [5, 8, 8, 9], [7, 7, 7, 7, 1], [2])]
    counts = np.zeros(12, np.int64)
    counts[0], counts[1] = 4, sum(map(len, docs))
    for d in docs:
        counts[2 + np.unique(d)] += 1
    index = packing.Shard(docs, counts)
    avg = counts[1] / 4

    def bm25(term, d):
        tf, df = int((docs[d] == term).sum()), counts[2 + term]
        idf = np.log1p((4 - df + 0.5) / (df + 0.5))
        return idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / avg))

    assert np.allclose(index.scores(0), [sum(bm25(t, d) for t in (5, 7)) for d in range(4)])
    assert list(index.neighbours(0, np.array([True] * 4))) == sorted(
        [1, 2], key=lambda d: -sum(bm25(t, d) for t in (5, 7)))


def test_packing_edges(spark):
    df = messy_documents(spark)
    rows = packing.pack_documents(df, tokenizer_file()).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer()(r.text or "")) + 1 for r in df.collect())
    assert packing.pack_documents(df.limit(0), tokenizer_file()).collect() == []


def test_latin_texts_encode_alike():
    enc, r = packing.encoder(tokenizer_file()), random.Random(1)
    assert enc.fast is not None
    for _ in range(1500):
        t = "".join(chr(r.choice([r.randrange(0x250), r.randrange(128), 32, 10, 9, 0x85, 0xA0]))
                    for _ in range(r.randrange(1, 30)))
        assert enc.ids(t)[:-1].tolist() == enc.slow.encode(t, add_special_tokens=False).ids
    assert re.search("endoftext", enc.special[0])


def test_distinct_pieces_are_encoded_once(monkeypatch):
    """op6: many Latin texts are cut at once, and a piece that comes again is not encoded again."""
    enc, r = packing.Encoder(tokenizer_file()), random.Random(2)
    some = "aestrvlmdSL12\xb2\xbd\xc9\xe9\u0250\xaa\u0241'''''   \n\t\x85\xa0\x1c\r.,-"
    calls, encode = [], enc.fast.encode_ordinary
    monkeypatch.setattr(enc.fast, "encode_ordinary", lambda t: calls.append(t) or encode(t))
    monkeypatch.setattr(packing, "KEPT_LENGTH", 8)
    for kept in (1 << 18, 10):
        monkeypatch.setattr(packing, "KEPT_PIECES", kept)
        enc.kept.clear()
        for _ in range(400):
            texts = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(5)] + [None, "\u6f22 x"]
            for t, ids in zip(texts, enc.ids_of(texts), strict=True):
                assert ids.tolist() == enc.slow.encode(t or "", add_special_tokens=False).ids + [packing.END]
        assert len(enc.kept) <= kept
    monkeypatch.setattr(packing, "KEPT_PIECES", 1 << 18)
    calls.clear()
    enc.ids_of(["one two'll two", "x two two'll  one"] * 50)
    enc.ids_of(["two two"] * 50)
    assert len(calls) == len(set(calls)) <= 8
