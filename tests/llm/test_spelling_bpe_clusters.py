"""Spelling variants, byte-level BPE and centroid clustering against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from conftest import SF_SMALL
from llm_cases import LONG, lower, messy_documents
from tasklens.llm import byte_bpe as B
from tasklens.llm import pca_means as C
from tasklens.llm import queries as Q
from tasklens.llm import spelling as S

# ------------------------------------------------------------------ spelling


def variants(docs, spoil, shortest=5, least=3):
    """The contract's table from (doc_id, text) rows, by deletion signatures."""
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if spoil and i is not None and h % spoil == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= least and len(w) >= shortest}
    same, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            same[w[:k], w[k + 1:]].add(w)
            if w[:k] + w[k + 1:] in n:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


def test_variants_of_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in Q.op11_spelling_variants(spark, SF_SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == variants([tuple(r) for r in docs], 97)


def crowded(seed, n):
    """Many words one edit apart, with anagrams, two-byte letters and chains of forms."""
    r, rows = random.Random(seed), []
    for i in range(n):
        w = [r.choice("abé÷Ñ") for _ in range(r.choice([4, 5, 5, 6]))]
        rows.append((i, " ".join(["".join(w).upper()] * r.choice([1, 2, 3, 7, 20]) + ["stones"] * 2)))
    return rows


@pytest.mark.parametrize("cells", [64, 1 << 15])
def test_variants_in_many_chunks(spark, monkeypatch, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    monkeypatch.setattr(S, "FLUSH", 50)
    monkeypatch.setattr(S, "VERIFY", 7)
    rows = crowded(cells, 900) + [(5000 + i, "m" * 70000 + " " + "m" * 69999) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in S.spelling_variants(docs, spoil=3).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(rows, 3)


def test_variants_of_messy_and_empty_tables(spark):
    docs = messy_documents(spark, more=[(9, "letters lettres Letters letter's lettters" * 3, None)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {tuple(r) for r in S.spelling_variants(docs, spoil=97, shortest=2).collect()}
    assert got == variants(rows, 97, shortest=2)
    none = S.spelling_variants(docs.limit(0))
    assert none.collect() == [] and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_a_block_meets_its_neighbours_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in crowded(4, 300)], "doc_id long, text string")
    words = S.counted_words(docs, None, 4, 1)
    chunks = S.chunked(words, S.letter_groups(words))
    pairs = [tuple(map(tuple, ((r.block, [r.chunk]), (r.block2, [r.chunk2])))) for r in S.chunk_pairs(chunks).collect()]
    keys = [frozenset((str(a), str(b))) for a, b in pairs]
    assert len(keys) == len(set(keys))


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(df):
    return sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in df.collect()),
                  key=lambda x: (x[0] is None, x[0], x[1]))


def test_ids_are_the_librarys(spark, ranks, library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 3000)           # many blocks, some of one long text
    r = random.Random(1)
    strange = [chr(c) for c in (*range(32, 0x250), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0x1F600, 0x10570, 0x31350)]
    more = [(100 + i, "".join(r.choice(strange) for _ in range(60))) for i in range(40)]
    more += [(200, "a" * 3000 + " " + "xyz" * 200), (201, "it's I'll 'S  's ''s\n\n  't\t\r\n x  "), (202, "<|endoftext|>"),
             (203, " ".join("ab cde the ing 1234 ... don't".split() * 50)), (204, "\n" * 500), (205, "漢字" * 300)]
    docs = messy_documents(spark, more=[(i, t, None) for i, t in more])
    want = sorted(((d.doc_id, library.encode_ordinary(d.text or "")) for d in docs.collect()),
                  key=lambda x: (x[0] is None, x[0], x[1]))
    out = B.encode(docs, ["doc_id"], ranks, public_tokenizers.PATTERN)
    assert ids_of(out) == want


def test_every_character_splits_as_in_the_library(spark, ranks, library):
    """All assigned and unassigned code points, between letters, digits and spaces."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in points[k:k + 4000]) for k in range(0, len(points), 4000)]
    import regex
    split = regex.compile(public_tokenizers.PATTERN).findall
    for t in texts[::7]:
        ids = [i for w in split(t) for i in B.merge_long(w.encode(), ranks)]
        assert ids == library.encode_ordinary(t)


def test_long_words_by_the_heap(ranks, library):
    r = random.Random(2)
    for w in ["a" * 5000, "".join(r.choice("abcdefghij") for _ in range(4000)), "ab" * 999, "é" * 700, "x", "the"]:
        assert B.merge_long(w.encode(), ranks) == library.encode_ordinary(w)


def test_op12_and_its_round_trip(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = Q.op12_byte_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_decoding_of_what_is_no_id_and_of_nothing(spark, ranks):
    rows = [(1, np.array([0, 1], "<u4").tobytes()), (2, b""), (3, None), (4, np.array([10**6], "<u4").tobytes()), (5, b"abc")]
    df = spark.createDataFrame(rows, "i int, ids binary")
    got = {r.i: r.t and bytes(r.t) for r in df.select("i", B.decode(df.ids, ranks).alias("t")).collect()}
    back = {i: p for p, i in ranks.items()}
    assert got == {1: back[0] + back[1], 2: b"", 3: None, 4: None, 5: None}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode(empty, ["doc_id"], ranks, public_tokenizers.PATTERN).collect() == []


# ------------------------------------------------------------------ clusters


def brute(rows, k, rounds, dim, scale=64):
    v = [(i, [int(np.floor(float(c) * scale)) for c in x]) for i, x in rows
         if x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:k]
    cent = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, x in v:
            own[nearest(x)[1]].append(x)
        cent = [[sum(c) // len(own[n]) for c in zip(*own[n], strict=True)] if own[n] else old for n, old in enumerate(cent)]
    done = [(i, *nearest(x)[::-1]) for i, x in v] if cent else []
    per = collections.Counter()
    for _, c, d in done:
        per[c] += d
    top = (1 << 63) - 1
    return collections.Counter(
        (i, c, min(d, top), min(per[c], top), min(sum(per.values()), top),
         hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, c, d in done)


def awkward(dim, big):
    r = np.random.default_rng(dim)
    rows = [(i, (r.normal(size=dim) * (1 + 5 * (i % 3 == 0))).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1])] * 3 + [(8, rows[9][1])]
    rows += [(None, rows[3][1]), (2001, None), (2002, [None] * dim), (2003, [float("nan")] * dim),
             (2004, [float("inf")] * dim), (2005, [1.0] * (dim - 1)), (2006, [1.0] * (dim + 1)), (2007, [])]
    if big:
        rows += [(3000 + i, [1e12 * (i - 2)] + [0.5] * (dim - 1)) for i in range(5)]
    return rows


@pytest.mark.parametrize(("dim", "k", "big", "lead"), [(6, 5, False, 2), (6, 5, True, 3), (3, 40, False, 16), (64, 16, False, 16)])
def test_clusters_match_brute_force(spark, dim, k, big, lead):
    rows = awkward(dim, big)
    df = spark.createDataFrame([(i, x, "y", 1) for i, x in rows],
                               "vec_id long, embedding array<double>, cluster string, n int").repartition(5)
    found, centroids = C.cluster(df, k=k, rounds=3, dim=dim, lead=lead)
    out = C.with_inertia(found.drop("verified"), centroids)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(tuple(r) for r in out.collect()) == brute(rows, k, 3, dim)


def test_filter_leaves_centroids_out(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(8, 64)) * 20
    rows = [(i, (centers[i % 8] + r.normal(size=64)).tolist()) for i in range(400)]
    found, _ = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=16)
    assert found.agg({"verified": "avg"}).first()[0] < 8


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.0, 1.0]), (2, [3.0, 1.0])]
    out = C.with_inertia(*C.cluster(spark.createDataFrame(rows, schema), dim=2))
    assert collections.Counter(tuple(r)[:3] + tuple(r)[4:] for r in out.collect()) == brute(rows, 16, 3, 2)
    none = C.with_inertia(*C.cluster(spark.createDataFrame([(5, None)], schema), dim=2))
    assert none.collect() == [] and "centroid_sha256" in none.columns


def test_very_long_text_is_counted(spark):
    rows = [(4, LONG), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in S.spelling_variants(docs, shortest=2).collect()}
    assert got == variants(rows, None, shortest=2)


def test_word_ids_go_back_to_their_blocks_packed(ranks, monkeypatch):
    """A task hands back a few packed rows for each block, whatever the number of words,
    long words merged; they unpack to the same places and ids."""
    import numpy as np
    import pyarrow as pa
    r = np.random.default_rng(2)
    rows = [(int(b), int(p), r.integers(0, 50_000, r.integers(1, 6)).tolist(), None)
            for b in (7, 3 << 32, 5) for p in r.permutation(900)]
    long = b"ab" * 300
    rows[10] = (*rows[10][:2], None, long)
    want = {(b, p): B.merge_long(x, ranks) if x else ids for b, p, ids, x in rows}
    table = pa.table([pa.array(c, t) for c, t in zip(
        zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()), strict=True)],
        names=["block", "place", "ids", "long"])
    monkeypatch.setattr(B, "PACK_ROWS", 1000)
    out = pa.Table.from_batches(B.packed_by_block(iter(table.to_batches(max_chunksize=300)), ranks))
    assert out.num_rows <= 9 and out.nbytes < table.nbytes
    got = {}
    for b in (7, 3 << 32, 5):
        place, count, ids = B.unpacked_words(out.filter(pa.compute.equal(out["block"], b)))
        for p, part in zip(place.tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=True):
            got[b, p] = part.tolist()
    assert got == want
    assert list(B.packed_by_block(iter(table.slice(0, 0).to_batches()), ranks)) == []


def test_words_are_merged_together(ranks, monkeypatch):
    """op12: the merges of many words at once, repeated, long and single-byte ones among them."""
    import pyarrow as pa
    r = random.Random(4)
    monkeypatch.setattr(B, "LONG", 40)
    words = ["".join(r.choice("aeinstthé漢 \n0") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    words = sorted(words + words[:900] + [" the", "x" * 41, "ab" * 60, "x" * 40, "\n"])
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(len(words)), pa.int64()), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words)],
        names=["block", "place", "word"])
    pairs = B.Pairs(ranks)
    got = [x for b in B.with_ids([rows.slice(0, 0), rows.slice(0, 7), rows.slice(7)], pairs) for x in b.to_pylist()]
    assert [x["block"] for x in got] == list(range(len(words)))
    for w, x in zip(words, got, strict=True):
        want = B.merge_long(w.encode(), ranks)
        assert (x["ids"], x["long"]) == (([], w.encode()) if len(w.encode()) > 40 else (want, None))
