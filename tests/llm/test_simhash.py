import random
import re

import numpy as np
import pytest
from llm_cases import lower, messy_documents, prose
from pyspark.sql import functions as F

from tasklens.llm.simhash_dedup import (covering, cube_links, fingerprint, finer, hex_digits, keep_one,
                                        near_duplicates, near_links)
from tasklens.llm.common import checkpointed, connected_components


def test_covering_holds_for_every_pair():
    masks = [m % 2 ** 64 for m in covering(list(range(64)), 4)]
    assert len(masks) == 31
    r = random.Random(2)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randrange(5)))
        assert any(m & diff == 0 for m in masks)
    for m in masks[:3]:     # refined masks cover the bits left out
        free = [b for b in range(64) if not m >> b & 1]
        fine = [x % 2 ** 64 for x in finer(m, 4)]
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(free, 4))
            assert any(x & diff == 0 for x in fine)


def test_fingerprint_is_the_majority_of_xxhash64(spark):
    for t in ("Ab é Z\tq\x0bw\x1cx a b c d e", "one two", "a b c d e f g A B C D", "x"):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
        h = [r[0] % 2 ** 64 for r in spark.createDataFrame([(g,) for g in grams], "g string")
             .select(F.xxhash64("g")).collect()]
        assert fingerprint(t, 4) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert fingerprint(None, 4) == fingerprint(" \n", 4) == 0


def classes(fps, radius):
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= radius)[0] + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(fps)):
        out.setdefault(find(i), set()).add(int(fps[i].view(np.int64)))
    return {frozenset(s) for s in out.values() if len(s) > 1}


@pytest.mark.parametrize("bucket", [1024, 150])
def test_links_lose_no_pair_in_hot_groups(spark, bucket):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(50)}
    for b in list(fps)[:12]:
        for _ in range(20):
            x = b
            for _ in range(r.randrange(1, 9)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    hot = r.getrandbits(64)
    for _ in range(700):
        x = hot
        for _ in range(r.randrange(1, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = {}
    for row in connected_components(near_links(df, 4, bucket)).collect():
        got.setdefault(row.component, set()).add(row.node)
    assert {frozenset(s) for s in got.values()} == classes(fps, 4)


@pytest.mark.parametrize("n, within", [(2000, 4), (3000, 15)])
def test_large_group_within_few_bits_ends(spark, monkeypatch, n, within):
    import tasklens.llm.simhash_dedup as S
    done = []

    def once(df):
        done.append(1)
        assert len(done) <= 3, "refined again and again"
        return checkpointed(df)

    monkeypatch.setattr(S, "checkpointed", once)
    first = covering(list(range(64)), 4)[6]
    mask = min(finer(first, 4), key=lambda m: (m % 2 ** 64).bit_count()) % 2 ** 64
    free = [b for b in range(64) if not mask >> b & 1][:15]
    r = random.Random(8)
    base, fps = r.getrandbits(64), set()
    while len(fps) < (n if within == 15 else 1900):     # 1,941 lie within 4 of 15 bits
        fps.add(base ^ sum(1 << b for b in r.sample(free, r.randrange(within + 1))))
    fps |= {r.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    got = {}
    for row in connected_components(near_links(df, 4)).collect():
        got.setdefault(row.component, set()).add(row.node)
    assert {frozenset(s) for s in got.values()} == classes(fps, 4)


def test_flips_give_the_links_of_all_pairs():
    r = random.Random(4)
    fps = {sum(r.randrange(2) << (5 * b) for b in range(12)) for _ in range(60)}    # sparse: several classes
    mask = ((1 << 64) - 1) ^ sum(1 << (5 * b) for b in range(12))
    for radius in (1, 2, 4):
        a, b = cube_links(mask, np.array(sorted(fps), np.int64), radius)
        got = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            got.setdefault(y, {y}).add(x)
        assert {frozenset(s) for s in got.values()} == classes(fps, radius)


def test_near_duplicates_and_kept_rows(spark):
    text = prose(5, 400)
    near = text.replace("that is", "that was", 1)
    df = messy_documents(spark, [(30, text, "en"), (31, near, "en"), (32, text, "en"), (33, prose(6, 400), "en")])
    got = near_duplicates(df).select("doc_id", hex_digits("fp").alias("f"), "component_id").collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert by[32].component_id == by[30].component_id == 30 and by[33].component_id == 33
    bits = bin(int(by[30].f, 16) ^ int(by[31].f, 16)).count("1")
    assert (by[31].component_id == 30) == (bits <= 4)
    zero = {r.doc_id for r in got if r.f == "0" * 16}
    assert {1, 2} <= zero and by[1].component_id == by[2].component_id == 1
    kept = keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(30) == 1 and 32 not in ids and 2 not in ids and 33 in ids
    assert kept.filter("doc_id = 30").first()["_kept"] == "x7"


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and keep_one(df).collect() == []
