import random

import numpy as np
import pytest

from tasklens.llm.common import connected_components
from tasklens.llm.voronoi_knn import integer_vectors, search, top_k


def test_components_match_union_find(spark):
    r = random.Random(1)
    e = [(r.randrange(900), r.randrange(900)) for _ in range(400)]
    e += [(i, i + 1) for i in range(2000, 2100)] + [(5000, 5000 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in e if a != b for x in (a, b)}
    df = spark.createDataFrame([*e, (None, 1), (7, 7)], "a long, b long")
    assert {x.node: x.component for x in connected_components(df).collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def brute(rows, k, scale, every):
    ok = [(i, np.floor(np.array(v, float) * scale)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in ok)
    ok = [(i, np.pad(v, (0, dim - len(v)))) for i, v in ok]
    out = set()
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = max(int(w @ v) for j, w in ok if j == q) if i not in best else max(
                    best[i], max(int(w @ v) for j, w in ok if j == q))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


@pytest.mark.parametrize("k", [1, 7])
def test_search_matches_brute_force(spark, monkeypatch, k):
    import tasklens.llm.voronoi_knn as v
    monkeypatch.setattr(v, "CHUNK", 8)
    monkeypatch.setattr(v, "BLOCK", 50)
    monkeypatch.setattr(v, "SAMPLE", 60)
    r = np.random.default_rng(3)
    centers = r.normal(size=(6, 5))
    rows = [(i, (centers[i % 6] + 0.2 * r.normal(size=5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[4][1]) for i in range(100)]                 # a hot vector: ties
    rows += [(4, rows[4][1])] * 3 + [(20, rows[9][1])]                   # repeated ids
    rows += [(2001, None), (2002, [1.0, None, 2.0]), (2003, [float("nan")] * 5),
             (2004, [float("inf")] * 5), (None, [1.0] * 5), (2005, []), (2006, [0.5]), (2010, [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    from pyspark.sql import functions as F
    got = {tuple(x) for x in search(df, F.col("vec_id") % 10 == 0, k, 64).collect()}
    assert got == brute(rows, k, 64, 10)


def test_repeated_ids_do_not_raise_the_bound(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist()) for i in range(200)]
    rows += [(7, [30.0, 0.0, 0.0, 0.0])] * 40 + [(20, [0.0, 30.0, 0.0, 0.0])] * 40        # 20 is a query
    rows += [(33, [0.0, 0.0, 30.0, 0.01 * i]) for i in range(40)]                         # differing vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F
    got = {tuple(x) for x in search(df, F.col("vec_id") % 10 == 0, 7, 64).collect()}
    assert got == brute(rows, 7, 64, 10)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = integer_vectors(df, 64)
    assert top_k(v, v, 3).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** 40 + i), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = integer_vectors(df, 1)
    got = top_k(v, v.filter("id = 0"), 3).collect()
    assert [(x.vec_id, x.score) for x in got] == [(i, 2 ** 63 - 1) for i in (1, 2, 3)]
