"""Hand-computed cases (FIXTURES.md section D)."""

import math

from pyspark.sql import functions as F

from tasklens.operators import modes as E
from tasklens.operators import pairs as P
from tasklens.operators import queueing as Q
from tasklens.operators import records as R
from tasklens.operators import workloads as W
from tasklens.sources import generators as G


def _bin(spark, *vals):
    return spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(vals)], "id int, payload binary")


def test_byte_max_min(spark):
    df = _bin(spark, b"\x7f\x80", b"")
    for method in ("arrow", "native"):
        r = df.select("id", W.byte_max(F.col("payload"), method).alias("mx"),
                      W.byte_min(F.col("payload"), method).alias("mn")).orderBy("id").collect()
        assert (r[0].mx, r[0].mn) == (127, -128)
        assert (r[1].mx, r[1].mn) == (-128, None)


def test_pair_sign_sum_cases(spark):
    df = _bin(spark, bytes([3, 1, 2]), bytes([1, 1]), bytes([1]), b"")
    r = df.select("id", W.pair_sign_sum(F.col("payload")).alias("s")).orderBy("id").collect()
    assert [x.s for x in r] == [1, 0, 0, 0]


def test_pair_sign_sum_rows_cases(spark):
    rows = [("a", 1, 3), ("a", 2, 1), ("a", 3, 2), ("b", 1, 1), ("b", 2, 1), ("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, pos int, v int")
    for bs in (1, 2, 4096):
        r = dict(P.pair_sign_sum_rows(df, ["g"], "v", ["pos"], block_size=bs).collect())
        assert r == {"a": 1, "b": 0, "c": 0}, bs


def test_record_lt(spark):
    df = spark.createDataFrame(
        [(bytearray(b"\x01"), bytearray(b"\x00\x02")), (bytearray(b"\x80"), bytearray(b"\x7f")),
         (bytearray(b"\x05"), bytearray(b"\x05"))], "a binary, b binary").withColumn(
        "i", F.monotonically_increasing_id())
    r = df.orderBy("i").select(R.record_lt(F.col("a"), F.col("b")).alias("lt")).collect()
    assert [x.lt for x in r] == [True, False, False]
    s = df.orderBy("i").where(F.length("a") == F.length("b")).select(
        R.record_lt(F.col("a"), F.col("b"), signed=True).alias("lt")).collect()
    assert [x.lt for x in s] == [True, False]


def test_fifo_departures(spark):
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 1, 1), (1, 3, 10, 2)],
                               "q int, j int, arrival bigint, service bigint")
    for method, bs in (("window", 4096), ("blocked", 1), ("blocked", 2), ("blocked", 4096)):
        r = Q.fifo_departures(df, ["q"], ["arrival", "j"], method=method,
                              block=F.floor(F.col("arrival") / bs)).orderBy("j").collect()
        assert [x.departure for x in r] == [5, 6, 12], (method, bs)
        assert [x.waiting for x in r] == [0, 4, 0]


def test_staged_and_slice_count(spark):
    df = spark.range(1, 5).withColumnRenamed("id", "x")
    assert E.staged_count(df, "x").collect()[0][0] == 1
    assert E.slice_count(df).collect()[0][0] == 4


def test_weibull_default_scale():
    assert G.process_mean(("w", 1.0)) == 1.0
    assert math.isclose(G.process_mean(("w", 2.0)), 1.0)


def test_sized_partitions_defaults(spark):
    """An empty size map means the default size everywhere (no error), ids
    are 0-based partition indices, one row per partition."""
    df = G.sized_partitions(spark, 4, {}, default_size=3)
    rows = df.select("id", F.length("payload").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert sorted((r.id, r.n, r.p) for r in rows) == [(i, 3, i) for i in range(4)]
    df = G.sized_partitions(spark, 6, {"0": 5}, default_size=1, n_slots=2)
    assert sorted((r.id, r.size) for r in df.collect()) == [(0, 5), (1, 1), (2, 5), (3, 1), (4, 5), (5, 1)]


def test_size_by_the_host_that_builds_the_row(spark):
    """G4h: the host of the tasks, asked of a task, has a size of its own."""
    from tasklens.sources import generators as G
    host = G.sized_by_host(spark.range(1), "id", {}, default_size=1).first().label
    rows = G.sized_by_host(spark.range(20), "id", {host: 5, "no such host": 3}, default_size=8).collect()
    assert {(r.label, r.size, len(r.payload)) for r in rows} == {(host, 5, 5)}


def test_moments_of_parts_merge_to_those_of_all(spark):
    import random

    from pyspark.sql import functions as F
    from tasklens.operators import metrics as M
    r = random.Random(4)
    rows = [(r.choice([0, 1, 2]), 1e9 + r.random(), r.choice([None, 3])) for _ in range(500)] + [(7, 2.0, None)]
    df = spark.createDataFrame(rows, "taskIndex int, x double, y int")
    parts = [M.index_moments(df.where(F.col("x") % 3 < 1), metrics=["x", "y"]),
             M.index_moments(df.where(F.col("x") % 3 >= 1), metrics=["x", "y"]),
             M.index_moments(df.limit(0), metrics=["x", "y"])]
    merged = M.merged_moments(M.merged_moments(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    got = {x.taskIndex: x for x in M.moment_stats(merged, metrics=["x", "y"]).collect()}
    want = {x.taskIndex: x for x in M.index_stats(df, metrics=["x", "y"]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in ("count", "avg_x", "var_x", "avg_y", "var_y"):
            assert (got[k][c] is None) == (w[c] is None)
            assert w[c] is None or abs(got[k][c] - w[c]) <= 1e-9 * max(1.0, abs(w[c]))
