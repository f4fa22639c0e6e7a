"""Properties: exact partition counts, seeds independent of partitioning,
distributions, pair sums against brute force, ranks, queues."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL, pair_sign_sum_bruteforce
from tasklens.functions import bytes_np
from tasklens.operators import pairs as P
from tasklens.operators import queueing as Q
from tasklens.operators import records as R
from tasklens.plans.ranking import global_row_number, rank_within
from tasklens.sources import generators as G


def test_generator_partition_counts(spark):
    assert G.index_partitions(spark, 7).rdd.getNumPartitions() == 7
    z = G.zero_partitions(spark, 5, 16)
    assert z.rdd.getNumPartitions() == 5
    assert z.select(F.spark_partition_id().alias("p"), "id").orderBy("id").collect() == \
        [(i, i + 1) for i in range(5)]
    assert z.select(F.sum(F.length("payload"))).collect()[0][0] == 80
    k = G.keyed_records(spark, 3, 7, 1000, 8)
    assert k.rdd.getNumPartitions() == 3 and k.count() == 1000
    assert k.select(F.min("key"), F.max("key")).collect()[0] == (0, 6)


def test_seed_independent_of_partitioning(spark):
    a = G.keyed_records(spark, 3, 5, 500, 12, seed=7).select("id", "key", F.hex("payload"))
    b = G.keyed_records(spark, 11, 5, 500, 12, seed=7).select("id", "key", F.hex("payload"))
    assert sorted(a.collect()) == sorted(b.collect())
    c = G.keyed_records(spark, 3, 5, 500, 12, seed=8).select("id", "key", F.hex("payload"))
    assert sorted(a.collect()) != sorted(c.collect())


def test_payload_sizes(spark):
    df = spark.range(0, 6).withColumn("n", F.col("id") * 7)
    r = G.random_payloads_for(df, "id", F.col("n")).select("n", F.length("payload").alias("len")).collect()
    assert all(x.n == x.len for x in r)


@pytest.mark.parametrize("spec", [("c", 2.0), ("x", 0.5), ("e", 3, 1.5), ("w", 2.0), ("w", 1.5, 2.0), ("w", 0.8)])
def test_process_means(spark, spec):
    n = 20000
    df = spark.range(n).select(G.process_column(spec, 1, "t", F.col("id")).alias("x"))
    mean, sd = df.select(F.avg("x"), F.stddev("x")).collect()[0]
    true = G.process_mean(spec)
    assert abs(mean - true) <= 5 * (sd or 0) / np.sqrt(n) + 1e-12, (spec, mean, true)


def test_weibull_shape1_equals_exponential(spark):
    df = spark.range(100).select(G.process_column(("w", 1.0), 3, "s", F.col("id")).alias("w"),
                                 G.process_column(("x", 1.0), 3, "s", F.col("id")).alias("x"))
    assert all(abs(r.w - r.x) < 1e-12 for r in df.collect())


def test_unknown_process_warns(spark):
    with pytest.warns(UserWarning):
        G.process_column(("q", 1), 1, "t")
    with pytest.raises(ValueError):
        G.process_column(("q", 1), 1, "t", strict=True)


def test_pair_sign_sum_kernel_bruteforce():
    rng = np.random.default_rng(0)
    for n in [0, 1, 2, 31, 32, 33, 65, 1000, 3000]:
        a = rng.integers(-128, 128, n).astype(np.int8)
        assert bytes_np.pair_sign_sum(a) == pair_sign_sum_bruteforce(a)
        assert bytes_np.pair_sign_sum(a[::-1]) == -bytes_np.pair_sign_sum(a)


def test_doc_pair_sign_sum_whole_texts_bruteforce(spark):
    """W3 over whole sf0.001 documents against an O(n^2) loop."""
    import __spark_entry__ as entry
    got = dict(entry.queries()["W3_doc_pair_sign_sum"](spark, SF_SMALL).collect())
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        a = np.frombuffer(d.text.encode("utf-8"), dtype=np.int8)
        assert got[d.doc_id] == pair_sign_sum_bruteforce(a), d.doc_id


def test_pair_sign_sum_rows_hot_group(spark):
    """One group holds a third of the rows; several block sizes."""
    rng = np.random.default_rng(5)
    rows = [("hot", i, int(v)) for i, v in enumerate(rng.integers(-128, 128, 900))]
    rows += [(f"g{i % 50}", i, int(v)) for i, v in enumerate(rng.integers(-128, 128, 1800))]
    df = spark.createDataFrame(rows, "g string, pos int, v int")
    expect = {}
    for g in {r[0] for r in rows}:
        vals = [r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == g]
        expect[g] = pair_sign_sum_bruteforce(vals)
    for bs in (7, 64, 4096):
        got = dict(P.pair_sign_sum_rows(df, ["g"], "v", ["pos"], block_size=bs).collect())
        assert got == expect, bs


def test_rank_within_matches_window_with_hot_key(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    hot = li.withColumn("k", F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey"]
    b = hot.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    cols = ["k", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "pos"]
    want = sorted(b.select(*cols).collect())
    for rows in (100_000, 200, 0):      # no key, the hot key, every key cut into ranges
        a = rank_within(hot, ["k"], order, "pos", split_rows=rows)
        assert sorted(a.select(*cols).collect()) == want
        assert a.schema["pos"].dataType.simpleString() == "bigint"


def test_global_row_number_unique(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    g = global_row_number(li.select("l_orderkey", "l_partkey", "l_comment" if "l_comment" in li.columns else "l_tax",
                                    "l_shipdate"), ["l_orderkey", "l_partkey", "l_shipdate"], "rn")
    r = g.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"), F.count("*")).collect()[0]
    n = li.count()
    assert tuple(r) == (1, n, n, n)


def _python_fifo(rows):
    out, last = {}, None
    for q, j, a, s in rows:
        start = a if last is None or last[0] != q else max(a, last[1])
        d = start + s
        out[j] = d
        last = (q, d)
    return out


def test_fifo_blocked_equals_window_and_loop(spark):
    import __spark_entry__  # noqa: F401
    from tasklens.plans.q_queueing import queue_jobs
    j = queue_jobs(spark, SF_MID).drop("value")
    rows = sorted((r.user_id, r.event_id, r.arrival, r.service) for r in j.collect())
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    loop = _python_fifo(rows)
    wait_share = np.mean([loop[r[1]] - r[3] - r[2] > 0 for r in rows])
    assert 0.3 < wait_share < 0.5
    for method, hours in (("window", 1), ("blocked", 1), ("blocked", 24), ("blocked", 24 * 365)):
        got = Q.fifo_departures(j, ["user_id"], ["arrival", "event_id"], method=method,
                                block=F.floor(F.col("arrival") / F.lit(hours * Q.BLOCK_SPAN)))
        assert dict(got.select("event_id", "departure").collect()) == loop, (method, hours)


def test_arrival_schedule_blocked_equals_window(spark):
    df = spark.range(0, 3000).select(F.pmod(F.col("id"), F.lit(4)).alias("q"), "id",
                                     (F.pmod(F.col("id") * 7919, F.lit(1000)) + 1).alias("ia"))
    a = Q.arrival_schedule(df, ["q"], ["id"], "ia", method="window").select("id", "arrival")
    b = Q.arrival_schedule(df, ["q"], ["id"], "ia", block=F.floor(F.col("id") / 37)).select("id", "arrival")
    assert sorted(a.collect()) == sorted(b.collect())


def test_sort_records_keeps_multiset(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").withColumn("rec", R.be_record(F.col("l_partkey")))
    s = R.sort_records(li, "l_orderkey", "rec", tie=["l_linenumber", "l_suppkey", "l_quantity", "l_tax"])
    assert s.count() == li.count()
    bad = (s.withColumn("prev", F.lag("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("pos")))
           .where(F.col("prev") > F.col("l_partkey")).count())
    assert bad == 0


def test_null_keys_and_hot_queues(spark):
    """NULL is a key like any other; queues cut into blocks keep every job."""
    rows = [(None if i % 3 == 0 else i % 2, i, i * 7 % 50) for i in range(600)]
    df = spark.createDataFrame(rows, "q int, arrival bigint, service bigint")
    a = rank_within(df, ["q"], ["service", "arrival"], "pos", split_rows=50)
    b = df.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("service", "arrival")))
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    w = Q.fifo_departures(df, ["q"], ["arrival"], method="window")
    k = Q.fifo_departures(df, ["q"], ["arrival"], block=F.floor(F.col("arrival") / 20))
    assert sorted(w.collect(), key=str) == sorted(k.select(*w.columns).collect(), key=str)


def test_workload_of_another_label_does_not_run(spark):
    from tasklens.operators import workloads as W

    @F.pandas_udf("bigint")
    def fails(s):
        if s.notna().any():
            raise ValueError("ran")
        return s.astype("Int64")

    df = spark.createDataFrame([("a", bytearray(b"xy")), (None, bytearray(b"z"))], "lab string, payload binary")
    out = W.apply_workload_by(df, "lab", {"b": fails, "a": lambda c: W.byte_max(c).cast("bigint")},
                              lambda c: F.length(c).cast("bigint"))
    assert sorted(r.result for r in out.collect()) == [1, 121]


def test_global_row_number_checkpointed(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate"]
    a = global_row_number(li, order, "rn").select("rn", *order)
    b = li.select(F.row_number().over(Window.orderBy(*order)).alias("rn"), *order)
    assert sorted(a.collect()) == sorted(b.collect())


def test_chunked_workloads_equal_whole(spark):
    """W1/W2/W3 over 4 KiB chunks of every sf0.001 document equal the
    one-row results."""
    from tasklens.operators import pairs as PP
    from tasklens.operators import workloads as W
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "doc_id", F.encode("text", "UTF-8").alias("payload"))
    whole = {r.doc_id: r for r in docs.select(
        "doc_id", W.byte_max(F.col("payload")).alias("mx"), W.byte_min(F.col("payload")).alias("mn"),
        W.pair_sign_sum(F.col("payload")).alias("s")).collect()}
    chunks = W.chunk_payloads(docs, ["doc_id"], max_record_bytes=4096)
    assert chunks.select(F.max(F.length("payload"))).collect()[0][0] <= 4096
    mx = dict(W.byte_max_chunked(chunks, ["doc_id"]).collect())
    mn = dict(W.byte_min_chunked(chunks, ["doc_id"]).collect())
    s = dict(PP.pair_sign_sum_chunked(chunks, ["doc_id"]).collect())
    for k, r in whole.items():
        assert (mx[k], mn[k], s[k]) == (r.mx, r.mn, r.s), k


def test_scramble_paths_agree(spark):
    """W6 and W6h against the writes done one by one."""
    from tasklens.operators import workloads as W
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "doc_id", F.encode("text", "UTF-8").alias("payload"))
    docs = docs.unionAll(spark.createDataFrame([(-1, bytearray()), (-2, None), (-3, bytearray(b"x"))], docs.schema))
    for n_writes in (1, 16, 40):
        args = (F.col("payload"), 42, F.col("doc_id"), n_writes)
        pos, val = W._writes(*args)
        for r in docs.select("payload", W.scramble_bytes(*args).alias("s"), W.scramble_head(*args).alias("h"),
                             pos.alias("p"), val.alias("v")).collect():
            b = None if r.payload is None else bytearray(r.payload)
            for p, v in zip(r.p or [], r.v) if b else ():
                b[p] = v % 256
            assert r.s == b
            assert r.h == (None if not b else b[0] - 256 * (b[0] > 127))


def test_ranking_edge_cases(spark):
    """Ties on the whole order still give 1..n per key; more range
    partitions than rows; an empty input."""
    rows = [(k, v) for k in range(3) for v in (1, 1, 1, 2, 2)] + [(9, 5)]
    df = spark.createDataFrame(rows, "k int, v int")
    r = rank_within(df, ["k"], ["v"], "pos", split_rows=2, splits=4)
    got = {}
    for row in r.collect():
        got.setdefault(row.k, []).append((row.v, row.pos))
    for k, pairs in got.items():
        assert sorted(p for _, p in pairs) == list(range(1, len(pairs) + 1))
        assert [v for v, _ in sorted(pairs, key=lambda x: x[1])] == sorted(v for v, _ in pairs)
    g = global_row_number(df, ["k", "v"], "rn", num_partitions=50)
    assert sorted(x.rn for x in g.collect()) == list(range(1, len(rows) + 1))
    empty = global_row_number(df.where("k < 0"), ["k", "v"], "rn")
    assert empty.count() == 0


def test_hot_key_of_one_long_prefix_is_split(spark):
    """Records of one key that share 8 leading bytes, and others: ranges are cut
    at whole records and follow the key's rows."""
    n, prefix = 4000, b"\x07" * 8
    rows = [(None if i % 40 == 0 else 1, prefix + (i * 7919 % n).to_bytes(3, "big"), i) for i in range(n)]
    rows += [(2, b"", -1), (2, b"\x00\x00", -2), (2, b"\x00\x05", -3), (2, b"\x05", -4), (2, b"\xff", -5), (2, b"\x01\x00", -6)]
    df = spark.createDataFrame(rows, "k int, rec binary, i int").repartition(6)
    out = R.sort_records(df, "k", "rec", tie=["i"], split_rows=100)
    got = {(r.k, r.i): r.pos for r in out.collect()}
    want = {}
    for k in (None, 1, 2):
        own = sorted((int.from_bytes(rec, "big"), i) for kk, rec, i in rows if kk == k)
        want |= {(k, i): pos for pos, (_, i) in enumerate(own, 1)}
    assert got == want
    ranged = (df.where("k = 1").withColumn("o", R.record_order_key(F.col("rec")))
              .repartitionByRange(39, "k", "o", "i").groupBy(F.spark_partition_id()).count())
    assert ranged.count() > 30 and ranged.agg(F.max("count")).first()[0] < 300


def test_queue_of_one_hour_is_cut_into_equal_ranges(spark, monkeypatch):
    """All jobs of a queue arrive in one hour, many of them at one moment: the
    ranges hold about equally many jobs, and the tree scan equals the loop."""
    from tasklens.plans.ranking import ranges_within
    monkeypatch.setattr(Q, "FAN", 3)
    r = np.random.default_rng(8)
    rows = [("hot", int(a), i, int(s)) for i, (a, s) in enumerate(zip(r.integers(0, 900, 3000), r.integers(0, 3, 3000)))]
    rows += [(None, int(a), 5000 + i, 7) for i, a in enumerate(r.integers(0, 4000, 700))] + [("small", 5, 9000, 2), ("small", 6, 9001, 9)]
    df = spark.createDataFrame(rows, "q string, arrival long, j long, service long").repartition(5)
    got = {x.j: x.departure for x in Q.fifo_departures(df, ["q"], ["arrival", "j"], split_rows=100).collect()}
    waits = {x.j: x.at for x in Q.arrival_schedule(df, ["q"], ["arrival", "j"], "service", out="at", split_rows=100).collect()}
    want, sums = {}, {}
    for q in ("hot", None, "small"):
        free, total = -10**9, 0
        for _, a, j, s in sorted((x for x in rows if x[0] == q), key=lambda x: x[1:3]):
            free = max(a, free) + s
            want[j], sums[j] = free, total
            total += s
    assert got == want and waits == sums
    rest, ranged = ranges_within(df, ["q"], ["arrival", "j"], split_rows=100)
    assert rest.count() == 2
    sizes = [x["count"] for x in ranged.groupBy("q", "_tl_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300
