"""Steps that must grow no faster than their input: what they write, and that it is whole."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tasklens.plans.q_metrics import file_lines, table_log
from tasklens.sources import eventlog as ev
from tasklens.streaming import eventlog_stream as S


def _multiset(df):
    return sorted((r.log, r.value) for r in df.select("log", "value").collect())


def test_log_files_of_long_logs_are_compressed_and_whole(spark, monkeypatch):
    """A log of many files is written compressed but for about one file, without a
    shuffle of its text, and both readers give its lines back (F1-F5)."""
    monkeypatch.setattr(S, "LINES_PER_FILE", 200)
    lines = file_lines(spark, SF_SMALL)
    folder = S.write_log_files(lines, S.scratch_path(spark, "long"))
    files = glob.glob(f"{folder}/log=*/part-*")
    plain = [f for f in files if not f.endswith(".gz")]
    assert plain and len(plain) < len(files)
    text = lines.agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(map(os.path.getsize, files)) < text / 3
    want = _multiset(table_log(spark, SF_SMALL))
    assert _multiset(ev.read_event_log(spark, folder)) == want
    assert _multiset(ev.read_event_log(spark, folder, reader="text")) == want
    for query in (S.read_event_log_stream(spark, folder), S.read_event_log_stream(spark, folder, follow=True)):
        counted = S.run_to_table(query.groupBy("log").count(), "complete", until_idle=True, state_partitions=4)
        assert sum(r["count"] for r in counted.collect()) == len(want)


def test_split_events_are_compressed(spark):
    path = S.scratch_path(spark, "split")
    lines = table_log(spark, SF_SMALL)
    assert ev.split_events(lines, path).count() == lines.count()
    text = lines.agg(F.sum(F.length("value"))).first()[0]
    assert sum(map(os.path.getsize, glob.glob(f"{path}/event=*/*.parquet"))) < text / 6


def test_rolled_files_are_dealt_as_rows_and_hold_their_lines_in_order(spark, monkeypatch):
    """Long rolled logs are compressed, and every file's lines stand by seq."""
    import gzip
    from tasklens.plans import q_placement as Q
    monkeypatch.setattr(S, "LINES_PER_FILE", 600)
    seen = []
    path = S.scratch_path
    monkeypatch.setattr(S, "scratch_path", lambda s, n: seen.append(path(s, n)) or seen[-1])
    lines = Q.rolled_log(spark, SF_SMALL)
    want = sorted((r.log, r.value) for r in Q.placement_lines(spark, SF_SMALL).collect())
    assert sorted((r.log, r.value) for r in lines.select("log", "value").collect()) == want
    top = next(p for p in seen if "/rolled-" in p)
    files = glob.glob(f"{top}/eventlog_v2_*/events_*")
    assert len(files) > 20 and all(f.endswith(".gz") for f in files)
    for f in files:             # a row's task stands behind its block
        with gzip.open(f, "rt") as text:
            rows = [json.loads(line) for line in text]
        places = [r["Task Info"]["Task ID"] for r in rows if r["Event"] == "SparkListenerTaskEnd"]
        assert places == sorted(places) and places
        kinds = [r["Event"] for r in rows if r["Event"] in ("SparkListenerTaskEnd", "SparkListenerBlockUpdated")]
        assert kinds == ["SparkListenerBlockUpdated", "SparkListenerTaskEnd"] * len(places)


def test_a_task_is_in_one_join_of_the_windowed_stream(spark):
    """Jobs, their ends and their stages are joined before the tasks."""
    folder = S.write_log_files(table_log(spark, SF_SMALL), S.scratch_path(spark, "joins"), files_per_log=1)
    stream = S.joined_task_stream(S.read_event_log_stream(spark, folder), bound="1 day")
    plan = stream._jdf.queryExecution().analyzed()
    joins, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join":
            joins += "finish_ts" in node.output().mkString(",")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert joins == 1


def test_probes_are_not_multiplied_by_the_holders_of_their_block(spark):
    """As-of join over several holders of a key: equal to a scan by hand, whatever the
    blocks, with one row for a probe that nobody holds (F6, F8)."""
    import random
    from tasklens.operators import placement as P
    r = random.Random(3)
    ups = [(r.choice("ab"), r.choice("xyz"), 2 * i, r.random() < .6, i) for i in range(150)]
    pro = [(r.choice("abc"), 2 * r.randrange(150) + r.choice((0, 1)), i, r.choice((None, r.randrange(300)))) for i in range(80)]
    u = spark.createDataFrame(ups, "k string, who string, seq bigint, held boolean, v bigint")
    p = spark.createDataFrame(pro, "k string, seq bigint, id bigint, since bigint")
    want = []
    for k, seq, i, since in pro:
        found = []
        for who in "xyz":
            last = [x for x in ups if x[0] == k and x[1] == who and x[2] < seq]
            if last and last[-1][3] and (since is None or last[-1][2] >= since):
                found.append((k, seq, i, who, last[-1][4]))
        want += found or [(k, seq, i, None, None)]
    key = lambda t: tuple((x is None, x) for x in t)
    for rows in (2, 30, 10_000):
        for cast in ("bigint", "decimal(38,0)"):
            a, b = (d.withColumn("seq", F.col("seq").cast(cast)) for d in (u, p))
            got = P.last_as_of(a, b.withColumn("since", F.col("since").cast(cast)), ["k"], "seq", ["v"],
                               block_rows=rows, each="who", held="held", since="since")
            got = got.select("k", F.col("seq").cast("bigint"), "id", "who", "v")
            assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_draws_of_many_writes_are_those_of_the_formula():
    """The batched draws equal md5's, also for keys that fill several blocks."""
    from hashlib import md5
    from tasklens.functions import bytes_np
    keys = ["42:w6p:1", "42:w6v:123456789012", "-7:x:" + "y" * 60, "é" * 25, "k" * 51, "k" * 52, ""]
    for n in (1, 9, 10, 1000):
        want = [[(int(md5(f"{k}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52 for i in range(1, n + 1)] for k in keys]
        assert bytes_np.uniforms(keys, n).tolist() == want


def test_writes_are_not_drawn_row_by_row_in_the_plan(spark):
    """A scramble of n writes takes two keys a record, not n expressions of it."""
    from tasklens.operators import workloads as W
    d = spark.createDataFrame([(1, b"abcdef"), (2, b""), (3, None)], "id bigint, b binary")
    s = W.scramble_bytes(F.col("b"), 42, F.col("id"), 1000)
    plan = d.select(s)._jdf.queryExecution().analyzed().toString()
    assert "transform(" not in plan
    for n in (1, 16, 20_000):
        got = d.select(W.scramble_bytes(F.col("b"), 42, F.col("id"), n).alias("s"), W.scramble_head(F.col("b"), 42, F.col("id"), n).alias("h")).collect()
        assert int.from_bytes(got[0].s[:1], signed=True) == got[0].h and len(got[0].s) == 6
        assert got[1].s == b"" and got[2].s is None


def test_blocks_are_summed_up_in_small_parts():
    """Histograms of many blocks do not stand in memory together, whatever the batch."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    from tasklens.functions import bytes_np
    from tasklens.operators import pairs
    r = np.random.default_rng(5)
    data = [r.integers(-128, 128, n).astype(np.int8) for n in [0, 1, 64, 5000, 300_000] + [40] * 600]
    run, schema = pairs._summaries([T.StructField("k", T.LongType())])
    for values in (pa.array([a.tobytes() for a in data] + [None], pa.binary()),
                   pa.array([a.astype(np.int32) for a in data] + [None], pa.list_(pa.int32()))):
        n = len(values)
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([i % 3 > 0 for i in range(n)]), values],
                                           names=["k", "want", "v"])
        out = list(run([batch]))
        assert max(b.num_rows for b in out) <= pairs.BATCH_BLOCKS and out[0].schema.names == schema.names
        rows = pa.Table.from_batches(out).to_pylist()
        assert [x["k"] for x in rows] == list(range(n))
        for i, (x, a) in enumerate(zip(rows, [*data, np.zeros(0, np.int8)], strict=True)):
            inner, hist, d = bytes_np.block_summary(a)
            assert x["inner"] == inner
            assert (x["hist"], x["d"]) == ((hist.tolist(), d.tolist()) if i % 3 else (None, None))


def test_incremental_statistics_join_the_tables_once(spark, monkeypatch):
    """The task rows of both lots of logs are joined and written once (F12), without their ids."""
    from tasklens import session
    from tasklens.plans import q_metrics as Q
    kept, write = [], session.written
    monkeypatch.setattr(session, "written", lambda df: kept.append(df) or write(df))
    got = Q.a5i(spark, SF_SMALL).collect()
    rows = [df for df in kept if "l_orderkey" in df.columns]
    assert len(rows) == 1 and "task_id" not in rows[0].columns
    assert sorted(got) == sorted(Q.a5(spark, SF_SMALL).collect())


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_")}


def _no_new_shuffle_files(spark, before):
    """Executors delete them shortly after the query."""
    import time
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            return True
        time.sleep(0.1)
    return False


def test_written_log_files_leave_no_shuffle_behind(spark, monkeypatch):
    """Shuffles of the count and of both parts of the log do not stay beside the files."""
    monkeypatch.setattr(S, "LINES_PER_FILE", 200)
    key, cleanup = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    threshold, was = spark.conf.get(key), spark.conf.get(cleanup)
    spark.conf.set(key, "-1")
    try:
        lines = file_lines(spark, SF_SMALL)
        before = _shuffle_files(spark)
        folder = S.write_log_files(lines, S.scratch_path(spark, "freed"))
        assert _no_new_shuffle_files(spark, before)
        assert spark.conf.get(cleanup) == was
        assert ev.read_event_log(spark, folder).count() == lines.count()
    finally:
        spark.conf.set(key, threshold)


def _scratch(monkeypatch):
    """The scratch folders that are named from here on."""
    seen, path = [], S.scratch_path
    monkeypatch.setattr(S, "scratch_path", lambda s, n: seen.append(path(s, n)) or seen[-1])
    return seen


def test_an_ended_stream_leaves_no_log_files(spark, monkeypatch):
    """The log files of M6 are gone with the stream, and its result is still read."""
    from tasklens.plans import q_streaming as Q
    seen = _scratch(monkeypatch)
    got = Q.m6(spark, SF_SMALL)
    logs = [p for p in seen if "/logs-" in p]
    assert len(logs) == 1 and not os.path.exists(logs[0])
    tasks = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert sum(r["count"] for r in got.collect()) == tasks
    with pytest.raises(ValueError):
        S.drop_scratch(spark, os.path.dirname(os.path.dirname(logs[0])))


def test_split_log_files_are_the_only_copy(spark, monkeypatch):
    """Behind the split by event there are no log files and no places of lines, and the
    split's own shuffles are gone; the lines are whole (F2)."""
    from tasklens.plans import q_metrics as Q
    seen = _scratch(monkeypatch)
    key = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        before = _shuffle_files(spark)
        assert Q.m5f(spark, SF_SMALL).columns[0] == "app"
        files = [p for p in seen if "/files-" in p]
        assert len(files) == 1 and not os.path.exists(files[0])
        assert _no_new_shuffle_files(spark, before)
        split = spark.read.parquet(next(p for p in seen if "/events-" in p))
        assert sorted(split.columns) == ["event", "log", "value"]
        want = table_log(spark, SF_SMALL)
        whole = split.where(F.get_json_object("value", "$.Event").isNotNull())
        assert _multiset(whole) == _multiset(want) and split.count() == whole.count() + 5
        before = _shuffle_files(spark)
        again = ev.split_events(want)
        assert _no_new_shuffle_files(spark, before)
        assert again.count() == whole.count()
    finally:
        spark.conf.set(key, threshold)
