"""Stream = batch: the streaming tables over log files equal the batch
tables over the same files."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tasklens.operators import metrics as M
from tasklens.plans.q_metrics import table_log
from tasklens.sources import eventlog as ev
from tasklens.streaming import eventlog_stream as S


def _files(spark):
    folder = S.scratch_path(spark, "test-logs")
    S.write_log_files(table_log(spark, SF_SMALL), folder, files_per_log=3)
    return folder


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_stream_index_stats_equal_batch(spark):
    folder = _files(spark)
    stream = S.read_event_log_stream(spark, folder, max_files_per_trigger=2)
    assert stream.isStreaming
    got = S.run_to_table(S.task_local_index_stats(stream), "complete")
    want = S.task_local_index_stats(ev.read_event_log(spark, folder))
    assert _rows(got) == _rows(want)


def test_windowed_stats_append(spark):
    folder = _files(spark)
    stream = S.read_event_log_stream(spark, folder, max_files_per_trigger=4)
    got = S.run_to_table(S.windowed_task_stats(stream, "30 days", "1 day"), "append")
    # all windows but the ones still open at the final watermark are emitted
    batch = (S.task_local_facts(ev.read_event_log(spark, folder))
             .groupBy(F.window("finish_ts", "30 days").alias("w"), "taskIndex").count())
    assert 0 < got.count() <= batch.count()


def test_ingest_then_batch_tables(spark):
    folder = _files(spark)
    out = S.scratch_path(spark, "ingested")
    q = S.ingest_event_log(S.read_event_log_stream(spark, folder, 2), out, out + "-ckpt")
    q.awaitTermination()
    back = spark.read.parquet(out)
    a = M.task_index_stats(back)
    b = M.task_index_stats(ev.read_event_log(spark, folder))
    assert _rows(a) == _rows(b)


def test_windowed_full_index_stats_equal_batch(spark):
    """Stream-stream joins + windowed stats equal the batch task table of all
    attempts grouped by the same windows, for every window the watermark
    closed. Without the jobs that share a stage of another one: the batch takes
    the latest job end, the stream the jobs that a task ran in."""
    from tasklens.operators.metrics import INDEX_STAT_METRICS, flat_tasks_full, index_stats
    from tasklens.sources.tablelog import SHARING
    job = F.get_json_object("value", "$['Job ID']").cast("bigint")
    folder = S.write_log_files(table_log(spark, SF_SMALL).where(F.coalesce(job < SHARING, F.lit(True))),
                               S.scratch_path(spark, "unshared"), files_per_log=3)
    stream = S.read_event_log_stream(spark, folder)
    got = S.run_to_table(S.windowed_index_stats(stream, bound="1 day", window="365 days"), "append")
    assert got.count() > 0
    lines = ev.read_event_log(spark, folder)
    full = flat_tasks_full(lines, stage_index=None, attempts="all",
                           columns=["taskId", "taskIndex", *INDEX_STAT_METRICS])
    batch = index_stats(_with_window(full, lines), ["window_start", "taskIndex"], INDEX_STAT_METRICS)
    keys = [(r.window_start, r.taskIndex) for r in got.collect()]
    want = {(r.window_start, r.taskIndex): r for r in batch.collect()}
    for r in got.collect():
        w = want[(r.window_start, r.taskIndex)]
        assert r["count"] == w["count"]
        assert abs(r.avg_sojournTime - w.avg_sojournTime) < 1e-6
        assert abs(r.avg_waitingTime - w.avg_waitingTime) < 1e-6
    assert len(keys) == len(set(keys))


def _with_window(full, lines):
    """Batch twin: the task table with its finish-time window."""
    t = ev.task_end_events(lines, ["task_id", "finish_ms"]).select(
        F.col("log").alias("app"), F.col("task_id").alias("taskId"),
        F.window(F.timestamp_millis("finish_ms"), "365 days").start.alias("window_start"))
    return full.join(t, ["app", "taskId"])


def test_ingest_restarts_exactly_once(spark):
    """Two runs of the same ingestion (same checkpoint): the second picks up
    only the files added since; every line lands once."""
    lines = table_log(spark, SF_SMALL).select("log", "value")
    folder = S.scratch_path(spark, "restart-logs")
    first = lines.where(F.col("log") < "3")
    second = lines.where(F.col("log") >= "3")
    S.write_log_files(first, folder, files_per_log=2)
    out = S.scratch_path(spark, "restart-out")
    ck = out + "-ckpt"
    S.ingest_event_log(S.read_event_log_stream(spark, folder), out, ck).awaitTermination()
    n1 = spark.read.parquet(out).count()
    assert n1 == first.count()
    # new logs arrive in their own folders (the first folders stay as they were)
    (second.repartition(2, "log").write.mode("append").partitionBy("log").text(folder))
    S.ingest_event_log(S.read_event_log_stream(spark, folder), out, ck).awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == lines.count()
    assert back.select("log", "value").distinct().count() == lines.count()   # no line twice


def test_windowed_joins_keep_their_rows_out_of_the_heap(spark):
    """A trigger over all files holds every task in the state of the joins."""
    import glob
    import os

    from tasklens.plans.catalog import QUERIES
    from tasklens.session import ensure_checkpoint_dir
    from tasklens.streaming import task_state as TS
    kept = f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/tasklens/stream-ckpt-*/state/*/*/*"
    seen, conf = set(glob.glob(kept)), spark.conf.get(TS.PROVIDER)
    QUERIES["M6w_stream_windowed_index_stats"](spark, SF_SMALL)
    new = {os.path.basename(f).split(".")[-1] for f in set(glob.glob(kept)) - seen}
    assert "zip" in new and "delta" not in new
    assert spark.conf.get(TS.PROVIDER) == conf
