"""Registered queries of the metric family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tablelog import ROW_KEY, orders_lineitem_lines, orders_lineitem_log
from ..session import spread
from .registry import register, rounded, tables


def table_log(spark, sf_dir, keep=None):
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return orders_lineitem_log(spread(orders, ["o_orderkey"]), spread(lineitem, ROW_KEY), keep)


def file_lines(spark, sf_dir):
    """The lines of ``table_log`` with their job, for writing them to log files."""
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return orders_lineitem_lines(spread(orders, ["o_orderkey"]), spread(lineitem, ROW_KEY))


@register("A5_task_index_stats")
def a5(spark, sf_dir):
    """A5 (flagship): per task index, count, mean and std-dev of 11 task metrics, from the orders/lineitem event log."""
    # var_* are square roots of variances summed in different orders by two
    # engines: compare them at 3 decimals
    df = M.task_index_stats(table_log(spark, sf_dir), stage_index=None)
    return rounded(rounded(df, 3, prefix="var_"), 6)


@register("M1_jobs")
def m1(spark, sf_dir):
    """M1: jobs (submission, stage ids, end) from the orders/lineitem event log."""
    return M.jobs(table_log(spark, sf_dir)).select(
        "app", "job_id", "submission_ms", "num_stages",
        F.array_join("stage_ids", ",").alias("stage_ids"), "end_ms")


@register("M2_stages")
def m2(spark, sf_dir):
    """M2: stages with the last submitted attempt and completion time."""
    return M.stages(table_log(spark, sf_dir))


@register("M3_job_stages")
def m3(spark, sf_dir):
    """M3: job id -> stage ids."""
    return M.job_stages(table_log(spark, sf_dir))


@register("M4_flat_tasks")
def m4(spark, sf_dir):
    """M4: the short task table (sojourn, waiting, service, ...) of all stages."""
    return rounded(M.flat_tasks(table_log(spark, sf_dir)))


@register("M5_flat_tasks_full")
def m5(spark, sf_dir):
    """M5: the 35-column task table of all stages."""
    return rounded(M.flat_tasks_full(table_log(spark, sf_dir), stage_index=None))


@register("U2_pool_stage2")
def u2(spark, sf_dir):
    """O2 + U2: the tasks of the 2nd stage of every app, pooled."""
    return rounded(M.pool_task_metrics(table_log(spark, sf_dir), stage_index=2))


@register("O2_nth_stage")
def o2(spark, sf_dir):
    """O2: the 3rd smallest known stage id of every app."""
    return M.nth_stage(table_log(spark, sf_dir), 3)


@register("S1_event_counts")
def s1(spark, sf_dir):
    """Every line parsed back; events per app and type."""
    lines = table_log(spark, sf_dir)
    ev = F.get_json_object("value", "$.Event")
    return lines.groupBy(F.col("log").alias("app"), ev.alias("event")).agg(
        F.count(F.lit(1)).alias("n"))


def log_files(spark, sf_dir, folder=None):
    """The table's log written as text files (several to a log, with a
    cut-off line in each log) and read back with the batch reader."""
    from ..sources.eventlog import read_event_log
    from ..streaming.eventlog_stream import scratch_path, write_log_files
    folder = folder or scratch_path(spark, "files")
    lines = file_lines(spark, sf_dir)
    (orders,) = tables(spark, sf_dir, "orders")
    cut = orders.select(F.col("o_orderpriority").alias("log")).distinct().coalesce(1).select(
        "log", F.lit('{"Event":"SparkListenerJobStart","Job ID":1,"Submission T').alias("value"),
        F.lit(0).cast("bigint").alias("job"))
    write_log_files(lines.unionByName(cut), folder)
    return read_event_log(spark, folder)


def split_log_files(spark, sf_dir):
    """``log_files`` scanned once and split into Parquet by event, without the order of
    the lines, which jobs and tasks do not need. The files are deleted then."""
    from ..sources.eventlog import split_events
    from ..streaming.eventlog_stream import drop_scratch, scratch_path
    folder = scratch_path(spark, "files")
    lines = split_events(log_files(spark, sf_dir, folder).drop("seq"))
    drop_scratch(spark, folder)
    return lines


@register("S1f_event_counts_files")
def s1f(spark, sf_dir):
    """S1 over log files, read by byte ranges: whole events per app and type; the cut-off lines count for nothing."""
    from ..sources import eventlog as ev
    names = ev.with_event(log_files(spark, sf_dir))
    whole = F.get_json_object("value", "$.Event")
    return (names.where(whole.isNotNull()).groupBy(F.col("log").alias("app"), "event")
            .agg(F.count(F.lit(1)).alias("n")))


@register("M1f_jobs_files")
def m1f(spark, sf_dir):
    """M1 over log files split into Parquet by event (a cut-off JobStart line is no job)."""
    return M.jobs(split_log_files(spark, sf_dir)).select(
        "app", "job_id", "submission_ms", "num_stages",
        F.array_join("stage_ids", ",").alias("stage_ids"), "end_ms")


@register("M5f_flat_tasks_files")
def m5f(spark, sf_dir):
    """M5 over log files, which are scanned once for all the events it joins."""
    return rounded(M.flat_tasks_full(split_log_files(spark, sf_dir), stage_index=None))


@register("A5m_task_index_stats_materialized")
def a5m(spark, sf_dir):
    """A5 over the log split once into Parquet partitioned by event (the
    layout for large log collections): each table reads only its event."""
    from ..sources import eventlog as ev
    from ..streaming.eventlog_stream import scratch_path
    path = scratch_path(spark, "events")
    ev.materialize_event_log(table_log(spark, sf_dir), path)
    lines = spark.read.parquet(path)
    df = M.task_index_stats(lines, stage_index=None)
    return rounded(rounded(df, 3, prefix="var_"), 6)


@register("M5k_flat_tasks_keep_incomplete")
def m5k(spark, sf_dir):
    """M5 with keep_incomplete=True: every task, also of jobs that never
    ended (their sojournTime is NULL)."""
    return rounded(M.flat_tasks_full(table_log(spark, sf_dir), stage_index=None, keep_incomplete=True))


@register("A5i_task_index_stats_incremental")
def a5i(spark, sf_dir):
    """A5 kept up as logs arrive: the moments of the first logs are written, those
    of the others added to them, and the old logs are not read again."""
    from ..session import written
    cols = ["taskIndex", *M.INDEX_STAT_METRICS]
    # both lots of logs are made of the same joined rows, which are shuffled once
    lines = table_log(spark, sf_dir, keep=written)
    kept = None
    for arrived in (F.col("log") < "3", F.col("log") >= "3"):
        tasks = M.flat_tasks_full(lines.where(arrived), stage_index=None, columns=cols)
        new = M.index_moments(tasks)
        kept = written(new if kept is None else M.merged_moments(kept.unionByName(new)))
    return rounded(rounded(M.moment_stats(kept), 3, prefix="var_"), 6)
