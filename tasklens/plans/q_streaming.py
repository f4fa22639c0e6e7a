"""Registered queries of the streaming family (S2, M6): the table-derived
event log is written as log files under the session's checkpoint folder
and read back as a stream (``availableNow``), several files per trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import eventlog_stream as S
from .q_metrics import file_lines
from .registry import register, rounded


def _state_parts(spark) -> int:
    """State-store partitions: one per core of the session. The state here
    is small (aggregates per task index, join state of the table-derived
    log); on a cluster size it to the join state behind the watermark."""
    return spark.sparkContext.defaultParallelism


def _log_stream(spark, sf_dir, folder):
    S.write_log_files(file_lines(spark, sf_dir), folder)
    # several files for every core: a trigger has costs of its own
    return S.read_event_log_stream(spark, folder, max_files_per_trigger=max(3, 4 * _state_parts(spark)))


@register("S2_stream_event_counts")
def s2(spark, sf_dir):
    """Log files followed by byte offsets; events per app and type. The stream
    runs once over half of the lines, and again, from its checkpoint, when files
    with the rest have been added."""
    lines = file_lines(spark, sf_dir)
    half = F.pmod(F.xxhash64("job"), F.lit(2))
    folder, checkpoint = S.scratch_path(spark, "logs"), S.scratch_path(spark, "stream-ckpt")
    for k in (0, 1):
        S.write_log_files(lines.where(half == k), f"{folder}/part{k}")
        stream = S.read_event_log_stream(spark, folder, follow=True)
        counts = stream.groupBy(F.col("log").alias("app"), "event").agg(F.count(F.lit(1)).alias("n"))
        out = S.run_to_table(counts, "complete", checkpoint=checkpoint, state_partitions=_state_parts(spark))
    return out


@register("M6_stream_task_index_stats")
def m6(spark, sf_dir):
    """M6: per task index statistics of task-local metrics, kept by a streaming aggregation."""
    folder = S.scratch_path(spark, "logs")
    stats = S.task_local_index_stats(_log_stream(spark, sf_dir, folder))
    out = S.run_to_table(stats, "complete", state_partitions=_state_parts(spark))
    S.drop_scratch(spark, folder)        # the stream has ended, its result is a table
    return rounded(rounded(out, 3, prefix="var_"), 6)


@register("M6w_stream_windowed_index_stats")
def m6w(spark, sf_dir):
    """Full M6 on a stream: tasks joined to stage submissions and job ends
    (stream-stream joins), per-index statistics per 365-day window of
    finish time; append mode, one trigger over all files, all windows closed
    (the longest job of this log takes 21 seconds)."""
    from ..streaming import task_state as TS
    folder = S.scratch_path(spark, "logs")
    S.write_log_files(file_lines(spark, sf_dir), folder)
    S.write_flush_file(spark, folder)
    stream = S.read_event_log_stream(spark, folder)
    stats = S.windowed_index_stats(stream, bound="1 day", window="365 days")
    with TS.rocksdb_state(spark):        # the joins keep every task until the trigger's end
        out = S.run_to_table(stats, "append", state_partitions=_state_parts(spark))
    out = out.select(F.unix_millis("window_start").alias("window_start_ms"),
                     F.unix_millis("window_end").alias("window_end_ms"),
                     *[c for c in out.columns if c not in ("window_start", "window_end")])
    return rounded(rounded(out, 3, prefix="var_"), 6)


def _task_table(spark, sf_dir):
    """The task table kept by the stateful stream over log files, all stages sent on."""
    from ..streaming import task_state as TS
    folder = S.scratch_path(spark, "logs")
    S.write_log_files(file_lines(spark, sf_dir), folder)
    S.write_flush_file(spark, folder)
    # a second job of a stage ends up to 40 seconds after the first one here
    stream = TS.task_table_stream(S.read_event_log_stream(spark, folder, follow=True), linger_ms=60_000)
    with TS.rocksdb_state(spark):
        return S.run_to_table(stream, "append", state_partitions=_state_parts(spark), until_idle=True)


@register("M6t_stream_task_table")
def m6t(spark, sf_dir):
    """M6: the task table of a stream with state by stage (attempts, latest job
    end, waiting tasks; event-time timers): the rows of the batch table, also of
    retried stages and of stages that several jobs share."""
    return rounded(_task_table(spark, sf_dir).drop("finish_ms"))


@register("M6s_stream_stateful_index_stats")
def m6s(spark, sf_dir):
    """M6: the per-index statistics of A5 over the stateful stream's task table."""
    from ..operators.metrics import index_stats
    return rounded(rounded(index_stats(_task_table(spark, sf_dir)), 3, prefix="var_"), 6)
