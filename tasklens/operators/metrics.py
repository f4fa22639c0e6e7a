"""Job, stage and task tables from event-log lines, and per-index statistics.

Input everywhere: the raw ``(log, value)`` lines of ``sources.eventlog``
(or of ``sources.tablelog``). All work is joins and aggregates; nothing is
collected. The task table is the big side of every join; the stage tables
are small per log, and AQE picks a broadcast when their runtime size allows
(``spark.sql.autoBroadcastJoinThreshold``), else a sort-merge join with
skew splitting of a hot stage.

Definitions (milliseconds, as in the logs):
  sojournTime = job end - stage submission
  waitingTime = task launch - stage submission
  serviceTime = task finish - task launch
  local       = locality == 'PROCESS_LOCAL'
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import eventlog as ev

# Column names and order of the task tables and of the
# per-index statistics, as the original defines them.

#: Columns of the full task table, in order (after ``app``).
FULL_TASK_COLUMNS = [
    "taskId", "stageId", "taskIndex", "executorId", "host", "local",
    "sojournTime", "waitingTime", "serviceTime",
    "executorDeserializeTime", "executorDeserializeCpuTime", "executorRunTime",
    "executorCpuTime", "resultSize", "jvmGcTime", "resultSerializationTime",
    "memoryBytesSpilled", "diskBytesSpilled", "peakExecutionMemory",
    "bytesRead", "recordsRead", "bytesWritten", "recordsWritten",
    "shuffleRemoteBlocksFetched", "shuffleLocalBlocksFetched", "shuffleTotalBlocksFetched",
    "shuffleFetchWaitTime", "shuffleRemoteBytesRead", "shuffleLocalBytesRead",
    "shuffleTotalBytesRead", "shuffleRemoteBytesReadToDisk", "shuffleRecordsRead",
    "shuffleBytesWritten", "shuffleWriteTime", "shuffleRecordsWritten",
]

#: Metrics summarised per task index, in output order.
INDEX_STAT_METRICS = [
    "serviceTime", "sojournTime", "waitingTime", "jvmGcTime",
    "executorDeserializeTime", "executorRunTime", "resultSerializationTime",
    "shuffleFetchWaitTime", "shuffleWriteTime", "executorDeserializeCpuTime",
    "executorCpuTime",
]


# ------------------------------------------------------------------ M1-M3

def jobs(lines: DataFrame) -> DataFrame:
    """M1: ``(app, job_id, submission_ms, num_stages, stage_ids, end_ms)``.

    ``end_ms`` is NULL while a job has no JobEnd line.
    """
    starts = ev.job_start_events(lines)
    ends = (ev.job_end_events(lines).groupBy("log", "job_id")
            .agg(F.max("end_ms").alias("end_ms")))
    return (starts.join(ends, ["log", "job_id"], "left")
            .select(F.col("log").alias("app"), "job_id", "submission_ms",
                    F.size("stage_ids").alias("num_stages"), "stage_ids", "end_ms"))


def job_stages(lines: DataFrame) -> DataFrame:
    """M3: ``(app, job_id, stage_id)``, one row per stage id of a JobStart."""
    return (ev.job_start_events(lines)
            .select(F.col("log").alias("app"), "job_id",
                    F.explode("stage_ids").alias("stage_id")))


def stages(lines: DataFrame) -> DataFrame:
    """M2: ``(app, stage_id, attempt, submission_ms, completion_ms)``.

    One row per stage id known to the log: the last submitted attempt, and
    stage ids that a JobStart lists but that were never submitted (skipped
    stages, NULL attempt and times).
    """
    last = _last_submissions(lines)
    done = (ev.stage_events(lines, completed=True)
            .groupBy("log", "stage_id", "attempt")
            .agg(F.max("completion_ms").alias("completion_ms"))
            .withColumnRenamed("log", "app"))
    submitted = last.join(done, ["app", "stage_id", "attempt"], "left")
    listed = job_stages(lines).select("app", "stage_id").distinct()
    skipped = (listed.join(submitted.select("app", "stage_id"), ["app", "stage_id"], "left_anti")
               .select("app", "stage_id", F.lit(None).cast("int").alias("attempt"),
                       F.lit(None).cast("bigint").alias("submission_ms"),
                       F.lit(None).cast("bigint").alias("completion_ms")))
    return submitted.unionByName(skipped)


def nth_stage(lines: DataFrame, stage_index: int = 1) -> DataFrame:
    """O2: per app, the ``stage_index``-th smallest known stage id (1-based).

    Known ids include skipped stages, as a JobStart enrols all its ids.
    An index beyond the number of stages selects nothing.
    """
    if stage_index < 1:
        raise ValueError("stage_index is 1-based")
    listed = job_stages(lines).select("app", "stage_id")
    submitted = ev.stage_events(lines).select(F.col("log").alias("app"), "stage_id")
    known = listed.unionByName(submitted).distinct()
    w = Window.partitionBy("app").orderBy("stage_id")
    return (known.withColumn("_k", F.row_number().over(w))
            .where(F.col("_k") == stage_index).drop("_k"))


def _last_submissions(lines: DataFrame) -> DataFrame:
    """``(app, stage_id, attempt, submission_ms)`` of the last submitted
    attempt; scalar ``max``/``max_by`` keep it a hash aggregate."""
    return (ev.stage_events(lines).groupBy("log", "stage_id")
            .agg(F.max("attempt").alias("attempt"),
                 F.max_by("submission_ms", "attempt").alias("submission_ms"))
            .withColumnRenamed("log", "app"))


def _stage_facts(lines: DataFrame, per_attempt: bool = False) -> DataFrame:
    """Per submitted stage: last attempt, submission and the job end
    (``per_attempt``: one row per submitted attempt with its own submission).

    A stage shared by several jobs takes the latest end of them; a stage
    of jobs that have not ended has a NULL end.
    """
    listed = ev.job_start_events(lines).select(
        F.col("log").alias("app"), "job_id", F.explode("stage_ids").alias("stage_id"))
    ended = (ev.job_end_events(lines).groupBy("log", "job_id")
             .agg(F.max("end_ms").alias("end_ms")).withColumnRenamed("log", "app"))
    ends = (listed.join(ended, ["app", "job_id"])
            .groupBy("app", "stage_id").agg(F.max("end_ms").alias("end_ms")))
    if per_attempt:
        subs = (ev.stage_events(lines).groupBy("log", "stage_id", "attempt")
                .agg(F.max("submission_ms").alias("submission_ms"))
                .withColumnRenamed("log", "app"))
    else:
        subs = _last_submissions(lines)
    return subs.join(ends, ["app", "stage_id"], "left")


#: Raw TaskEnd fields each task-table column needs.
_NEEDS = {
    "taskId": ["task_id"], "stageId": [], "taskIndex": ["task_index"],
    "executorId": ["executor_id"], "host": ["host"], "local": ["locality"],
    "sojournTime": [], "waitingTime": ["launch_ms"], "serviceTime": ["launch_ms", "finish_ms"],
    "shuffleTotalBlocksFetched": ["shuffleRemoteBlocksFetched", "shuffleLocalBlocksFetched"],
    "shuffleTotalBytesRead": ["shuffleRemoteBytesRead", "shuffleLocalBytesRead"],
    "deserializationTime": ["executorDeserializeTime"], "runtime": ["executorCpuTime"],
}


def _raw_fields(columns: list[str], successful_only: bool) -> list[str]:
    raw = ["stage_id", "stage_attempt"] + (["failed", "killed"] if successful_only else [])
    for c in columns:
        for f in _NEEDS.get(c, [c]):
            if f not in raw:
                raw.append(f)
    return raw


def _tasks_with_stage(lines: DataFrame, attempts: str, keep_incomplete: bool,
                      successful_only: bool, stage_index: int | None,
                      columns: list[str]) -> DataFrame:
    tasks = (ev.task_end_events(lines, _raw_fields(columns, successful_only))
             .withColumnRenamed("log", "app"))
    if successful_only:
        tasks = tasks.where(~F.coalesce(F.col("failed"), F.lit(False))
                            & ~F.coalesce(F.col("killed"), F.lit(False)))
    if attempts not in ("last", "all"):
        raise ValueError("attempts must be 'last' or 'all'")
    # 'last': only tasks of the last submitted attempt; 'all': every task,
    # timed against the submission of its own attempt
    facts = _stage_facts(lines, per_attempt=attempts == "all")
    if stage_index is not None:
        facts = facts.join(nth_stage(lines, stage_index), ["app", "stage_id"], "left_semi")
    facts = facts.withColumnRenamed("attempt", "stage_attempt")
    out = tasks.join(facts, ["app", "stage_id", "stage_attempt"])
    if not keep_incomplete:
        out = out.where(F.col("end_ms").isNotNull())
    return out


def _times(df: DataFrame) -> dict[str, Column]:
    c = F.col
    return {
        "sojournTime": (c("end_ms") - c("submission_ms")).cast("double"),
        "waitingTime": (c("launch_ms") - c("submission_ms")).cast("double"),
        "serviceTime": (c("finish_ms") - c("launch_ms")).cast("double"),
    }


def flat_tasks(lines: DataFrame, attempts: str = "last", keep_incomplete: bool = False,
               successful_only: bool = False) -> DataFrame:
    """M4: the short task table of all stages (``FlatTask`` columns + app).

    ``schedulerOverhead`` and ``readTime`` are the constant 0.0 and
    ``runtime`` is the executor CPU time (ns), as in the original table.
    """
    cols = ["taskId", "host", "local", "sojournTime", "waitingTime", "serviceTime",
            "deserializationTime", "runtime"]
    t = _tasks_with_stage(lines, attempts, keep_incomplete, successful_only, None, cols)
    tm = _times(t)
    return t.select(
        "app", F.col("task_id").alias("taskId"), F.col("stage_id").alias("stageId"),
        "host", (F.col("locality") == "PROCESS_LOCAL").alias("local"),
        tm["sojournTime"].alias("sojournTime"), tm["waitingTime"].alias("waitingTime"),
        tm["serviceTime"].alias("serviceTime"),
        F.col("executorDeserializeTime").cast("double").alias("deserializationTime"),
        F.lit(0.0).alias("schedulerOverhead"),
        F.col("executorCpuTime").cast("double").alias("runtime"),
        F.lit(0.0).alias("readTime"))


def flat_tasks_full(lines: DataFrame, stage_index: int | None = 1,
                    attempts: str = "last", keep_incomplete: bool = False,
                    successful_only: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The 35-column task table of the ``stage_index``-th stage of
    every log (``None``: all stages), pooled over all logs read.

    ``columns`` selects a subset (only their fields are parsed)."""
    columns = list(columns) if columns else list(FULL_TASK_COLUMNS)
    t = _tasks_with_stage(lines, attempts, keep_incomplete, successful_only, stage_index, columns)
    tm = _times(t)
    c = F.col
    derived = {
        "taskId": c("task_id"), "stageId": c("stage_id"), "taskIndex": c("task_index"),
        "executorId": c("executor_id"), "host": c("host"),
        "local": c("locality") == "PROCESS_LOCAL",
        "shuffleTotalBlocksFetched": c("shuffleRemoteBlocksFetched") + c("shuffleLocalBlocksFetched"),
        "shuffleTotalBytesRead": c("shuffleRemoteBytesRead") + c("shuffleLocalBytesRead"),
        **tm,
    }
    cols = [derived[n].alias(n) if n in derived else c(n) for n in columns]
    return t.select("app", *cols)


def pool_task_metrics(lines: DataFrame, stage_index: int = 1, **kw) -> DataFrame:
    """The ``stage_index``-th stage's tasks of every run read, pooled.

    Many runs are read in one scan (a glob over their logs); the stage index
    is resolved per log (``app``); nothing is collected on the driver."""
    return flat_tasks_full(lines, stage_index=stage_index, **kw)


# ------------------------------------------------------------------ A5

def index_stats(df: DataFrame, by: str | list[str] = "taskIndex",
                metrics: list[str] | None = None, std_alias: bool = False) -> DataFrame:
    """Per group: ``count`` of the first metric, then ``avg_<m>`` and
    ``var_<m>`` for every metric. ``var_<m>`` holds the sample standard
    deviation (the square root of the sample variance), as the original
    column names do; ``std_alias=True`` adds ``std_<m>`` twins.

    One partial + final hash aggregate; a hot index is combined map-side.
    """
    metrics = metrics or INDEX_STAT_METRICS
    by = [by] if isinstance(by, str) else list(by)
    aggs = [F.count(metrics[0]).alias("count")]
    for m in metrics:
        aggs.append(F.avg(m).alias(f"avg_{m}"))
        aggs.append(F.sqrt(F.var_samp(m)).alias(f"var_{m}"))
        if std_alias:
            aggs.append(F.stddev_samp(m).alias(f"std_{m}"))
    return df.select(*by, *metrics).groupBy(*by).agg(*aggs)


def index_moments(df: DataFrame, by: str | list[str] = "taskIndex", metrics: list[str] | None = None) -> DataFrame:
    """A5 in a form that can be kept and added to: ``(by..., metric, n, mean, m2)``,
    m2 the sum of squared deviations. Written for every new log, and merged by
    ``merged_moments``, it gives the statistics of all logs without reading the old
    ones again."""
    metrics = metrics or INDEX_STAT_METRICS
    by = [by] if isinstance(by, str) else list(by)
    aggs = []
    for m in metrics:
        n = F.count(m)
        aggs.append(F.struct(F.lit(m).alias("metric"), n.alias("n"), F.avg(m).alias("mean"),
                             (F.coalesce(F.var_pop(m), F.lit(0.0)) * n).alias("m2")).alias(f"_tl_{m}"))
    wide = df.select(*by, *metrics).groupBy(*by).agg(*aggs)
    return wide.select(*by, F.inline(F.array(*[f"_tl_{m}" for m in metrics])))


def merged_moments(moments: DataFrame) -> DataFrame:
    """Moments of several tables as one: the mean of the means weighted by count,
    and m2 with each part's distance from it, so that large means cost no digits."""
    by = [c for c in moments.columns if c not in ("n", "mean", "m2")]
    w = Window.partitionBy(*by)
    weighted = F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))).over(w)
    centred = moments.withColumn("_tl_mean", weighted / F.nullif(F.sum("n").over(w), F.lit(0)))
    off = F.col("mean") - F.col("_tl_mean")
    return centred.groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_tl_mean").alias("mean"),
        F.coalesce(F.sum(F.col("m2") + F.coalesce(F.col("n") * off * off, F.lit(0.0))), F.lit(0.0)).alias("m2"))


def moment_stats(moments: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """The columns of ``index_stats`` from moments with one row for each metric."""
    metrics = metrics or INDEX_STAT_METRICS
    by = [c for c in moments.columns if c not in ("metric", "n", "mean", "m2")]

    def of(metric: str, value: Column) -> Column:
        return F.max(F.when(F.col("metric") == metric, value))

    aggs = [F.coalesce(of(metrics[0], F.col("n")), F.lit(0)).alias("count")]
    for m in metrics:
        aggs.append(of(m, F.col("mean")).alias(f"avg_{m}"))
        aggs.append(F.sqrt(of(m, F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)))).alias(f"var_{m}"))
    return moments.groupBy(*by).agg(*aggs)


def task_index_stats(lines: DataFrame, stage_index: int | None = None) -> DataFrame:
    """A5 over M5: the flagship per-task-index summary (24 columns)."""
    cols = ["taskIndex", *INDEX_STAT_METRICS]
    return index_stats(flat_tasks_full(lines, stage_index=stage_index, columns=cols))
