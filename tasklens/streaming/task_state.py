"""The task table of a log, kept by a stateful stream (M6).

Every stage of an application belongs to one key, and a key holds some stages: those
of a span of ``SPAN`` ids are dealt to ``SHARES`` keys by hash. So the stages of a
short log each have a key, and in a long one a key's few state calls serve many
stages, of ids that run at about the same time. The state of a key holds a row for
each stage (its last attempt with its submission, the latest end of the jobs that
list it, the time it is due), the tasks that have come, and the tasks that were found
waiting for a later end, by stage. When the event time has passed a stage's
latest end by ``linger``, a timer sends the waiting tasks of the last attempt on,
timed against its submission and that end: the same rows as ``operators.metrics``
makes of the whole log, also for retried stages and for stages that several jobs
share. A key has one timer, at the earliest time a stage of it is due; a task is read
when that comes, and once more if its own stage was due later.

Nothing is dropped for being late: only rows that serve as the clock carry an event
time, and they go no further than the watermark. Tasks that arrive after their stage
was sent on go on with the next timer, and a job that ends more than ``linger``
after the others changes later rows only. Tasks of a stage no job of which has ended
wait in the state.

A job's end names no stage, so jobs are joined to their ends first. That join
has no bound on time; its state is a row for each job and stage, not for each
task.

The log is scanned for a trigger three times: for jobs, for their ends, and once for
tasks, submissions and the clock. Python handles a task as a piece of JSON text, of
which it reads the stage and the attempt only; the numbers are taken apart by Spark, of
the rows that are sent on (one for a stage).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import INDEX_STAT_METRICS
from ..sources import eventlog as ev

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A join has one store for each partition, not four, and no write looks up whether its
#: key is new for a count of rows.
ROCKSDB_STATE = {PROVIDER: ROCKSDB, "spark.sql.streaming.join.stateFormatVersion": "3",
                 "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}

#: TaskEnd fields that the statistics need besides the three times.
TASK_METRICS = [m for m in INDEX_STAT_METRICS if m not in ("serviceTime", "sojournTime", "waitingTime")]
_TASK = ["task_id", "task_index", "launch_ms", "finish_ms", *TASK_METRICS]

OUT = T.StructType([
    T.StructField("app", S), T.StructField("taskId", L), T.StructField("stageId", L), T.StructField("taskIndex", I),
    T.StructField("finish_ms", L), *[T.StructField(c, D) for c in ("sojournTime", "waitingTime", "serviceTime")],
    *[T.StructField(m, L) for m in TASK_METRICS]])
#: Tasks of a stage as they are sent on: JSON of (id, submission, latest end) and of their lists.
SENT = T.StructType([T.StructField(c, S) for c in ("app", "stage", "tasks")])


#: Stage ids that share keys, keys that they are dealt to.
SPAN_BITS, SHARES = 14, 64
#: Tasks that are written to the state at once.
CHUNK = 4096


class TaskTable(StatefulProcessor):
    """Rows of some stages: kind 't' a task, 's' a submission, 'e' a job's end."""

    def __init__(self, linger_ms: int, chunk: int = CHUNK):
        self.linger, self.chunk = linger_ms, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        def struct(names, types):
            return T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
        self.handle = handle
        # the stages are one JSON list and tasks are lines of JSON, as ``stage_rows``
        # makes them: a value for each stage or task is slow
        self.stages = handle.getListState("stages", struct(["stages"], [S]))
        self.tasks = handle.getListState("tasks", struct(["tasks"], [S]))
        self.waiting = handle.getMapState("waiting", struct(["stage_id", "chunk"], [L, I]), struct(["tasks"], [S]))

    def known(self) -> dict[int, "_Stage"]:
        return {s[0]: _Stage(*s) for kept in self.stages.get() for s in json.loads(kept[0])}

    def keep(self, stages: dict[int, "_Stage"], timer: int | None) -> None:
        """Write the stages and let the key's timer, now at ``timer``, follow them."""
        due = min((s.due for s in stages.values() if s.due), default=None)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.stages.put([(json.dumps([astuple(s) for s in stages.values()]),)])

    def take(self, tasks: Iterable[str], facts: Iterable[tuple], timerValues) -> None:
        """Keep tasks and let ``facts`` (kind, stage, attempt, time) change their stages."""
        stages = self.known()
        timer = min((s.due for s in stages.values() if s.due), default=None)
        changed, some = set(), []
        for task in tasks:
            changed.add(int(task[1:task.index(",")]))
            some.append(task)
            if len(some) == self.chunk:
                self.tasks.appendValue(("\n".join(some),))
                some = []
        if some:
            self.tasks.appendValue(("\n".join(some),))
        for stage_id in changed - stages.keys():
            stages[stage_id] = _Stage(stage_id)
        for kind, stage_id, attempt, ms in facts:
            s = stages.get(stage_id)
            if s is None:
                s = stages[stage_id] = _Stage(stage_id)
            if kind == "s":
                if s.attempt is None or attempt >= s.attempt:
                    s.attempt, s.submission_ms = attempt, ms
            elif ms is None or (s.end_ms is not None and ms <= s.end_ms):
                continue
            else:
                s.end_ms = ms
            changed.add(stage_id)
        if not changed:
            return
        now = None
        for s in map(stages.__getitem__, changed):
            if s.end_ms is not None:
                now = now if now is not None else timerValues.getCurrentWatermarkInMs() + 1
                s.due = max(s.end_ms + self.linger, now)
        self.keep(stages, timer)

    def sent(self, timerValues, expiredTimerInfo) -> Iterator[list[tuple["_Stage", list[str]]]]:
        """The tasks of the stages that are due, by stage, a chunk of them at a time."""
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        stages, ready = self.known(), {}
        for s in stages.values():
            if s.due and s.due <= now:
                s.due = 0
                if s.attempt is not None:        # else the stage's own line has not come yet
                    ready[s.stage_id] = s
        later: dict[int, list] = {}
        for (chunk,) in self.tasks.get():
            groups: dict[int, list] = {}
            for task in chunk.split("\n"):
                stage_id, attempt, _ = task[1:].split(",", 2)
                stage_id = int(stage_id)
                s = ready.get(stage_id)
                if s is None:
                    rest = later.setdefault(stage_id, [])
                    rest.append(task)
                    if len(rest) == self.chunk:
                        self.wait(stages[stage_id], rest)
                        later[stage_id] = []
                elif int(attempt) == s.attempt:
                    groups.setdefault(stage_id, []).append(task)
            if groups:
                yield [(ready[i], tasks) for i, tasks in groups.items()]
        self.tasks.clear()
        for stage_id, rest in later.items():
            if rest:
                self.wait(stages[stage_id], rest)
        for s in ready.values():
            for n in range(s.chunks):
                waited = self.waiting.getValue((s.stage_id, n))[0].split("\n")
                tasks = [t for t in waited if int(t.split(",", 2)[1]) == s.attempt]
                if tasks:
                    yield [(s, tasks)]
                self.waiting.removeKey((s.stage_id, n))
            s.chunks = 0
        self.keep(stages, None)                  # the timer that has fired is gone

    def wait(self, stage: "_Stage", tasks: list) -> None:
        self.waiting.updateValue((stage.stage_id, stage.chunks), ("\n".join(tasks),))
        stage.chunks += 1

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        facts = []

        def tasks():
            at = None
            for r in rows:
                at = at or [r.__fields__.index(c) for c in ("kind", "stage_id", "attempt", "at_ms", "task")]
                kind, *fact, task = (r[i] for i in at)
                if kind == "t":
                    yield task
                elif kind != "c":
                    facts.append((kind, *fact))
        self.take(tasks(), facts, timerValues)   # the facts are complete behind the tasks
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for part in self.sent(timerValues, expiredTimerInfo):
            for s, tasks in part:
                for t in tasks:
                    yield _row(key[0], s, json.loads(t)[2:])

    def close(self) -> None:
        pass


class TaskTableText(TaskTable):
    """The same over pandas frames of (kind, fact): the rows' JSON from Spark and to it.
    Spark hands rows to Python cell by cell, and holds all that the timers of a
    partition send on; frames go by column, and each as it comes."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = []

        def tasks():
            for df in rows:
                kinds, texts = df["kind"].tolist(), df["fact"].tolist()
                yield from (t for k, t in zip(kinds, texts) if k == "t")
                facts.extend((k, *json.loads(t)) for k, t in zip(kinds, texts) if k in ("s", "e"))
        self.take(tasks(), facts, timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for part in self.sent(timerValues, expiredTimerInfo):
            yield pd.DataFrame({
                "app": [key[0]] * len(part),
                "stage": [json.dumps([s.stage_id, s.submission_ms, s.end_ms]) for s, _ in part],
                "tasks": [f"[{','.join(tasks)}]" for _, tasks in part]})


@dataclass
class _Stage:
    """What is known of a stage. ``attempt`` is the last one; ``due`` is 0 when it
    waits for nothing; ``chunks`` of its tasks wait apart from the others."""
    stage_id: int
    attempt: int | None = None
    submission_ms: int | None = None
    end_ms: int | None = None
    due: int = 0
    chunks: int = 0


_OUT_ROW = Row(*OUT.names)


def _row(app: str, stage: _Stage, task: list) -> Row:
    def span(a, b):
        return None if a is None or b is None else float(a - b)
    task_id, index, launch, finish, *metrics = task
    start, end = stage.submission_ms, stage.end_ms
    return _OUT_ROW(app, task_id, stage.stage_id, index, finish, span(end, start), span(launch, start),
                    span(finish, launch), *metrics)


_END, _SUBMITTED, _TASK_END = "SparkListenerJobEnd", "SparkListenerStageSubmitted", "SparkListenerTaskEnd"


def stage_rows(lines: DataFrame, watermark: str) -> DataFrame:
    """The rows of ``TaskTableText`` from streamed (or batch) lines: ``fact`` is a JSON
    list, of a task its stage, its attempt and the numbers of ``_TASK``, of the others
    their stage, attempt and time."""
    def fact(*cols) -> Column:
        return F.to_json(F.array(*[c.cast(L) for c in cols]))

    def attempt(col: Column) -> Column:
        return F.coalesce(col, F.lit(-1))
    info = [(("Stage Info", f), t) for f, t in (("Stage ID", L), ("Stage Attempt ID", I), ("Submission Time", L))]
    paths = {n: ev.TASK_FIELDS[n] for n in ("stage_id", "stage_attempt", *_TASK)}
    schema = ev.schema_for([(("Event",), S), (("Completion Time",), L), *info, *paths.values()])
    e = {n: F.col("e." + ".".join(f"`{p}`" for p in path)) for n, (path, _) in paths.items()}
    event, end = F.col("e.Event"), F.col("e.`Completion Time`")
    of_stage = [F.col(f"e.`Stage Info`.`{path[1]}`") for path, _ in info]
    rows = ev.parsed_once(ev.lines_of(lines, _TASK_END, _SUBMITTED, _END), ["log"], schema).select(
        # a job's end is the clock here, it needs no stage
        F.when(event == _TASK_END, "t").when(event == _SUBMITTED, "s").when(event == _END, "c").alias("kind"),
        F.col("log").alias("app"),
        F.when(event == _TASK_END, e["stage_id"]).when(event == _SUBMITTED, of_stage[0])
        .when(event == _END, -1).alias("stage_id"),
        F.when(event == _TASK_END, fact(e["stage_id"], attempt(e["stage_attempt"]), *[e[c] for c in _TASK]))
        .when(event == _SUBMITTED, fact(of_stage[0], attempt(of_stage[1]), of_stage[2])).alias("fact"),
        # a row without an event time is never late
        F.when(event == _END, F.timestamp_millis(end)).alias("ts"))
    listed = ev.job_start_events(lines).select(
        F.col("log").alias("app"), "job_id", F.explode("stage_ids").alias("stage_id"))
    ended = ev.job_end_events(lines).select(
        F.col("log").alias("e_app"), F.col("job_id").alias("e_job"), F.col("end_ms").alias("at_ms"))
    ends = listed.join(ended, (F.col("app") == F.col("e_app")) & (F.col("job_id") == F.col("e_job"))).select(
        F.lit("e").alias("kind"), "app", "stage_id", fact(F.col("stage_id"), F.lit(None), F.col("at_ms")).alias("fact"),
        F.lit(None).cast("timestamp").alias("ts"))
    # a stage without an id is no job's
    return rows.unionByName(ends).where("kind IS NOT NULL AND stage_id IS NOT NULL").withWatermark("ts", watermark)


def _unpacked(sent: DataFrame) -> DataFrame:
    """The rows of ``OUT``, of the tasks that were sent on by stage."""
    numbers = T.ArrayType(T.ArrayType(L))
    t = sent.select("app", F.from_json("stage", T.ArrayType(L)).alias("s"), F.from_json("tasks", numbers).alias("tasks"))
    t = t.select("app", "s", F.explode("tasks").alias("t"))
    of = {c: F.col("t")[i + 2] for i, c in enumerate(_TASK)}
    stage_id, start, end = (F.col("s")[i] for i in range(3))
    cols = {"app": F.col("app"), "taskId": of["task_id"], "stageId": stage_id, "taskIndex": of["task_index"],
            "finish_ms": of["finish_ms"], "sojournTime": end - start, "waitingTime": of["launch_ms"] - start,
            "serviceTime": of["finish_ms"] - of["launch_ms"], **{m: of[m] for m in TASK_METRICS}}
    return t.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in OUT])


def task_table_stream(lines: DataFrame, linger_ms: int, watermark: str = "1 second",
                      shares: int = SHARES, chunk: int = CHUNK) -> DataFrame:
    """Stream of the task table's rows that the statistics need: ``OUT``.

    ``linger_ms``: event time that a stage waits after the latest end of its jobs
    for another job that shares it; ``watermark``: the delay of the clock;
    ``shares``: keys to which the stages of a span of ids are dealt; ``chunk``: tasks
    of a value of the state."""
    # the clock has done its work; a filter on the event time stays behind the watermark
    rows = (stage_rows(lines, watermark).where(F.col("ts").isNull())
            .withColumn("span", F.shiftright("stage_id", SPAN_BITS))
            .withColumn("share", F.pmod(F.xxhash64("stage_id"), F.lit(shares))))
    return _unpacked(rows.drop("stage_id").groupBy("app", "span", "share").transformWithStateInPandas(
        TaskTableText(linger_ms, chunk), SENT, outputMode="Append", timeMode="EventTime"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that ``transformWithState`` needs, for a query begun within; it
    also keeps the rows of joins out of the heap."""
    before = {key: spark.conf.get(key, None) for key in ROCKSDB_STATE}
    for key, value in ROCKSDB_STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
