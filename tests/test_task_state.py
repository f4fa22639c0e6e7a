"""The stateful task-table stream: equal to the batch table, whatever order and
triggers the lines come in; placement at run time against brute force."""

import json
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tasklens.operators import metrics as M
from tasklens.operators import placement as P
from tasklens.plans.q_metrics import table_log
from tasklens.sources import eventlog as ev
from tasklens.streaming import eventlog_stream as S
from tasklens.streaming import task_state as TS


def event(name, **more):
    return json.dumps({"Event": f"SparkListener{name}", **more})


def job(i, start, stages, end=None):
    out = [event("JobStart", **{"Job ID": i, "Submission Time": start, "Stage IDs": stages})]
    return out + ([event("JobEnd", **{"Job ID": i, "Completion Time": end})] if end else [])


def submitted(stage, attempt, at):
    return event("StageSubmitted", **{"Stage Info": {"Stage ID": stage, "Stage Attempt ID": attempt, "Submission Time": at}})


def task(i, stage, attempt, launch, finish):
    return event("TaskEnd", **{"Stage ID": stage, "Stage Attempt ID": attempt, "Task Metrics": {"JVM GC Time": i},
                               "Task Info": {"Task ID": i, "Index": i % 3, "Launch Time": launch, "Finish Time": finish}})


LINES = [*job(1, 1000, [1, 2], 9000), *job(2, 9500, [2], 12000), *job(3, 100, [3]),
         submitted(1, 0, 1100), submitted(1, 1, 1500), submitted(2, 0, 5000), submitted(3, 0, 200),
         task(1, 1, 0, 1200, 1300), task(2, 1, 1, 1600, 1700), task(3, 1, 1, 1600, 1800),   # attempt 0 is stale
         task(4, 2, 0, 5100, 5200), task(5, 2, 0, 5100, 5300), task(6, 3, 0, 300, 400)]     # job 3 runs on


def run(spark, folder, checkpoint, linger=60_000):
    stream = TS.task_table_stream(S.read_event_log_stream(spark, str(folder), follow=True), linger)
    with TS.rocksdb_state(spark):
        return S.run_to_table(stream, "append", checkpoint=checkpoint, state_partitions=2, until_idle=True)


def rows(df):
    return sorted((r.taskId, r.sojournTime, r.waitingTime, r.serviceTime) for r in df.collect())


WANT = [(2, 7500.0, 100.0, 100.0), (3, 7500.0, 100.0, 200.0), (4, 7000.0, 100.0, 100.0), (5, 7000.0, 100.0, 200.0)]


def test_retried_and_shared_stages_in_any_order_of_lines(spark, tmp_path):
    """One file a trigger, in a random order: nothing is late, nothing is doubled."""
    for seed in (1, 2):
        lines, folder, ck = LINES[:], tmp_path / f"logs{seed}", str(tmp_path / f"ck{seed}")
        random.Random(seed).shuffle(lines)
        folder.mkdir()
        sent = []
        for k in range(0, len(lines), 6):
            (folder / f"log=a{k}").mkdir()
            (folder / "app").open("a").write("".join(x + "\n" for x in lines[k:k + 6]))
            sent += rows(run(spark, folder, ck))
        S.write_flush_file(spark, str(folder))
        sent += rows(run(spark, folder, ck))
        assert sorted(sent) == WANT


def test_stages_of_one_key_are_due_at_different_times(spark, tmp_path):
    """Stages share a key; the tasks of one that is due later wait apart, in chunks."""
    folder, ck = tmp_path / "logs", str(tmp_path / "ck")
    folder.mkdir()
    lines = LINES + [event("JobEnd", **{"Job ID": 3, "Completion Time": 1_000_000})]
    lines += [task(10 + i, 3, 0, 300, 400 + i) for i in range(7)]
    # a clock between the ends of jobs 1 and 2 and that of job 3
    (folder / "app").write_text("".join(x + "\n" for x in lines[:-8] + lines[-7:]))
    (folder / "log=tick").mkdir()
    (folder / "log=tick" / "x").write_text("\n".join(job(0, 1, [9], 200_000)) + "\n")

    def go():
        stream = TS.task_table_stream(S.read_event_log_stream(spark, str(folder), follow=True), 60_000, shares=1, chunk=2)
        with TS.rocksdb_state(spark):
            return rows(S.run_to_table(stream, "append", checkpoint=ck, state_partitions=2, until_idle=True))

    assert go() == WANT
    with (folder / "app").open("a") as f:
        f.write(lines[-8] + "\n")
    (folder / "log=tick" / "y").write_text("\n".join(job(4, 1, [9], 1_010_000)) + "\n")
    assert go() == []                               # not due yet
    S.write_flush_file(spark, str(folder))
    third = [(6, 999800.0, 100.0, 100.0)] + [(10 + i, 999800.0, 100.0, 100.0 + i) for i in range(7)]
    assert go() == sorted(third)


def test_state_calls_do_not_grow_with_the_stages_of_a_key():
    """A trigger and a timer take a fixed number of state calls, and a task that waits
    for its own stage is read once more, not with every timer (F9, F10)."""
    from types import SimpleNamespace as N
    from pyspark.sql import Row
    calls, timers = [], []

    class State:
        def __init__(self):
            self.data, self.read = {None: []}, 0
        def get(self):
            calls.append("get")
            return iter(list(self.data[None]))
        def put(self, rows):
            calls.append("put")
            self.data[None] = list(rows)
        def appendValue(self, row):
            calls.append("append")
            self.data[None].append(row)
        def clear(self):
            calls.append("clear")
            self.data[None] = []
        def updateValue(self, k, v):
            calls.append("update")
            self.data[k] = v
        def getValue(self, k):
            calls.append("value")
            return self.data[k]
        def removeKey(self, k):
            calls.append("remove")
            del self.data[k]

    state = {}
    make = lambda name, *_: state.setdefault(name, State())
    table = TS.TaskTable(1000)
    table.init(N(getListState=make, getMapState=make, registerTimer=lambda t: (calls.append("timer"), timers.append(t)),
                 deleteTimer=lambda t: (calls.append("timer"), timers.remove(t))))
    n, one = 200, Row("kind", "stage_id", "attempt", "at_ms", "task")
    tail = ", null" * len(TS.TASK_METRICS)
    given = [one("t", i, 0, None, f"[{i}, 0, {i}, 1, 20, 30{tail}]") for i in range(n)]
    given += [one("s", i, 0, 10, None) for i in range(n)]
    given += [one("e", i, None, 100 if i < n - 1 else 9000, None) for i in range(n)]
    assert list(table.handleInputRows(("a", 0, 0), iter(given), N(getCurrentWatermarkInMs=lambda: 0))) == []
    assert len(calls) < 8 and timers == [1100]
    for due, want in ((1100, list(range(n - 1))), (10000, [n - 1])):
        calls.clear()
        assert timers.pop() == due
        clock, fired = N(getCurrentWatermarkInMs=lambda d=due: d), N(getExpiryTimeInMs=lambda d=due: d)
        assert [r.taskId for r in table.handleExpiredTimer(("a", 0, 0), clock, fired)] == want
        assert len(calls) < 10
    assert timers == []


def test_tasks_after_their_stage_was_sent_on_go_on_later(spark, tmp_path):
    folder, ck = tmp_path / "logs", str(tmp_path / "ck")
    folder.mkdir()
    early = [x for x in LINES if '"Task ID": 5' not in x]
    (folder / "app").write_text("".join(x + "\n" for x in early))
    S.write_flush_file(spark, str(folder))
    first = rows(run(spark, folder, ck))
    with (folder / "app").open("a") as f:
        f.write(next(x for x in LINES if '"Task ID": 5' in x) + "\n")
    (folder / "log=tick").mkdir()
    (folder / "log=tick" / "x").write_text("\n".join(job(0, 1, [9], 32503680009000)) + "\n")
    assert sorted(first + rows(run(spark, folder, ck))) == WANT


def test_stream_equals_batch_on_the_table_log(spark):
    folder = S.write_log_files(table_log(spark, SF_SMALL), S.scratch_path(spark, "state"), files_per_log=2)
    S.write_flush_file(spark, folder)
    got = run(spark, folder, S.scratch_path(spark, "state-ck"))
    want = M.flat_tasks_full(table_log(spark, SF_SMALL), stage_index=None).select(*[c for c in got.columns if c != "finish_ms"])
    got = got.drop("finish_ms")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_a_trigger_scans_the_log_three_times(spark):
    """Tasks, submissions and the clock come from one scan, jobs and their ends from one
    each; every scan reads all of the log (F1, F2)."""
    lines = spark.createDataFrame([("a", x) for x in LINES], "log string, value string")
    rows = TS.stage_rows(lines, "1 second")
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3
    assert rows.groupBy("kind").count().rdd.collectAsMap() == {"t": 6, "s": 4, "c": 2, "e": 3}


def test_tasks_are_sent_on_as_text_of_their_stage(spark):
    """The state's rows of a stage are one row, not one for each task, in frames that
    leave the worker as they come (F1, F2); what is missing in a line stays NULL."""
    sent = spark.createDataFrame([("a", "[7,null,90]", f"[[7,0,1,2,20,30{',null' * len(TS.TASK_METRICS)}]]"),
                                  ("a", "[8,10,90]", f"[[8,0,2,2,20,30{',5' * len(TS.TASK_METRICS)}],"
                                                     f"[8,0,3,2,null,30{',5' * len(TS.TASK_METRICS)}]]")], TS.SENT)
    out = TS._unpacked(sent)
    assert out.schema == TS.OUT
    got = [(r.taskId, r.stageId, r.sojournTime, r.waitingTime, r.serviceTime, r.jvmGcTime)
           for r in out.orderBy("taskId").collect()]
    assert got == [(1, 7, None, None, 10.0, None), (2, 8, 80.0, 10.0, 10.0, 5), (3, 8, 80.0, None, None, 5)]
    table = TS.TaskTableText(1000)
    stages = [(TS._Stage(i), [f"[{i},0,{k}]" for k in range(50)]) for i in (1, 2)]
    table.sent = lambda *_: iter([stages])
    frames = list(table.handleExpiredTimer(("a", 0, 0), None, None))
    assert [len(f) for f in frames] == [2] and list(frames[0].columns) == TS.SENT.names


def test_lines_without_a_stage_or_an_event_are_no_rows(spark):
    odd = [event("TaskEnd", **{"Task Info": {"Task ID": 1}}), event("StageSubmitted"), '{"Event":"SparkListenerTaskEnd","Sta',
           event("Other", note="SparkListenerTaskEnd"), event("TaskEnd", **{"Stage ID": 5}), event("JobEnd", **{"Job ID": 1})]
    rows = TS.stage_rows(spark.createDataFrame([("a", x) for x in odd], "log string, value string"), "1 second")
    nulls = ",null" * len(TS._TASK)
    assert sorted((r.kind, r.stage_id, r.fact) for r in rows.collect()) == [("c", -1, None), ("t", 5, f"[5,-1{nulls}]")]


# ------------------------------------------------------------------ as-of

def test_last_as_of_in_blocks_matches_brute_force(spark):
    r = random.Random(3)
    ups = [(r.choice([1, 1, 1, 2, None]), s, f"s{s}") for s in r.sample(range(2000), 600)]
    probes = [(r.choice([1, 1, 2, 3, None]), s, i) for i, s in enumerate(r.choices(range(-5, 2100), k=500))]
    u = spark.createDataFrame(ups, "k int, seq long, state string")
    p = spark.createDataFrame(probes, "k int, seq long, i int")
    want = {}
    for k, s, i in probes:
        before = [(t, v) for kk, t, v in ups if kk == k and k is not None and t < s]
        want[i] = max(before)[1] if before else None
    for block_rows in (10, 10**6):
        got = P.last_as_of(u.where("k IS NOT NULL"), p, ["k"], "seq", ["state"], block_rows=block_rows)
        assert {x.i: x.state for x in got.collect()} == want


def update(block, executor, mem, seq):
    level = {"Use Disk": False, "Use Memory": mem > 0, "Use Off Heap": False, "Deserialized": False, "Replication": 1}
    return ("a", event("BlockUpdated", **{"Block Updated Info": {
        "Block Manager ID": {"Executor ID": executor, "Host": "h", "Port": 1}, "Block ID": block,
        "Storage Level": level, "Memory Size": mem, "Disk Size": 0}}), seq)


def test_placement_when_a_task_starts(spark):
    def stage(i, seq, rdds):
        info = [{"RDD ID": r, "Name": "x", "Storage Level": {"Use Memory": True, "Use Disk": False}} for r in rdds]
        return ("a", event("StageSubmitted", **{"Stage Info": {"Stage ID": i, "Stage Attempt ID": 0, "RDD Info": info}}), seq)

    def start(i, st, seq):
        return ("a", event("TaskStart", **{"Stage ID": st, "Stage Attempt ID": 0, "Task Info": {"Task ID": i}}), seq)

    def end(i, st, part, seq):
        return ("a", event("TaskEnd", **{"Stage ID": st, "Stage Attempt ID": 0, "Task Info": {
            "Task ID": i, "Partition ID": part, "Executor ID": "9"}}), seq)

    gone = ("a", event("UnpersistRDD", **{"RDD ID": 5}), 50)
    lines = [update("rdd_5_0", "1", 10, 1), stage(1, 2, [5]), update("rdd_5_0", "2", 11, 3), start(1, 1, 4),
             update("rdd_5_0", "1", 0, 5), end(1, 1, 0, 6),            # held by 1 and 2 when task 1 starts
             start(2, 1, 7), end(2, 1, 0, 8),                          # dropped from 1
             end(3, 1, 1, 9),                                          # no TaskStart line, nobody holds partition 1
             stage(2, 10, []), start(4, 2, 11), end(4, 2, 0, 12),      # no cached RDD
             gone, stage(3, 51, [5]), start(5, 3, 52), update("rdd_5_0", "3", 7, 53), start(6, 3, 54),
             end(5, 3, 0, 55), end(6, 3, 0, 56)]
    df = spark.createDataFrame(lines, "log string, value string, seq long")

    def held(at):
        out = P.placement_as_of(df, at, block_rows=3)
        return sorted((r.task_id, r.rdd_id, r.storage_executor, r.memsize) for r in out.collect())

    def ordered(*x):
        return sorted(x, key=str)
    assert sorted(held("task"), key=str) == ordered(
        (1, 5, "1", 10), (1, 5, "2", 11), (2, 5, "2", 11), (3, 5, None, None), (4, None, None, None),
        (5, 5, None, None), (6, 5, "3", 7))
    assert sorted(held("stage"), key=str) == ordered(
        (1, 5, "1", 10), (2, 5, "1", 10), (3, 5, None, None), (4, None, None, None), (5, 5, None, None), (6, 5, None, None))


def test_moving_blocks_differ_from_the_end_of_the_log(spark):
    from tasklens.sources.tablelog import lineitem_moving_blocks_log
    lines = lineitem_moving_blocks_log(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"))
    then, last = P.placement_as_of(lines), P.placement(lines, live_only=True)
    assert not then.exceptAll(last.select(*then.columns)).isEmpty()
    assert then.select("task_id").distinct().count() == last.select("task_id").distinct().count()
    assert then.where(F.col("storage_executor").isNull()).count() > 0


def test_placement_as_of_parses_the_lines_once(spark):
    """The tasks that are looked up and those that are not come from one written table;
    places that are bigints are compared as they are (F5)."""
    from tasklens.sources.tablelog import lineitem_moving_blocks_log
    lines = lineitem_moving_blocks_log(spark.read.parquet(f"{SF_SMALL}/lineitem.parquet"))
    plan = P.placement_as_of(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "decimal" not in plan
    wide = P.placement_as_of(lines.withColumn("seq", F.col("seq").cast("decimal(38,0)")))
    assert "decimal" in wide._jdf.queryExecution().optimizedPlan().toString()
    then = P.placement_as_of(lines)
    assert then.exceptAll(wide).isEmpty() and wide.exceptAll(then).isEmpty()


def test_block_updates_parse_the_columns_asked_for(spark):
    """a narrow schema, and names that are no RDD's block are no updates."""
    lines = [update("rdd_5_0", "1", 10, 1), update("broadcast_1", "1", 10, 2), update("rdd_5_0_1", "1", 10, 3)]
    df = spark.createDataFrame(lines, "log string, value string, seq long")
    all_of = ev.block_update_events(df)
    assert all_of.columns == ["log", "seq", *ev.BLOCK_FIELDS]
    some = ev.block_update_events(df, ["block_id", "memsize"])
    assert some.columns == ["log", "seq", "block_id", "memsize"]
    assert some.exceptAll(all_of.select(*some.columns)).isEmpty()
    assert "Executor ID" not in some._jdf.queryExecution().analyzed().toString()
