"""Event-log parsing: a real log of our own small job, and hand-written
lines for the edge cases (two apps, a skipped stage, a resubmitted stage,
a job without JobEnd, a failed task without metrics, a task that is not
PROCESS_LOCAL, a single task at an index, an unrelated SQL event, a cut-off
last line)."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tasklens.operators import metrics as M
from tasklens.operators import placement as P
from tasklens.sources import eventlog as ev

APP = os.path.join(os.path.dirname(os.path.abspath(__file__)), "apps", "live_app.py")


@pytest.fixture(scope="module")
def live_lines(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("evlog")
    subprocess.run([sys.executable, APP, str(out)], check=True, timeout=600,
                   stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    return ev.read_event_log(spark, f"{out}/eventlog_v2_*", rolled=True)


def test_live_log_tables(live_lines):
    jobs = M.jobs(live_lines).collect()
    assert len(jobs) == 6 and all(j.end_ms >= j.submission_ms for j in jobs)
    st = M.stages(live_lines).collect()
    skipped = [s for s in st if s.attempt is None]
    assert len(skipped) >= 2                      # map stages reused by later jobs
    tasks = ev.task_end_events(live_lines).count()
    flat = M.flat_tasks(live_lines).collect()
    assert len(flat) == tasks
    assert all(t.sojournTime >= 0 and t.waitingTime >= 0 and t.serviceTime >= 0 for t in flat)
    full = M.flat_tasks_full(live_lines, stage_index=None)
    assert full.count() == tasks and len(full.columns) == 36
    stats = M.task_index_stats(live_lines).collect()
    assert sum(r["count"] for r in stats) == tasks


def test_live_log_placement(live_lines):
    all_blocks = P.block_locations(live_lines, live_only=False).collect()
    assert len(all_blocks) == 4 and {b.part_id for b in all_blocks} == {0, 1, 2, 3}
    assert all(b.storage_flags in (4, 12) for b in all_blocks)
    assert P.block_locations(live_lines, live_only=True).count() == 0   # unpersisted at the end
    placed = P.placement(live_lines).where(F.col("rdd_id").isNotNull()).collect()
    assert placed and all(p.storage_executor is not None for p in placed)


def _task(app_stage, tid, idx, launch, finish, locality="PROCESS_LOCAL", failed=False, attempt=0,
          metrics=True):
    stage, sattempt = app_stage
    e = {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": sattempt,
         "Task Type": "ResultTask", "Task End Reason": {"Reason": "ExceptionFailure" if failed else "Success"},
         "Task Info": {"Task ID": tid, "Index": idx, "Attempt": attempt, "Partition ID": idx,
                       "Launch Time": launch, "Executor ID": "1", "Host": "h1", "Locality": locality,
                       "Speculative": False, "Finish Time": finish, "Failed": failed, "Killed": False}}
    if metrics:
        e["Task Metrics"] = {"Executor Deserialize Time": 2, "Executor Run Time": finish - launch - 2,
                             "Executor CPU Time": 1000, "JVM GC Time": 1,
                             "Shuffle Read Metrics": {"Remote Blocks Fetched": 1, "Local Blocks Fetched": 2,
                                                      "Remote Bytes Read": 10, "Local Bytes Read": 5}}
    return json.dumps(e)


@pytest.fixture(scope="module")
def hand_lines(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("hand")
    a = [
        json.dumps({"Event": "SparkListenerLogStart", "Spark Version": "4.1.2"}),
        json.dumps({"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 1000, "Stage IDs": [0, 1]}),
        # stage 0 is skipped (listed, never submitted)
        json.dumps({"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 0, "Submission Time": 1010}}),
        _task((1, 0), 10, 0, 1020, 1050),
        json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 0, "Submission Time": 1010, "Completion Time": 1060, "Failure Reason": "fetch failed"}}),
        # stage 1 resubmitted: attempt 1 is the one kept
        json.dumps({"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 1, "Submission Time": 1100}}),
        _task((1, 1), 11, 0, 1110, 1130),
        _task((1, 1), 12, 1, 1115, 1190, locality="NODE_LOCAL"),
        _task((1, 1), 13, 2, 1120, 1125, failed=True, metrics=False),
        json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 1, "Submission Time": 1100, "Completion Time": 1200}}),
        json.dumps({"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": 1210}),
        json.dumps({"Event": "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", "executionId": 0}),
        # job 1 never ends
        json.dumps({"Event": "SparkListenerJobStart", "Job ID": 1, "Submission Time": 2000, "Stage IDs": [2]}),
        json.dumps({"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 2, "Stage Attempt ID": 0, "Submission Time": 2005}}),
        _task((2, 0), 20, 0, 2010, 2020),
        '{"Event":"SparkListenerTaskEnd","Stage ID":2,"Stage Attem',   # cut off
    ]
    b = [
        json.dumps({"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 50, "Stage IDs": [0]}),
        json.dumps({"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 0, "Stage Attempt ID": 0, "Submission Time": 60}}),
        _task((0, 0), 0, 0, 70, 90),
        _task((0, 0), 1, 0, 71, 99, attempt=1),
        json.dumps({"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": 100}),
    ]
    (d / "app-a").write_text("\n".join(a))
    (d / "app-b").write_text("\n".join(b) + "\n")
    return ev.read_event_log(spark, [str(d / "app-a"), str(d / "app-b")])


def test_hand_stages_and_jobs(hand_lines):
    st = {(r.app.rsplit("/", 1)[1], r.stage_id): r for r in M.stages(hand_lines).collect()}
    assert st[("app-a", 0)].attempt is None                 # skipped stage
    assert (st[("app-a", 1)].attempt, st[("app-a", 1)].submission_ms, st[("app-a", 1)].completion_ms) == (1, 1100, 1200)
    jobs = {(r.app.rsplit("/", 1)[1], r.job_id): r.end_ms for r in M.jobs(hand_lines).collect()}
    assert jobs == {("app-a", 0): 1210, ("app-a", 1): None, ("app-b", 0): 100}


def test_hand_tasks(hand_lines):
    flat = {r.taskId: r for r in M.flat_tasks(hand_lines).collect() if r.app.endswith("app-a")}
    assert set(flat) == {11, 12, 13}                         # last attempt; running job dropped
    assert (flat[11].sojournTime, flat[11].waitingTime, flat[11].serviceTime) == (110.0, 10.0, 20.0)
    assert flat[12].local is False and flat[13].deserializationTime is None
    keep = M.flat_tasks(hand_lines, keep_incomplete=True, attempts="all")
    assert keep.where(F.col("app").endswith("app-a")).count() == 5
    ok = M.flat_tasks(hand_lines, successful_only=True).where(F.col("app").endswith("app-a")).count()
    assert ok == 2


def test_hand_stage_index(hand_lines):
    # app-a knows stages [0, 1, 2]: index 1 is the skipped stage 0 (no tasks)
    first = M.flat_tasks_full(hand_lines, stage_index=1).collect()
    assert {r.app.rsplit("/", 1)[1] for r in first} == {"app-b"}
    second = M.flat_tasks_full(hand_lines, stage_index=2).collect()
    assert sorted(r.taskId for r in second) == [11, 12, 13]
    assert second[0].shuffleTotalBlocksFetched in (3, None)
    assert M.flat_tasks_full(hand_lines, stage_index=9).count() == 0
    with pytest.raises(ValueError):
        M.flat_tasks_full(hand_lines, stage_index=0)


def test_hand_index_stats(hand_lines):
    s = {r.taskIndex: r for r in M.task_index_stats(hand_lines).collect()}
    assert s[1]["count"] == 1 and s[1].var_serviceTime is None   # one task: NULL std-dev
    assert s[0]["count"] == 3
    assert s[2]["count"] == 1 and s[2].avg_jvmGcTime is None     # failed task, no metrics


def test_materialized_log_reads_the_same(spark, hand_lines, tmp_path):
    path = str(tmp_path / "events")
    ev.materialize_event_log(hand_lines, path)
    back = spark.read.parquet(path)
    a = sorted(M.flat_tasks(hand_lines).collect())
    b = sorted(M.flat_tasks(back).collect())
    assert a == b


def test_hand_all_attempts_use_their_own_submission(hand_lines):
    allt = {r.taskId: r for r in M.flat_tasks(hand_lines, attempts="all").collect()
            if r.app.endswith("app-a")}
    assert set(allt) == {10, 11, 12, 13}
    assert allt[10].waitingTime == 10.0 and allt[11].waitingTime == 10.0   # 1020-1010, 1110-1100


def test_live_log_app_ids(live_lines):
    ids = ev.app_ids(live_lines).collect()
    assert len(ids) == 1 and ids[0].app_id.startswith("local-") and ids[0].app_name == "live-probe"
    joined = M.jobs(live_lines).join(ev.app_ids(live_lines).withColumnRenamed("log", "app"), "app")
    assert joined.select("app_id").distinct().count() == 1


@pytest.mark.parametrize("rolling", [False, True])
def test_current_app_log(tmp_path, rolling):
    """A session reads its own (in-progress) log: the persisted table's six
    partitions are on disk, and the workload's tasks are placed on them."""
    app = os.path.join(os.path.dirname(os.path.abspath(__file__)), "apps", "own_log_app.py")
    res = subprocess.run([sys.executable, app, str(tmp_path), "1" if rolling else "0"],
                         check=True, capture_output=True, text=True, timeout=600)
    out = json.loads([ln for ln in res.stdout.splitlines() if ln.startswith("RESULT ")][-1][7:])
    assert out["jobs"] >= 2 and out["tasks"] >= 12
    assert out["blocks"] == 6 and out["placed"] >= 6


def test_read_folder_with_running_app(spark, tmp_path):
    """A folder holding a finished plain log and a zstd log still being
    written: with include_in_progress both apps' jobs are read."""
    import zstandard
    finished = tmp_path / "app-done"
    finished.write_text("\n".join([
        json.dumps({"Event": "SparkListenerJobStart", "Job ID": 0, "Submission Time": 1, "Stage IDs": [0]}),
        json.dumps({"Event": "SparkListenerJobEnd", "Job ID": 0, "Completion Time": 5})]) + "\n")
    running = "\n".join([
        json.dumps({"Event": "SparkListenerJobStart", "Job ID": 7, "Submission Time": 10, "Stage IDs": [3]}),
        json.dumps({"Event": "SparkListenerJobStart", "Job ID": 8, "Submission Time": 11, "Stage IDs": [4]}),
        '{"Event":"SparkListenerJobEnd","Job I']).encode()
    c = zstandard.ZstdCompressor()
    blob = c.compress(running[:40]) + c.compress(running[40:])       # two frames
    (tmp_path / "app-live.zstd.inprogress").write_bytes(blob)
    lines = ev.read_event_log(spark, str(tmp_path), include_in_progress=True)
    got = sorted((r.app.rsplit("/", 1)[1], r.job_id, r.end_ms) for r in M.jobs(lines).collect())
    assert got == [("app-done", 0, 5), ("app-live.zstd.inprogress", 7, None),
                   ("app-live.zstd.inprogress", 8, None)]
