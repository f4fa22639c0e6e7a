"""Event-log lines derived from the ``orders`` and ``lineitem`` tables.

The metric operators read Spark event logs. To run them over tables that
grow with the data (and to check them against plain SQL), this module
writes the listener events an application would have logged, as JSON lines
made with ``to_json``:

* one application per ``o_orderpriority`` (the log key),
* one job and one stage per order (id = ``o_orderkey``), submitted at the
  order date; orders with status ``'P'`` never log a JobEnd (a running job),
* the stage of every order key ending in 3 is retried: a second attempt is
  submitted 500 ms later, and its tasks with a line number divisible by three
  belong to the first attempt and fail,
* the job of every order key ending in 5 lists a second stage (id + 2^40) that
  is skipped, i.e. never submitted,
* the stage of every order key ending in 7 is shared by a second job
  (id + 2^41) that ends 60 s after the order date,
* one task per ``lineitem`` row of the order (index = ``l_linenumber``), with
  launch / finish times and metrics as integer functions of the row.

Task ids are a hash of the row's order key, line number, part, supplier and price
(``row_id``): no sort is needed to number the tasks.

Fixed values (the SQL oracle repeats them):
  job end       = submission + 20000 + floor(o_totalprice) % 1000
  stage end     = submission + 19000
  launch        = submission + l_linenumber * 1000 + l_suppkey % 100
  finish        = launch + floor(l_quantity * 100) + l_partkey % 50
  executor id   = l_suppkey % 8 (string); host = 'host-' || l_suppkey % 4
  locality      = 'N' -> PROCESS_LOCAL, 'R' -> NODE_LOCAL, else ANY (by l_returnflag)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .eventlog import epoch_ms

#: Columns that tell the rows of lineitem apart, with the price in cents.
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Spark's partition ids are ints; order keys are folded into their range.
MAX_PART = (1 << 31) - 1

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                  "l_linestatus", "l_shipdate"]


def _fl(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def row_id() -> Column:
    """52-bit id of a lineitem row: the first 13 hex digits of the md5 of its key."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ROW_KEY], cents.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def task_metric_columns() -> dict[str, Column]:
    """Task metrics as functions of one lineitem row (fixed mapping)."""
    c = F.col
    return {
        "Executor Deserialize Time": c("l_linenumber") * 10 + c("l_suppkey") % 7,
        "Executor Deserialize CPU Time": (c("l_suppkey") % 7) * 1000000 + c("l_partkey"),
        "Executor Run Time": _fl(c("l_quantity") * 100),
        "Executor CPU Time": _fl(c("l_extendedprice") * 1000),
        "Peak Execution Memory": c("l_partkey") * 1024,
        "Result Size": c("l_partkey") + 1000,
        "JVM GC Time": c("l_partkey") % 13,
        "Result Serialization Time": c("l_suppkey") % 3,
        "Memory Bytes Spilled": F.when(c("l_linestatus") == "F", c("l_partkey") * 16).otherwise(F.lit(0).cast("bigint")),
        "Disk Bytes Spilled": F.when(c("l_linestatus") == "F", c("l_partkey") * 4).otherwise(F.lit(0).cast("bigint")),
    }


#: Ids of skipped stages and of second jobs lie above the order keys.
SKIPPED, SHARING = 1 << 40, 1 << 41
RETRY_MS, SHARED_START_MS, SHARED_END_MS = 500, 25_000, 60_000


def _ends_in(key: str, digit: int) -> Column:
    return F.col(key) % 10 == digit


def _job_events() -> list[tuple[str, Column, Column | None]]:
    """(event, its struct, the orders that log it or None for all)."""
    sub, key = F.col("sub_ms"), F.col("o_orderkey")
    start = F.struct(F.lit("SparkListenerJobStart").alias("Event"),
                     key.alias("Job ID"),
                     sub.alias("Submission Time"),
                     F.when(_ends_in("o_orderkey", 5), F.array(key, key + SKIPPED))
                     .otherwise(F.array(key)).alias("Stage IDs"))
    start2 = F.struct(F.lit("SparkListenerJobStart").alias("Event"),
                      (key + SHARING).alias("Job ID"),
                      (sub + SHARED_START_MS).alias("Submission Time"),
                      F.array(key).alias("Stage IDs"))
    end2 = F.struct(F.lit("SparkListenerJobEnd").alias("Event"),
                    (key + SHARING).alias("Job ID"),
                    (sub + SHARED_END_MS).alias("Completion Time"),
                    F.struct(F.lit("JobSucceeded").alias("Result")).alias("Job Result"))
    end = F.struct(F.lit("SparkListenerJobEnd").alias("Event"),
                   F.col("o_orderkey").alias("Job ID"),
                   (sub + 20000 + _fl(F.col("o_totalprice")) % 1000).alias("Completion Time"),
                   F.struct(F.lit("JobSucceeded").alias("Result")).alias("Job Result"))
    retried = _ends_in("o_orderkey", 3)

    def stage(attempt, submission):
        return [key.alias("Stage ID"), attempt.alias("Stage Attempt ID"),
                F.lit("fixture").alias("Stage Name"), F.lit(1).alias("Number of Tasks"),
                F.array().cast("array<struct<`RDD ID`:int>>").alias("RDD Info"),
                submission.alias("Submission Time")]

    submitted = F.struct(F.lit("SparkListenerStageSubmitted").alias("Event"),
                         F.struct(*stage(F.lit(0), sub)).alias("Stage Info"))
    again = F.struct(F.lit("SparkListenerStageSubmitted").alias("Event"),
                     F.struct(*stage(F.lit(1), sub + RETRY_MS)).alias("Stage Info"))
    completed = F.struct(F.lit("SparkListenerStageCompleted").alias("Event"),
                         F.struct(*stage(retried.cast("int"), F.when(retried, sub + RETRY_MS).otherwise(sub)),
                                  (sub + 19000).alias("Completion Time")).alias("Stage Info"))
    shared = _ends_in("o_orderkey", 7)
    return [
        ("SparkListenerJobStart", start, None),
        ("SparkListenerStageSubmitted", submitted, None),
        ("SparkListenerStageCompleted", completed, None),
        ("SparkListenerJobEnd", end, F.col("o_orderstatus") != "P"),
        ("SparkListenerJobStart", start2, shared),
        ("SparkListenerJobEnd", end2, shared),
        ("SparkListenerStageSubmitted", again, retried),
    ]


def _job_lines(o: DataFrame) -> list[DataFrame]:
    return [(o if which is None else o.where(which)).select(
        "log", F.to_json(value).alias("value"), F.lit(event).alias("event"))
        for event, value, which in _job_events()]


def _task_event() -> Column:
    c = F.col
    launch = c("sub_ms") + c("l_linenumber") * 1000 + c("l_suppkey") % 100
    finish = launch + _fl(c("l_quantity") * 100) + c("l_partkey") % 50
    retried = _ends_in("l_orderkey", 3)
    stale = retried & (c("l_linenumber") % 3 == 0)
    attempt = F.when(retried & ~stale, 1).otherwise(0)
    locality = (F.when(c("l_returnflag") == "N", "PROCESS_LOCAL")
                .when(c("l_returnflag") == "R", "NODE_LOCAL").otherwise("ANY"))
    info = F.struct(
        c("task_id").alias("Task ID"), c("l_linenumber").alias("Index"),
        F.lit(0).alias("Attempt"), c("l_linenumber").alias("Partition ID"),
        launch.alias("Launch Time"),
        (c("l_suppkey") % 8).cast("string").alias("Executor ID"),
        F.concat(F.lit("host-"), (c("l_suppkey") % 4).cast("string")).alias("Host"),
        locality.alias("Locality"), F.lit(False).alias("Speculative"),
        finish.alias("Finish Time"), stale.alias("Failed"),
        F.lit(False).alias("Killed"))
    shuffle_read = F.struct(
        c("l_linenumber").cast("bigint").alias("Remote Blocks Fetched"),
        (c("l_suppkey") % 5).alias("Local Blocks Fetched"),
        _fl(c("l_discount") * 1000).alias("Fetch Wait Time"),
        (c("l_partkey") * 10).alias("Remote Bytes Read"),
        F.lit(0).cast("bigint").alias("Remote Bytes Read To Disk"),
        (c("l_suppkey") * 10).alias("Local Bytes Read"),
        _fl(c("l_quantity")).alias("Total Records Read"))
    shuffle_write = F.struct(
        (c("l_partkey") + c("l_suppkey")).alias("Shuffle Bytes Written"),
        _fl(c("l_tax") * 1000000).alias("Shuffle Write Time"),
        c("l_linenumber").cast("bigint").alias("Shuffle Records Written"))
    metrics = F.struct(
        *[v.alias(k) for k, v in task_metric_columns().items()],
        shuffle_read.alias("Shuffle Read Metrics"),
        shuffle_write.alias("Shuffle Write Metrics"),
        F.struct(_fl(c("l_extendedprice")).alias("Bytes Read"),
                 _fl(c("l_quantity")).alias("Records Read")).alias("Input Metrics"),
        F.struct(c("l_suppkey").alias("Bytes Written"),
                 F.lit(1).cast("bigint").alias("Records Written")).alias("Output Metrics"))
    return F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"), c("l_orderkey").alias("Stage ID"),
        attempt.alias("Stage Attempt ID"), F.lit("ResultTask").alias("Task Type"),
        F.struct(F.when(stale, "FetchFailed").otherwise("Success").alias("Reason")).alias("Task End Reason"),
        info.alias("Task Info"), metrics.alias("Task Metrics"))


def _task_lines(t: DataFrame) -> DataFrame:
    return t.select("log", F.to_json(_task_event()).alias("value"),
                    F.lit("SparkListenerTaskEnd").alias("event"))


def _log_rows(orders: DataFrame, lineitem: DataFrame, keep: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per job, a row per task with its job's log and submission); ``keep`` is
    given the task rows as they are joined, and they are made of what it returns."""
    o = orders.select(F.col("o_orderpriority").alias("log"), "o_orderkey",
                      "o_orderstatus", "o_totalprice",
                      epoch_ms(F.col("o_orderdate")).alias("sub_ms"))
    li = lineitem.select(*[c for c in LINEITEM_ORDER if c != "l_shipdate"])
    rows = li.join(o.select("o_orderkey", "log", "sub_ms"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    # the id behind the join: it is as long as what it is made of, and no shuffle shortens it
    return o, (keep(rows) if keep else rows).withColumn("task_id", row_id())


def orders_lineitem_log(orders: DataFrame, lineitem: DataFrame, keep: Callable | None = None) -> DataFrame:
    """Event-log lines ``(log, value, event)`` for every order and lineitem row.

    ``event`` is a literal per union branch, so a table that needs one event
    type makes Catalyst drop the other branches (no recomputation)."""
    o, t = _log_rows(orders, lineitem, keep)
    parts = _job_lines(o) + [_task_lines(t)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orders_lineitem_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The same lines as ``(log, value, job)``, for writing them to files: one branch
    for the lines of the jobs and one for those of the tasks, as every partition of a
    branch becomes a file of each log. ``job`` is the order's key; a filter on it
    reaches the scans of both tables."""
    o, t = _log_rows(orders, lineitem)
    of_job = F.array_compact(F.array(*[
        F.to_json(value) if which is None else F.when(which, F.to_json(value))
        for _, value, which in _job_events()]))
    jobs = o.select("log", F.explode(of_job).alias("value"), F.col("o_orderkey").alias("job"))
    return jobs.unionByName(t.select("log", F.to_json(_task_event()).alias("value"),
                                     F.col("l_orderkey").alias("job")))


# ------------------------------------------------------------------ placement

#: Columns of lineitem that a row's block and task are made of.
_PLACED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_discount", "l_tax", "l_quantity"]


def lineitem_placement_log(lineitem: DataFrame) -> DataFrame:
    """Block-placement lines ``(log, value, event, seq)`` from ``lineitem``.

    Per app (``l_returnflag``) and cached RDD (id = ``l_linenumber``): one
    stage (id = ``l_linenumber``) whose RDD Info lists the cached RDD and an
    uncached one (id + 100). Per lineitem row, in the order of ``row_id`` (``seq``):
    a BlockUpdated line for block ``rdd_<l_linenumber>_<l_orderkey>`` on
    executor ``l_suppkey % 8``, and a TaskEnd of that partition run on
    executor ``l_partkey % 8``. RDD 7 of every app is unpersisted.

    Fixed values: disk = (l_linestatus = 'F'), memory = (l_discount < 0.05),
    deserialized = memory and l_tax < 0.04, replication = 2 if
    l_quantity >= 45 else 1, memory size = l_partkey * 10 when in memory,
    disk size = l_partkey * 3 when on disk.
    """
    li = lineitem.select(*LINEITEM_ORDER).withColumn("seq", row_id())
    block, task = _placed_row()
    app = F.col("l_returnflag").alias("log")
    blocks = li.select(app, F.to_json(block).alias("value"),
                       F.lit("SparkListenerBlockUpdated").alias("event"), "seq")
    tasks = li.select(app, F.to_json(task).alias("value"), F.lit("SparkListenerTaskEnd").alias("event"), "seq")
    return blocks.unionByName(tasks).unionByName(_placed_once(lineitem))


def placement_lines_in_place(rows: DataFrame, place: list[str]) -> DataFrame:
    """The same lines as ``(log, place..., value)`` from ``rows`` that are dealt to
    files and sorted already: lineitem rows with ``seq``, and those that are
    no row's as ``once`` (the line itself). The text is made where it is written."""
    block, task = _placed_row()
    both = F.array(F.to_json(block), F.to_json(task))
    return rows.select("log", *place, F.explode(F.when(F.col("once").isNull(), both)
                                                .otherwise(F.array("once"))).alias("value"))


def placement_rows(lineitem: DataFrame) -> DataFrame:
    """What ``placement_lines_in_place`` takes: ``(log, seq, once, row columns...)``."""
    li = lineitem.select(*LINEITEM_ORDER).withColumn("seq", row_id())
    rows = li.select(F.col("l_returnflag").alias("log"), "seq", F.lit(None).cast("string").alias("once"), *_PLACED)
    return rows.unionByName(_placed_once(lineitem).select("log", "seq", F.col("value").alias("once")),
                            allowMissingColumns=True)


def _placed_row() -> tuple[Column, Column]:
    """The BlockUpdated and the TaskEnd of a lineitem row."""
    c = F.col
    part = F.pmod(c("l_orderkey"), F.lit(MAX_PART))
    use_mem = c("l_discount") < 0.05
    use_disk = c("l_linestatus") == "F"
    level = F.struct(use_disk.alias("Use Disk"), use_mem.alias("Use Memory"),
                     F.lit(False).alias("Use Off Heap"),
                     (use_mem & (c("l_tax") < 0.04)).alias("Deserialized"),
                     F.when(c("l_quantity") >= 45, 2).otherwise(1).alias("Replication"))
    block = F.struct(
        F.lit("SparkListenerBlockUpdated").alias("Event"),
        F.struct(
            F.struct((c("l_suppkey") % 8).cast("string").alias("Executor ID"),
                     F.concat(F.lit("host-"), (c("l_suppkey") % 4).cast("string")).alias("Host"),
                     F.lit(7077).alias("Port")).alias("Block Manager ID"),
            F.concat(F.lit("rdd_"), c("l_linenumber").cast("string"), F.lit("_"),
                     part.cast("string")).alias("Block ID"),
            level.alias("Storage Level"),
            F.when(use_mem, c("l_partkey") * 10).otherwise(F.lit(0).cast("bigint")).alias("Memory Size"),
            F.when(use_disk, c("l_partkey") * 3).otherwise(F.lit(0).cast("bigint")).alias("Disk Size"),
        ).alias("Block Updated Info"))
    task = F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"), c("l_linenumber").cast("bigint").alias("Stage ID"),
        F.lit(0).alias("Stage Attempt ID"),
        F.struct(c("seq").alias("Task ID"), F.lit(0).alias("Index"), F.lit(0).alias("Attempt"),
                 part.cast("int").alias("Partition ID"),
                 (c("l_partkey") % 8).cast("string").alias("Executor ID"),
                 F.concat(F.lit("host-"), (c("l_partkey") % 4).cast("string")).alias("Host"),
                 F.lit("PROCESS_LOCAL").alias("Locality")).alias("Task Info"))
    return block, task


def _placed_once(lineitem: DataFrame) -> DataFrame:
    """The lines of stages and unpersisted RDDs, without a ``seq``."""
    c = F.col
    stages_src = lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n_tasks"))
    cached = F.struct(c("l_linenumber").cast("int").alias("RDD ID"), F.lit("cached").alias("Name"),
                      F.struct(F.lit(True).alias("Use Disk"), F.lit(True).alias("Use Memory"),
                               F.lit(False).alias("Use Off Heap"), F.lit(False).alias("Deserialized"),
                               F.lit(1).alias("Replication")).alias("Storage Level"))
    plain = F.struct((c("l_linenumber") + 100).cast("int").alias("RDD ID"), F.lit("plain").alias("Name"),
                     F.struct(F.lit(False).alias("Use Disk"), F.lit(False).alias("Use Memory"),
                              F.lit(False).alias("Use Off Heap"), F.lit(False).alias("Deserialized"),
                              F.lit(1).alias("Replication")).alias("Storage Level"))
    stage = F.struct(F.lit("SparkListenerStageSubmitted").alias("Event"),
                     F.struct(c("l_linenumber").cast("bigint").alias("Stage ID"),
                              F.lit(0).alias("Stage Attempt ID"),
                              c("n_tasks").cast("int").alias("Number of Tasks"),
                              F.array(cached, plain).alias("RDD Info"),
                              F.lit(0).cast("bigint").alias("Submission Time")).alias("Stage Info"))
    stages = stages_src.select(c("l_returnflag").alias("log"), F.to_json(stage).alias("value"),
                               F.lit("SparkListenerStageSubmitted").alias("event"),
                               F.lit(None).cast("bigint").alias("seq"))
    unpersist = (lineitem.select(c("l_returnflag").alias("log")).distinct()
                 .select("log", F.to_json(F.struct(F.lit("SparkListenerUnpersistRDD").alias("Event"),
                                                   F.lit(7).alias("RDD ID"))).alias("value"),
                         F.lit("SparkListenerUnpersistRDD").alias("event"),
                         F.lit(None).cast("bigint").alias("seq")))
    return stages.unionByName(unpersist)


#: Partitions of a cached RDD in the log of moving blocks, and places of a row.
MOVING_PARTS, PLACES = 1024, 8


def lineitem_moving_blocks_log(lineitem: DataFrame) -> DataFrame:
    """Lines ``(log, value, event, seq)`` of blocks that are stored, dropped and
    moved while tasks run, from ``lineitem``.

    Applications, stages and cached RDDs are those of ``lineitem_placement_log``;
    the partition is ``l_orderkey`` modulo ``MOVING_PARTS``, so that a block has a
    history. A row has ``PLACES`` places in the log, from ``PLACES`` * ``row_id``
    on; by ``l_partkey`` % 3:
      0  stored on executor ``l_suppkey % 8`` (levels and sizes as there);
      1  remainder 1: dropped there again;
      2  the task starts on executor ``l_partkey % 8``;
      3  remainder 0: dropped, and at
      4  stored on executor ``(l_suppkey + 1) % 8`` (in memory, ``l_partkey`` bytes);
      5  the task ends.
    Stages are submitted at place -1. RDD 7 is unpersisted half-way, at place
    ``PLACES`` * 2^51 + 7.
    """
    c = F.col
    li = lineitem.select(*LINEITEM_ORDER).withColumn("row", row_id())
    part = F.pmod(c("l_orderkey"), F.lit(MOVING_PARTS)).cast("int")
    kind = F.pmod(c("l_partkey"), F.lit(3))
    use_mem, use_disk = c("l_discount") < 0.05, c("l_linestatus") == "F"

    def update(executor: Column, mem: Column, disk: Column, memsize: Column, disksize: Column) -> Column:
        level = F.struct(disk.alias("Use Disk"), mem.alias("Use Memory"), F.lit(False).alias("Use Off Heap"),
                         F.lit(False).alias("Deserialized"), F.lit(1).alias("Replication"))
        manager = F.struct((executor % 8).cast("string").alias("Executor ID"), F.lit("host").alias("Host"),
                           F.lit(7077).alias("Port"))
        name = F.concat(F.lit("rdd_"), c("l_linenumber").cast("string"), F.lit("_"), part.cast("string"))
        info = F.struct(manager.alias("Block Manager ID"), name.alias("Block ID"), level.alias("Storage Level"),
                        memsize.alias("Memory Size"), disksize.alias("Disk Size"))
        return F.struct(F.lit("SparkListenerBlockUpdated").alias("Event"), info.alias("Block Updated Info"))

    def at(rows: DataFrame, place: int, event: str, value: Column) -> DataFrame:
        return rows.select(c("l_returnflag").alias("log"), F.to_json(value).alias("value"),
                           F.lit(event).alias("event"), (c("row") * PLACES + place).alias("seq"))

    none, zero, yes = F.lit(False), F.lit(0).cast("bigint"), F.lit(True)
    stored = update(c("l_suppkey"), use_mem, use_disk, F.when(use_mem, c("l_partkey") * 10).otherwise(zero),
                    F.when(use_disk, c("l_partkey") * 3).otherwise(zero))
    dropped = update(c("l_suppkey"), none, none, zero, zero)
    moved = update(c("l_suppkey") + 1, yes, none, c("l_partkey"), zero)
    stage = [c("l_linenumber").cast("bigint").alias("Stage ID"), F.lit(0).alias("Stage Attempt ID")]
    start = F.struct(F.lit("SparkListenerTaskStart").alias("Event"), *stage,
                     F.struct(c("row").alias("Task ID")).alias("Task Info"))
    end = F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), *stage,
                   F.struct(c("row").alias("Task ID"), part.alias("Partition ID"),
                            (c("l_partkey") % 8).cast("string").alias("Executor ID")).alias("Task Info"))
    block = "SparkListenerBlockUpdated"
    rows = [at(li, 0, block, stored), at(li.where(kind == 1), 1, block, dropped),
            at(li, 2, "SparkListenerTaskStart", start), at(li.where(kind == 0), 3, block, dropped),
            at(li.where(kind == 0), 4, block, moved), at(li, 5, "SparkListenerTaskEnd", end)]
    fixed = lineitem_placement_log(lineitem).where(F.col("event").isin(
        "SparkListenerStageSubmitted", "SparkListenerUnpersistRDD"))
    place = F.when(c("event") == "SparkListenerUnpersistRDD", F.lit(PLACES * (1 << 51) + 7)).otherwise(F.lit(-1))
    out = fixed.withColumn("seq", place.cast("bigint"))
    for r in rows:
        out = out.unionByName(r)
    return out
