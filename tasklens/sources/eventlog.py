"""Spark event logs as DataFrames.

A log is JSON, one listener event per line. ``read_event_log`` returns the
raw lines with a log key; the ``*_events`` functions cut one event type out
and parse it with a narrow, explicit schema (no inference). Lines are
pre-filtered on the event name with a plain substring test before any JSON
parsing, then the parsed ``Event`` field is checked exactly.

Log key: the ``App ID`` of the log's ``SparkListenerApplicationStart`` line
is not on every line, so the key is the file (``_metadata.file_path``), or its
parent folder for rolled ``eventlog_v2_*`` logs.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import freed_shuffles

L = T.LongType()
I = T.IntegerType()
S = T.StringType()
B = T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STORAGE_LEVEL = _struct(("Use Disk", B), ("Use Memory", B), ("Use Off Heap", B),
                        ("Deserialized", B), ("Replication", I))

RDD_INFO = _struct(("RDD ID", I), ("Name", S), ("Storage Level", STORAGE_LEVEL),
                   ("Number of Partitions", I))

STAGE_INFO = _struct(("Stage ID", L), ("Stage Attempt ID", I), ("Stage Name", S),
                     ("Number of Tasks", I), ("RDD Info", T.ArrayType(RDD_INFO)),
                     ("Submission Time", L), ("Completion Time", L),
                     ("Failure Reason", S))

JOB_START = _struct(("Event", S), ("Job ID", L), ("Submission Time", L),
                    ("Stage IDs", T.ArrayType(L)))

JOB_END = _struct(("Event", S), ("Job ID", L), ("Completion Time", L))

STAGE_EVENT = _struct(("Event", S), ("Stage Info", STAGE_INFO))

UNPERSIST = _struct(("Event", S), ("RDD ID", I))

TASK_START = _struct(("Event", S), ("Stage ID", L), ("Stage Attempt ID", I), ("Task Info", _struct(("Task ID", L))))

APP_START = _struct(("Event", S), ("App Name", S), ("App ID", S), ("Timestamp", L))


# ---------------------------------------------------------------- reading

def _list_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files under the given files, folders or globs (one level deep)."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(hconf)
        for st in fs.globStatus(hp) or []:
            if st.isDirectory():
                out += [c.getPath().toString() for c in fs.listStatus(st.getPath()) if c.isFile()]
            else:
                out.append(st.getPath().toString())
    return out


def read_event_log(spark: SparkSession, paths: str | list[str],
                   rolled: bool | None = None, include_in_progress: bool = False,
                   reader: str | None = None) -> DataFrame:
    """Raw lines ``(log STRING, value STRING, seq DECIMAL(38,0))`` of one or
    many event logs.

    ``paths`` may be files, folders or globs. For rolled logs (``eventlog_v2_*``
    folders) only ``events_*`` files are read and the folder is the log key.
    ``seq`` orders the lines of a log.

    ``reader="source"`` reads with the data source of ``logsource``: byte ranges,
    ``seq`` from the rolled file's number and the line's byte, zstd and gzip, also
    of files that are still written, and a further column ``event``.
    ``reader="text"`` is Spark's text reader, for stores that only Spark opens
    and for its other codecs (``.lz4``, ``.snappy``). By default the source is
    taken where it can list the paths and knows the codecs. A compressed file
    still being written (``*.zstd.inprogress``) decodes to no event lines with the
    text reader; ``include_in_progress=True`` reads those with
    ``read_zstd_event_log``.
    """
    from . import logsource
    if isinstance(paths, str):
        paths = [paths]
    if reader is None:
        reader = "source" if logsource.reads(paths, bool(rolled)) else "text"
    if reader == "source":
        logsource.register_source(spark)
        df = (spark.read.format("event_log").option("paths", json.dumps(paths))
              .option("rolled", str(bool(rolled)).lower()).load())
        return df.select("log", "value", "event", _line_seq(F.col("file_number"), F.col("offset"), F.lit(0)).alias("seq"))
    if include_in_progress:
        files = [f for f in _list_files(spark, paths)
                 if not f.rsplit("/", 1)[-1].startswith((".", "_"))
                 and (not rolled or "/events_" in f)]
        live = [f for f in files if ".zstd" in f.rsplit("/", 1)[-1] and f.endswith(".inprogress")]
        rest = [f for f in files if f not in live]
        parts = []
        if rest:
            parts.append(read_event_log(spark, rest, rolled=False, reader="text"))
        if live:
            parts.append(read_zstd_event_log(spark, live))
        if not parts:
            raise FileNotFoundError(f"no event-log files under {paths}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    text = spark.read.format("text").option("recursiveFileLookup", "false")
    if rolled:
        text = text.option("pathGlobFilter", "events_*")
    df = text.load(paths)
    return with_log_key(df.withColumn("seq", line_order()), "seq")


_SEQ = "decimal(38,0)"


def _line_seq(file_number: Column, start: Column, line: Column) -> Column:
    """One number that orders (rolled file number, offset of the split in the
    file, line in the split): 10, 15 and 12 digits."""
    def digits(c, scale):
        return c.cast("decimal(20,0)") * F.lit(10 ** scale).cast(f"decimal({scale + 1},0)")
    return (digits(file_number, 17) * F.lit(10 ** 10).cast("decimal(11,0)")
            + digits(start, 12) + line.cast("decimal(20,0)")).cast(_SEQ)


def line_order() -> Column:
    """Order of the lines of a log, on a text scan: Spark deals files out by
    size, so neither the scan's order nor a bare row id is the log's."""
    number = F.nullif(F.regexp_extract("_metadata.file_name", r"^events_(\d+)_", 1), F.lit(""))
    # ids grow within a task, and a task reads a split from start to end
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return _line_seq(F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint")),
                     F.col("_metadata.file_block_start"), line)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _zstd_lines(contents: pd.Series, paths: pd.Series) -> pd.Series:
    """zstd file bytes -> text lines, across frames; a file still being
    written (``.inprogress``: unfinished last frame) yields its complete
    prefix, in a closed file a broken frame is an error."""
    import zstandard

    out = []
    for data, path in zip(contents, paths):
        buf = bytearray()
        reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)),
                                                            read_across_frames=True)
        try:
            while True:
                chunk = reader.read(1 << 20)
                if not chunk:
                    break
                buf += chunk
        except zstandard.ZstdError:
            if not path.endswith(".inprogress"):
                raise
        out.append(bytes(buf).decode("utf-8", errors="replace").split("\n"))
    return pd.Series(out)


def read_zstd_event_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(log, value, seq)`` lines of zstd-compressed logs, including files
    still being written (which the text reader, choosing the codec by file
    name, cannot decode). One file per row: rolled files are bounded by
    ``spark.eventLog.rolling.maxFileSize``. ``seq`` orders lines by rolled
    file number, then position."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, list) else [paths])
    path = F.col("path")
    log = F.when(path.contains("/eventlog_v2_"),
                 F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(path)
    number = F.nullif(F.regexp_extract(path, r"/events_(\d+)_[^/]*$", 1), F.lit(""))
    part = F.coalesce(number.cast("bigint"), F.lit(0).cast("bigint"))
    lines = files.select(log.alias("log"), part.alias("_tl_file"),
                         F.posexplode(_zstd_lines("content", "path")).alias("_tl_pos", "value"))
    return (lines.where(F.length("value") > 0)
            .select("log", "value", _line_seq(F.col("_tl_file"), F.lit(0), F.col("_tl_pos")).alias("seq")))


def current_app_log(spark: SparkSession) -> DataFrame:
    """The lines of this application's own event log, read while it runs.

    Needs ``spark.eventLog.enabled=true`` (and, for block placement,
    ``spark.eventLog.logBlockUpdates.enabled=true``) when the session is
    built. This replaces an in-process listener: the job, stage, task and
    placement tables of the session's own jobs come from the same parsers.
    Spark flushes the log at stage and job ends.
    """
    conf = spark.sparkContext.getConf()
    if conf.get("spark.eventLog.enabled", "false").lower() != "true":
        raise ValueError("spark.eventLog.enabled is not set for this session")
    base = conf.get("spark.eventLog.dir", "/tmp/spark-events").rstrip("/")
    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(hconf)
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    rolled = [n for n in names if n == f"eventlog_v2_{app}"]
    if rolled:
        folder = f"{base}/{rolled[0]}"
        inner = [st.getPath().getName() for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder))]
        events = [n for n in inner if n.startswith("events_")]
        if any(".zstd" in n for n in events):
            return read_zstd_event_log(spark, [f"{folder}/{n}" for n in events])
        return read_event_log(spark, folder, rolled=True)
    plain = [n for n in names if n == app or n.startswith(app + ".")]
    if not plain:
        raise FileNotFoundError(f"no event log of {app} under {base}")
    if any(".zstd" in n for n in plain):
        return read_zstd_event_log(spark, [f"{base}/{n}" for n in plain])
    if any(n.split(".")[-1] in ("lz4", "snappy", "lzf") or ".lz4." in n or ".snappy." in n for n in plain):
        raise ValueError("an in-progress log compressed with lz4/snappy cannot be read; "
                         "use zstd (the default), rolling logs, or spark.eventLog.compress=false")
    return read_event_log(spark, [f"{base}/{n}" for n in plain])


def with_log_key(df: DataFrame, *more: str) -> DataFrame:
    """``(log, value, more...)``: a ``log=<key>`` folder partition when the logs
    are laid out that way, else the file (the folder for rolled logs)."""
    if "log" in df.columns:
        return df.select(F.col("log").cast("string").alias("log"), "value", *more)
    path = F.col("_metadata.file_path")
    key = F.when(path.contains("/eventlog_v2_"),
                 F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(path)
    return df.select(key.alias("log"), "value", *more)


EVENT_NAME = r'^\s*\{\s*"Event"\s*:\s*"([^"]+)"'


def with_event(lines: DataFrame) -> DataFrame:
    """Add the ``event`` name of every line (a regex on the line head)."""
    if "event" in lines.columns:
        return lines
    return lines.withColumn("event", F.regexp_extract("value", EVENT_NAME, 1))


def materialize_event_log(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the lines once as Parquet partitioned by ``event``.

    The raw text is scanned once; later tables read only their own event
    partition (partition pruning) instead of re-scanning every line.
    Read back with ``spark.read.parquet(path)``: the result has the columns
    of ``lines`` and ``event`` and is accepted by every operator here.
    """
    with open_writers(lines.sparkSession, OPEN_EVENTS), freed_shuffles(lines.sparkSession):
        with_event(lines).write.mode(mode).partitionBy("event").option("compression", "zstd").parquet(path)


#: Kinds of events that a writing task keeps open at once; Spark knows fewer.
OPEN_EVENTS = 64


@contextmanager
def open_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it a task that writes to partition folders keeps up to ``n`` of them open
    and takes its rows as they come; by default Spark sorts whole lines by folder
    first, which spills."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def split_events(lines: DataFrame, path: str | None = None) -> DataFrame:
    """The lines, written once as Parquet partitioned by ``event`` and read back.

    Tables that join several events (M5, A5, P1, P2) scan the log once for each
    of them; over the split lines the log is scanned once in all, and every
    table reads only its events. ``path`` defaults to a fresh folder below the
    session's checkpoint folder."""
    if path is None:
        from ..streaming.eventlog_stream import scratch_path
        path = scratch_path(lines.sparkSession, "events")
    named = with_event(lines)
    materialize_event_log(named, path, mode="errorifexists")
    return lines.sparkSession.read.schema(named.schema).parquet(path)


def lines_of(df: DataFrame, *events: str) -> DataFrame:
    """Lines of one event type (or of any of some), before any JSON parsing.

    With an ``event`` column (materialized logs, or derived lines whose
    event is a literal per union branch) the filter is exact and prunes
    partitions / union branches; otherwise a substring test for the event
    name (any JSON spacing), confirmed on the parsed ``Event`` field.
    """
    if "event" in df.columns:
        return df.where(F.col("event").isin(*events))
    return df.where(reduce(or_, [F.col("value").contains(event) for event in events]))


def parsed_once(df: DataFrame, keep: list[str], schema: T.StructType) -> DataFrame:
    """``keep`` columns plus ``e = from_json(value, schema)``, parsed once.

    The parse runs inside a generator (``inline`` of a one-element array):
    its output is an attribute, so a later filter on ``e`` is not pushed
    back below it as a second ``from_json`` (a filter and a projection do
    not share subexpressions)."""
    one = F.array(F.struct(F.from_json("value", schema).alias("e")))
    return df.select(*keep, F.inline(one))


def _parse(lines: DataFrame, event: str, schema: T.StructType) -> DataFrame:
    # also with an event column: the name of a cut-off line is read, its JSON is not
    parsed = parsed_once(lines_of(lines, event), ["log"], schema)
    return parsed.where(F.col("e.Event") == event)


# ---------------------------------------------------------------- events

def job_start_events(lines: DataFrame) -> DataFrame:
    e = _parse(lines, "SparkListenerJobStart", JOB_START)
    return e.select("log", F.col("e.`Job ID`").alias("job_id"),
                    F.col("e.`Submission Time`").alias("submission_ms"),
                    F.col("e.`Stage IDs`").alias("stage_ids"))


def job_end_events(lines: DataFrame) -> DataFrame:
    e = _parse(lines, "SparkListenerJobEnd", JOB_END)
    return e.select("log", F.col("e.`Job ID`").alias("job_id"),
                    F.col("e.`Completion Time`").alias("end_ms"))


_STAGE_TIMES = _struct(("Event", S), ("Stage Info", _struct(
    ("Stage ID", L), ("Stage Attempt ID", I), ("Submission Time", L), ("Completion Time", L))))


def stage_events(lines: DataFrame, completed: bool = False, rdd_info: bool = False) -> DataFrame:
    """StageSubmitted (or StageCompleted) facts; the nested ``RDD Info``
    list is parsed only when ``rdd_info=True`` (placement needs it)."""
    name = "SparkListenerStageCompleted" if completed else "SparkListenerStageSubmitted"
    e = _parse(lines, name, STAGE_EVENT if rdd_info else _STAGE_TIMES)
    si = "e.`Stage Info`"
    cols = [F.col(f"{si}.`Stage ID`").alias("stage_id"),
            F.col(f"{si}.`Stage Attempt ID`").alias("attempt"),
            F.col(f"{si}.`Submission Time`").alias("submission_ms"),
            F.col(f"{si}.`Completion Time`").alias("completion_ms")]
    if rdd_info:
        cols.append(F.col(f"{si}.`RDD Info`").alias("rdd_info"))
    return e.select("log", *cols)


def placed_events(lines: DataFrame) -> DataFrame:
    """``(log, seq, kind, stage_id, attempt, task_id, rdds)`` of the lines that
    begin something: kind ``stage`` (a StageSubmitted line, with its persisted
    RDDs) or ``task`` (a TaskStart line). The lines must carry ``seq``."""
    if "seq" not in lines.columns:
        raise ValueError("the order of the lines is needed: a column seq")
    st = parsed_once(lines_of(lines, "SparkListenerStageSubmitted"), ["log", "seq"], STAGE_EVENT)
    level = lambda r: r["Storage Level"]
    kept = F.filter("e.`Stage Info`.`RDD Info`", lambda r: F.coalesce(level(r)["Use Disk"], F.lit(False))
                    | F.coalesce(level(r)["Use Memory"], F.lit(False)))
    stages = st.where(F.col("e.Event") == "SparkListenerStageSubmitted").select(
        "log", "seq", F.lit("stage").alias("kind"), F.col("e.`Stage Info`.`Stage ID`").alias("stage_id"),
        F.col("e.`Stage Info`.`Stage Attempt ID`").alias("attempt"), F.lit(None).cast(L).alias("task_id"),
        F.transform(kept, lambda r: r["RDD ID"]).alias("rdds"))
    ts = parsed_once(lines_of(lines, "SparkListenerTaskStart"), ["log", "seq"], TASK_START)
    tasks = ts.where(F.col("e.Event") == "SparkListenerTaskStart").select(
        "log", "seq", F.lit("task").alias("kind"), F.col("e.`Stage ID`").alias("stage_id"),
        F.col("e.`Stage Attempt ID`").alias("attempt"), F.col("e.`Task Info`.`Task ID`").alias("task_id"),
        F.lit(None).cast("array<int>").alias("rdds"))
    return stages.unionByName(tasks)


#: TaskEnd columns: output name -> (JSON path, type).
TASK_FIELDS: dict[str, tuple[tuple[str, ...], T.DataType]] = {
    "task_id": (("Task Info", "Task ID"), L),
    "stage_id": (("Stage ID",), L),
    "stage_attempt": (("Stage Attempt ID",), I),
    "task_index": (("Task Info", "Index"), I),
    "partition_id": (("Task Info", "Partition ID"), I),
    "task_attempt": (("Task Info", "Attempt"), I),
    "executor_id": (("Task Info", "Executor ID"), S),
    "host": (("Task Info", "Host"), S),
    "locality": (("Task Info", "Locality"), S),
    "launch_ms": (("Task Info", "Launch Time"), L),
    "finish_ms": (("Task Info", "Finish Time"), L),
    "failed": (("Task Info", "Failed"), B),
    "killed": (("Task Info", "Killed"), B),
    "speculative": (("Task Info", "Speculative"), B),
    "end_reason": (("Task End Reason", "Reason"), S),
}
_TM = "Task Metrics"
for _name, _key in [
        ("executorDeserializeTime", "Executor Deserialize Time"),
        ("executorDeserializeCpuTime", "Executor Deserialize CPU Time"),
        ("executorRunTime", "Executor Run Time"), ("executorCpuTime", "Executor CPU Time"),
        ("resultSize", "Result Size"), ("jvmGcTime", "JVM GC Time"),
        ("resultSerializationTime", "Result Serialization Time"),
        ("memoryBytesSpilled", "Memory Bytes Spilled"), ("diskBytesSpilled", "Disk Bytes Spilled"),
        ("peakExecutionMemory", "Peak Execution Memory")]:
    TASK_FIELDS[_name] = ((_TM, _key), L)
for _name, _sub, _key in [
        ("bytesRead", "Input Metrics", "Bytes Read"), ("recordsRead", "Input Metrics", "Records Read"),
        ("bytesWritten", "Output Metrics", "Bytes Written"),
        ("recordsWritten", "Output Metrics", "Records Written"),
        ("shuffleRemoteBlocksFetched", "Shuffle Read Metrics", "Remote Blocks Fetched"),
        ("shuffleLocalBlocksFetched", "Shuffle Read Metrics", "Local Blocks Fetched"),
        ("shuffleFetchWaitTime", "Shuffle Read Metrics", "Fetch Wait Time"),
        ("shuffleRemoteBytesRead", "Shuffle Read Metrics", "Remote Bytes Read"),
        ("shuffleLocalBytesRead", "Shuffle Read Metrics", "Local Bytes Read"),
        ("shuffleRemoteBytesReadToDisk", "Shuffle Read Metrics", "Remote Bytes Read To Disk"),
        ("shuffleRecordsRead", "Shuffle Read Metrics", "Total Records Read"),
        ("shuffleBytesWritten", "Shuffle Write Metrics", "Shuffle Bytes Written"),
        ("shuffleWriteTime", "Shuffle Write Metrics", "Shuffle Write Time"),
        ("shuffleRecordsWritten", "Shuffle Write Metrics", "Shuffle Records Written")]:
    TASK_FIELDS[_name] = ((_TM, _sub, _key), L)


def schema_for(paths: list[tuple[tuple[str, ...], T.DataType]]) -> T.StructType:
    """The smallest nested schema holding the given JSON paths."""
    tree: dict = {}
    for path, dtype in paths:
        node = tree
        for part in path[:-1]:
            node = node.setdefault(part, {})
        node[path[-1]] = dtype

    def build(node) -> T.StructType:
        return T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else v, True)
                             for k, v in node.items()])
    return build(tree)


def task_end_events(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per TaskEnd line: ``log`` and the requested ``columns`` of
    ``TASK_FIELDS`` (default: all). Only those fields are parsed: on large
    logs the JSON parse is the main cost, and a narrow schema cuts it."""
    cols = list(columns) if columns else list(TASK_FIELDS)
    schema = schema_for([(("Event",), S)] + [TASK_FIELDS[c] for c in cols])
    e = _parse(lines, "SparkListenerTaskEnd", schema)
    return e.select("log", *[
        F.col("e." + ".".join(f"`{p}`" for p in TASK_FIELDS[c][0])).alias(c) for c in cols])


#: BlockUpdated columns: output name -> (JSON path, type).
_BU = "Block Updated Info"
BLOCK_FIELDS: dict[str, tuple[tuple[str, ...], T.DataType]] = {
    "block_id": ((_BU, "Block ID"), S),
    "exec_id": ((_BU, "Block Manager ID", "Executor ID"), S),
    "host": ((_BU, "Block Manager ID", "Host"), S),
    "memsize": ((_BU, "Memory Size"), L),
    "disksize": ((_BU, "Disk Size"), L),
    "use_disk": ((_BU, "Storage Level", "Use Disk"), B),
    "use_memory": ((_BU, "Storage Level", "Use Memory"), B),
    "use_off_heap": ((_BU, "Storage Level", "Use Off Heap"), B),
    "deserialized": ((_BU, "Storage Level", "Deserialized"), B),
    "replicas": ((_BU, "Storage Level", "Replication"), I),
}


def block_update_events(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """BlockUpdated lines; the line order inside a log is kept as ``seq``. With
    ``columns`` only those of ``BLOCK_FIELDS``, and only they are parsed.

    Block updates carry no time, so "latest" means the last line of the log.
    The lines must carry it as ``seq``, as the readers' do.
    """
    if "seq" not in lines.columns:
        raise ValueError("block updates need the order of the lines: a column seq")
    cols = list(columns) if columns else list(BLOCK_FIELDS)
    schema = schema_for([(("Event",), S)] + [BLOCK_FIELDS[c] for c in cols])
    e = parsed_once(lines_of(lines, "SparkListenerBlockUpdated"), ["log", "seq"], schema)
    e = e.where(F.col("e.Event") == "SparkListenerBlockUpdated")
    return e.select("log", "seq", *[
        F.col("e." + ".".join(f"`{p}`" for p in BLOCK_FIELDS[c][0])).alias(c) for c in cols])


def unpersist_events(lines: DataFrame, seq: bool = False) -> DataFrame:
    """Unpersisted RDDs; with ``seq`` also the place of the line."""
    more = ["seq"] if seq else []
    parsed = parsed_once(lines_of(lines, "SparkListenerUnpersistRDD"), ["log", *more], UNPERSIST)
    e = parsed.where(F.col("e.Event") == "SparkListenerUnpersistRDD")
    return e.select("log", F.col("e.`RDD ID`").alias("rdd_id"), *more)


def app_start_events(lines: DataFrame) -> DataFrame:
    e = _parse(lines, "SparkListenerApplicationStart", APP_START)
    return e.select("log", F.col("e.`App ID`").alias("app_id"),
                    F.col("e.`App Name`").alias("app_name"),
                    F.col("e.Timestamp").alias("start_ms"))


def app_ids(lines: DataFrame) -> DataFrame:
    """``(log, app_id, app_name)`` from each log's ApplicationStart line; join
    it to any table's ``app`` (= log key) to report Spark application ids."""
    return app_start_events(lines).select("log", "app_id", "app_name").distinct()


def epoch_ms(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> epoch milliseconds (BIGINT)."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_us(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> epoch microseconds (BIGINT)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
