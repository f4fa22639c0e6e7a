"""Registered queries of the placement and mode families (P1-P3, A3, A4,
E1-E4, A6, A7)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import modes as E
from ..operators import placement as P
from ..operators import workloads as W
from ..sources import generators as G
from ..session import spread
from ..sources.tablelog import (
    ROW_KEY, lineitem_moving_blocks_log, lineitem_placement_log, placement_lines_in_place, placement_rows)
from .registry import register, tables

SEED = 42


def placement_lines(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return lineitem_placement_log(spread(li, ROW_KEY))


@register("P1_block_locations")
def p1(spark, sf_dir):
    """Last known location of every cached block (live RDDs only) from block-update lines."""
    return P.block_locations(placement_lines(spark, sf_dir), live_only=True)


#: Files of a rolled log up to which they are written plain.
PLAIN_FILES = 12


def rolled_log(spark, sf_dir, files: int = 12):
    """The placement log written the way Spark rolls a log, one folder per
    application with at least ``files`` numbered files of growing size (more on
    long logs), read back by byte ranges and split by event, so that it is
    scanned once."""
    from ..sources.eventlog import open_writers, read_event_log, split_events
    from ..streaming.eventlog_stream import LINES_PER_FILE, OPEN_LOGS, scratch_path
    (li,) = tables(spark, sf_dir, "lineitem")
    files = max(files, 2 * li.count() // LINES_PER_FILE)
    rows = placement_rows(spread(li, ROW_KEY))
    # the lines are in the order of seq, a 52-bit number; later files hold more
    share = F.sqrt(F.coalesce(F.col("seq"), F.lit(0)) / F.lit(float(1 << 52)))
    number = F.least(F.floor((1 - share) * files), F.lit(files - 1))
    rows = rows.withColumn("n", (files - number).cast("int"))
    folder, top = scratch_path(spark, "parts"), scratch_path(spark, "rolled")
    # rows, not their text, are dealt out and sorted; the files of long logs are compressed
    dealt = rows.repartition(files, "log", "n").sortWithinPartitions("log", "n", "seq")
    with open_writers(spark, OPEN_LOGS):        # a task has a few files; no sort but the one by seq
        (placement_lines_in_place(dealt, ["n"]).write.partitionBy("log", "n")
         .option("compression", "gzip" if files > PLAIN_FILES else "none").text(folder))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    for st in fs.globStatus(path(f"{folder}/log=*/n=*/part-*")):     # ``files`` of each application
        part = st.getPath()
        log, n = (part.getParent().getParent().getName()[4:], part.getParent().getName()[2:])
        fs.mkdirs(path(f"{top}/eventlog_v2_{log}"))
        ending = ".gz" if part.getName().endswith(".gz") else ""
        fs.rename(part, path(f"{top}/eventlog_v2_{log}/events_{n}_{log}{ending}"))
    rolled = read_event_log(spark, f"{top}/eventlog_v2_*", rolled=True)
    return split_events(rolled.withColumn("log", F.regexp_extract("log", r"eventlog_v2_([^/]*)$", 1)))


@register("P1r_block_locations_rolled")
def p1r(spark, sf_dir):
    """P1 over rolled log files of unequal size: the last update is the last line of the last file."""
    return P.block_locations(rolled_log(spark, sf_dir), live_only=True)


@register("A4r_report_by_executor_rolled")
def a4r(spark, sf_dir):
    """A4 over the rolled log files."""
    return P.report_by_executor(P.placement(rolled_log(spark, sf_dir)))


@register("P2_placement")
def p2(spark, sf_dir):
    """Per task, executing executor vs storage executor of its partition."""
    return P.placement(placement_lines(spark, sf_dir))


@register("A3_executor_partitions")
def a3(spark, sf_dir):
    """A3: per executor and RDD, the sorted partition ids it stores, in pages of 4096 ids."""
    loc = P.block_locations(placement_lines(spark, sf_dir), live_only=True)
    return P.executor_partitions(loc).select(
        "app", "exec_id", "rdd_id", "page", "n_parts",
        F.array_join(F.transform("part_ids", lambda x: x.cast("string")), ",").alias("part_ids"))


@register("A3b_executor_partition_bitmaps")
def a3b(spark, sf_dir):
    """A3 by bitmaps: the ids that each executor stores, kept as bitmaps
    and read back in pages of 4096 ids."""
    loc = P.block_locations(placement_lines(spark, sf_dir), live_only=True)
    return P.bitmap_pages(P.executor_partition_bitmaps(loc)).select(
        "app", "exec_id", "rdd_id", "page", "n_parts",
        F.array_join(F.transform("part_ids", lambda x: x.cast("string")), ",").alias("part_ids"))


@register("A4_report_by_executor")
def a4(spark, sf_dir):
    """A4: placement rows per executing executor: tasks, local tasks, bytes."""
    return P.report_by_executor(P.placement(placement_lines(spark, sf_dir)))


@register("P3_partition_profile")
def p3(spark, sf_dir):
    """Rows, bytes and key range per partition of the G3 table over supplier rows."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    df = G.random_payloads_for(G.partitions_for(supplier, "s_suppkey", 16), "id", 40, SEED)
    return P.partition_profile(df, key="id", payload="payload", part=F.col("part"))


@register("P3h_partition_profile_hosts")
def p3h(spark, sf_dir):
    """Profile of keyed records hash-partitioned by key, with the host of
    each partition, summed up so that the result names no host."""
    (orders,) = tables(spark, sf_dir, "orders")
    df = G.keyed_records_for(orders, "o_orderkey", 7, 16, SEED).repartition(8, "key")
    prof = P.partition_profile(df, key="key", payload="payload", with_host=True)
    return prof.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
                    F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"),
                    F.bool_and(F.length("host") > 0).alias("hosts_known"))


def part_payloads(spark, sf_dir):
    (part,) = tables(spark, sf_dir, "part")
    return spread(part, ["p_partkey"]).select("p_partkey", "p_brand",
                       rng.payload(SEED, F.col("p_partkey"), F.col("p_size")).alias("payload"))


@register("E1_plain")
def e1(spark, sf_dir):
    """Byte max of each part's payload as a narrow projection."""
    out = E.run_plain(part_payloads(spark, sf_dir), lambda c: W.byte_max(c).cast("bigint"))
    return out.select("p_partkey", "result")


@register("E2_staged")
def e2(spark, sf_dir):
    """Payloads shuffled by brand, workload, then aggregated per brand."""
    return E.run_staged(part_payloads(spark, sf_dir), "p_brand", lambda c: W.byte_max(c))


@register("E3_barrier")
def e3(spark, sf_dir):
    """Byte max of each part's payload in barrier mode (all tasks start together)."""
    # barrier mode needs a free slot per partition: as many as the session has
    return E.run_barrier(part_payloads(spark, sf_dir), "p_partkey").select(
        F.col("id").alias("p_partkey"), "result")


@register("E3s_barrier_scaled")
def e3s(spark, sf_dir):
    """E3 in two phases: byte max of each part's payload, scaled to the range that
    all tasks of the barrier stage agree on (allGather)."""
    return E.run_barrier_scaled(part_payloads(spark, sf_dir), "p_partkey").withColumnRenamed("id", "p_partkey")


@register("E4_persisted")
def e4(spark, sf_dir):
    """Byte max over a persisted (memory and disk) copy of the part payloads."""
    from ..streaming.eventlog_stream import scratch_path
    path = scratch_path(spark, "persisted")
    with E.Persisted(part_payloads(spark, sf_dir), StorageLevel.MEMORY_AND_DISK) as cached:
        out = cached.run(lambda c: W.byte_max(c).cast("bigint")).select("p_partkey", "result")
        out.write.parquet(path)     # the result outlives the cached blocks
        return spark.read.schema(out.schema).parquet(path)


@register("A6_slice_count")
def a6(spark, sf_dir):
    """Number of slices (part payloads) the workload ran on."""
    return E.slice_count(E.run_plain(part_payloads(spark, sf_dir), lambda c: W.byte_max(c)))


@register("A7_staged_count")
def a7(spark, sf_dir):
    """The two-shuffle staged count over part keys (1 for any non-empty input)."""
    (part,) = tables(spark, sf_dir, "part")
    return E.staged_count(part, "p_partkey")


@register("P2h_hybrid_placement")
def p2h(spark, sf_dir):
    """P2h: the hybrid runner. Every task of the placement log runs a
    workload chosen by the executor that ran it (W9) over an 8-byte
    payload of its own, next to where its partition is stored (P2)."""
    placed = P.placement(placement_lines(spark, sf_dir))
    payloads = placed.withColumn("payload", rng.payload(SEED, F.col("task_id"), 8))
    by_executor = {
        "0": lambda c: W.byte_max(c).cast("bigint"),
        "1": lambda c: W.byte_min(c).cast("bigint"),
        "2": lambda c: W.random_element(c, SEED, F.col("task_id")).cast("bigint"),
    }
    out = W.apply_workload_by(payloads, "exec_executor", by_executor,
                              lambda c: F.length(c).cast("bigint"))
    return out.select("app", "task_id", "part_id", "exec_executor", "storage_executor", "result")


def moving_lines(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return lineitem_moving_blocks_log(spread(li, ROW_KEY))


@register("P2t_placement_as_of")
def p2t(spark, sf_dir):
    """P2 at run time: where each task's partition was stored when the task was
    launched (as-of join), with blocks that are dropped and moved."""
    return P.placement_as_of(moving_lines(spark, sf_dir), at="task")


@register("A4t_report_by_executor_as_of")
def a4t(spark, sf_dir):
    """A4 over the placement at run time."""
    return P.report_by_executor(P.placement_as_of(moving_lines(spark, sf_dir), at="task"))
