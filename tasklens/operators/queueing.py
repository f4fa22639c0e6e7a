"""Arrival schedules and departure times of FIFO queues (Q1-Q4).

Lindley's recursion ``d_n = max(a_n, d_{n-1}) + s_n`` is a max-plus scan:
with SS_n = s_1 + ... + s_n,

    d_n = SS_n + max_{k<=n} (a_k - SS_k + s_k),

so it is two running window aggregates, no loop. (SS, max) pairs form a monoid,
so the scan can be cut anywhere: run inside blocks of consecutive jobs, then over
the table of block summaries, and combined by

    d_n = ls_n + S0 + greatest(lm_n - S0, M0)

(ls, lm: running sum of service and running max inside the block;
S0: service of all earlier blocks; M0: max over earlier blocks of their
M - S0).

``method="split"`` (the default): an ordinary queue is one window; the jobs of a
queue with over ``split_rows`` jobs are cut into ranges of about as many by
``plans.ranking.ranges_within``, at whole order keys, so a queue with a third of
all jobs is many tasks also when all of them arrive in one hour. The summaries
are scanned as a tree: in groups of ``FAN`` ranges, then over the groups, so that
no window holds more than ``FAN`` ranges or the groups of a queue.
``method="blocked"`` cuts every queue by ``block``, a value that never falls along
the order (default: the first order column in units of ``BLOCK_SPAN``, an hour of
microseconds), without counting. ``method="window"`` is one window for each queue.

Times are integers (e.g. microseconds); arrivals are never summed (epoch
microseconds would overflow), only services and inter-arrival gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import SPLIT_ROWS, ranges_within, same_keys

_UNB = Window.unboundedPreceding
#: Units of the first order column in a block: an hour, if these are microseconds.
BLOCK_SPAN = 3_600_000_000
#: Ranges of a queue that are scanned in one window.
FAN = 1024


def _blocks(df: DataFrame, order: list[str | Column], block: Column | None) -> DataFrame:
    if block is None:
        first = F.col(order[0]) if isinstance(order[0], str) else order[0]
        block = F.floor(first / F.lit(BLOCK_SPAN))
    return df.withColumn("_tl_blk", block)


def _check(method: str | None, block: Column | None) -> str:
    method = method or ("split" if block is None else "blocked")
    if method not in ("split", "window", "blocked"):
        raise ValueError("method must be 'split', 'blocked' or 'window'")
    return method


def _before(blocks: DataFrame, queue: list[str], at: str) -> DataFrame:
    """``_tl_S0``, ``_tl_M0`` of each row of ``(queue, at, _tl_S, _tl_M)``: service
    and max-plus maximum of all rows of the queue that come earlier by ``at``."""
    w = Window.partitionBy(*queue).orderBy(at).rowsBetween(_UNB, -1)
    return (blocks.withColumn("_tl_S0", F.coalesce(F.sum("_tl_S").over(w), F.lit(0)))
            .withColumn("_tl_M0", F.max(F.col("_tl_M") - F.col("_tl_S0")).over(w)))


def _tree_before(blocks: DataFrame, queue: list[str]) -> DataFrame:
    """``_before`` in two levels: inside groups of ``FAN`` blocks, and over groups."""
    inside = _before(blocks.withColumn("_tl_up", F.floor(F.col("_tl_blk") / FAN)), [*queue, "_tl_up"], "_tl_blk")
    groups = inside.groupBy(*queue, "_tl_up").agg(
        F.max(F.col("_tl_M") - F.col("_tl_S0")).alias("_tl_M"), F.sum("_tl_S").alias("_tl_S"))
    above = _before(groups, queue, "_tl_up").select(
        *queue, "_tl_up", F.col("_tl_S0").alias("_tl_uS"), F.col("_tl_M0").alias("_tl_uM"))
    return same_keys(inside, above, [*queue, "_tl_up"], "inner").select(
        *queue, "_tl_blk", (F.col("_tl_S0") + F.col("_tl_uS")).alias("_tl_S0"),
        F.greatest(F.col("_tl_M0") - F.col("_tl_uS"), F.col("_tl_uM")).alias("_tl_M0"))


def _scanned(p: DataFrame, queue: list[str], order: list[str | Column], s: Column, a: Column, before) -> DataFrame:
    """``departure`` of jobs with a block ``_tl_blk``."""
    w = Window.partitionBy(*queue, "_tl_blk").orderBy(*order).rowsBetween(_UNB, 0)
    local = (p.withColumn("_tl_ls", F.sum(s).over(w))
             .withColumn("_tl_lm", F.max(a - F.col("_tl_ls") + s).over(w)))
    blocks = local.groupBy(*queue, "_tl_blk").agg(F.sum(s).alias("_tl_S"), F.max("_tl_lm").alias("_tl_M"))
    start = before(blocks).select(*queue, "_tl_blk", "_tl_S0", "_tl_M0")
    return (same_keys(local, start, [*queue, "_tl_blk"], "inner")
            .withColumn("departure", F.col("_tl_ls") + F.col("_tl_S0")
                        + F.greatest(F.col("_tl_lm") - F.col("_tl_S0"), F.col("_tl_M0")))
            .drop("_tl_blk", "_tl_ls", "_tl_lm", "_tl_S0", "_tl_M0"))


def _running(p: DataFrame, queue: list[str], order: list[str | Column], ia: Column, out: str, before) -> DataFrame:
    """Sum of all earlier ``ia`` of jobs with a block ``_tl_blk``."""
    w = Window.partitionBy(*queue, "_tl_blk").orderBy(*order).rowsBetween(_UNB, 0)
    local = p.withColumn("_tl_ls", F.sum(ia).over(w))
    blocks = local.groupBy(*queue, "_tl_blk").agg(F.sum(ia).alias("_tl_S"), F.lit(None).cast("bigint").alias("_tl_M"))
    start = before(blocks).select(*queue, "_tl_blk", "_tl_S0")
    return (same_keys(local, start, [*queue, "_tl_blk"], "inner")
            .withColumn(out, F.col("_tl_S0") + F.col("_tl_ls") - ia).drop("_tl_blk", "_tl_ls", "_tl_S0"))


def arrival_schedule(df: DataFrame, queue: list[str], order: list[str | Column],
                     interarrival: str, out: str = "arrival", method: str | None = None,
                     block: Column | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Q1: arrival_1 = 0, arrival_{n+1} = arrival_n + interarrival_n."""
    ia, method = F.col(interarrival), _check(method, block)

    def windowed(rows):
        w = Window.partitionBy(*queue).orderBy(*order).rowsBetween(_UNB, -1)
        return rows.withColumn(out, F.coalesce(F.sum(ia).over(w), F.lit(0)))
    if method == "window":
        return windowed(df)
    if method == "blocked":
        return _running(_blocks(df, order, block), queue, order, ia, out, lambda b: _before(b, queue, "_tl_blk"))
    rest, ranged = ranges_within(df, queue, order, split_rows, part="_tl_blk")
    return windowed(rest).unionByName(
        _running(ranged, queue, order, ia, out, lambda b: _tree_before(b, queue)))


def fifo_departures(df: DataFrame, queue: list[str], order: list[str | Column],
                    arrival: str = "arrival", service: str = "service", method: str | None = None,
                    block: Column | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Q2: one server per queue, first come first served.

    Adds ``departure``, ``waiting`` (= departure - service - arrival) and
    ``sojourn`` (= departure - arrival).
    """
    a, s, method = F.col(arrival), F.col(service), _check(method, block)

    def windowed(rows):
        w = Window.partitionBy(*queue).orderBy(*order).rowsBetween(_UNB, 0)
        return (rows.withColumn("_tl_ss", F.sum(s).over(w))
                .withColumn("departure", F.col("_tl_ss") + F.max(a - F.col("_tl_ss") + s).over(w))
                .drop("_tl_ss"))
    if method == "window":
        out = windowed(df)
    elif method == "blocked":
        out = _scanned(_blocks(df, order, block), queue, order, s, a, lambda b: _before(b, queue, "_tl_blk"))
    else:
        rest, ranged = ranges_within(df, queue, order, split_rows, part="_tl_blk")
        out = windowed(rest).unionByName(_scanned(ranged, queue, order, s, a, lambda b: _tree_before(b, queue)))
    return (out.withColumn("waiting", F.col("departure") - s - a)
            .withColumn("sojourn", F.col("departure") - a))


def forkjoin_departures(tasks: DataFrame, queue: list[str], job: str, worker: str,
                        order: list[str | Column], arrival: str = "arrival",
                        service: str = "service", method: str | None = None,
                        block: Column | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Q3: task i of every job runs on worker i (a persisted partition binds
    it to one executor); each worker is a FIFO queue; a job leaves when its
    last task does. ``(queue..., job, arrival, departure, sojourn)``."""
    per_task = fifo_departures(tasks, [*queue, worker], order, arrival, service, method, block, split_rows)
    return (per_task.groupBy(*queue, job)
            .agg(F.max(arrival).alias("arrival"), F.max("departure").alias("departure"))
            .withColumn("sojourn", F.col("departure") - F.col("arrival")))


def barrier_departures(tasks: DataFrame, queue: list[str], job: str, order: list[str | Column],
                       arrival: str = "arrival", service: str = "service", method: str | None = None,
                       block: Column | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Q4: barrier mode, all tasks of a job start together; with as many
    tasks as workers this is split-merge: the job's service time is its
    longest task, then one FIFO queue of jobs."""
    jobs = tasks.groupBy(*queue, job).agg(F.max(arrival).alias(arrival),
                                          F.max(service).alias(service))
    return fifo_departures(jobs, queue, order, arrival, service, method, block, split_rows)
