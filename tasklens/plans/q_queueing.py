"""Registered queries of the queueing family (Q1-Q4, G8 on events).

Queue form of ``events``: queue = ``user_id``, jobs in (ts, event_id)
order, arrival = epoch microseconds of ``ts``, service =
round(value * 300 * 1e6) microseconds (the factor makes about 39% of
jobs wait). Fork-join / barrier jobs have 3 tasks with service
round(value * 1e6 * (100 + 200 * U(42, 't', event_id, task))).
Queues with many jobs are cut into ranges of the arrival times.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import queueing as Q
from ..sources.eventlog import epoch_us
from .registry import register, tables

SEED = 42
ORDER = ["arrival", "event_id"]


def queue_jobs(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return events.select(
        "user_id", "event_id", epoch_us(F.col("ts")).alias("arrival"),
        F.round(F.col("value") * F.lit(300.0) * F.lit(1000000.0)).cast("bigint").alias("service"),
        "value")


def queue_tasks(spark, sf_dir, tasks: int = 3):
    j = queue_jobs(spark, sf_dir).drop("service")
    t = j.withColumn("task", F.explode(F.sequence(F.lit(1), F.lit(tasks))))
    factor = F.lit(100.0) + F.lit(200.0) * rng.uniform(SEED, "t", F.col("event_id"), F.col("task"))
    return t.withColumn("service", F.round(F.col("value") * F.lit(1000000.0) * factor).cast("bigint"))


@register("Q1_arrival_schedule")
def q1(spark, sf_dir):
    """Q1: per user queue, arrival = running sum of earlier exponential inter-arrival gaps."""
    (events,) = tables(spark, sf_dir, "events")
    ia = F.round(-F.ln(rng.uniform(SEED, "ia", F.col("event_id"))) * F.lit(60000000.0)).cast("bigint")
    df = events.select("user_id", "event_id", "ts", ia.alias("interarrival"))
    out = Q.arrival_schedule(df, ["user_id"], ["ts", "event_id"], "interarrival")
    return out.select("user_id", "event_id", "interarrival", "arrival")


def _q2(spark, sf_dir, method):
    j = queue_jobs(spark, sf_dir).drop("value")
    return Q.fifo_departures(j, ["user_id"], ORDER, method=method)


@register("Q2_fifo_departures")
def q2(spark, sf_dir):
    """Q2: FIFO departure, waiting and sojourn times per user queue (max-plus scan, large queues in ranges)."""
    return _q2(spark, sf_dir, "split")


@register("Q2b_fifo_departures_blocked")
def q2b(spark, sf_dir):
    """Q2: the scan in hourly blocks of every queue."""
    return _q2(spark, sf_dir, "blocked")


@register("Q2r_fifo_departures_ranges")
def q2r(spark, sf_dir):
    """Q2: one queue of all events, cut into ranges of 1000 jobs: a tree scan."""
    j = queue_jobs(spark, sf_dir).select(F.lit("all").alias("queue"), "event_id", "arrival",
                                         F.floor(F.col("value") * 1000).cast("bigint").alias("service"))
    return Q.fifo_departures(j, ["queue"], ORDER, split_rows=1000)


@register("Q2w_fifo_departures_window")
def q2w(spark, sf_dir):
    """Q2: the same with one window per queue."""
    return _q2(spark, sf_dir, "window")


@register("Q3_forkjoin_departures")
def q3(spark, sf_dir):
    """Q3: fork-join: 3 tasks per job, task i on worker i, job leaves with its last task."""
    t = queue_tasks(spark, sf_dir)
    return Q.forkjoin_departures(t, ["user_id"], "event_id", "task", ORDER)


@register("Q4_barrier_departures")
def q4(spark, sf_dir):
    """Q4: barrier mode: a job's service is its longest task, one FIFO queue of jobs."""
    t = queue_tasks(spark, sf_dir)
    return Q.barrier_departures(t, ["user_id"], "event_id", ORDER)
