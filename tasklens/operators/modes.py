"""Execution modes of a workload (E1-E4) and the slice counts.

The original fires empty, clock-driven tasks in four ways; here each mode
runs a real workload (a ``Column -> Column`` function, see
``operators.workloads``) over the rows of a DataFrame:

* E1 plain:     a narrow projection, one task per input partition;
* E2 staged:    a hash shuffle on a key before the workload and an
                aggregation after it (two stage boundaries);
* E3 barrier:   ``mapInArrow(..., barrier=True)``: every task of the stage
                starts together (needs as many free slots as partitions), in
                its two-phase form with an exchange between all tasks;
* E4 persisted: the input is cached first, so tasks run where its blocks
                are (subject to ``spark.locality.wait``).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytes_np


def run_plain(df: DataFrame, workload: Callable[[Column], Column], col: str = "payload",
              out: str = "result") -> DataFrame:
    """The workload as a narrow projection."""
    return df.withColumn(out, workload(F.col(col)))


def run_staged(df: DataFrame, key: str, workload: Callable[[Column], Column],
               num_partitions: int | None = None, col: str = "payload") -> DataFrame:
    """Shuffle by ``key``, run the workload, aggregate per key.

    ``(key, n, result_max, result_sum)``. The explicit repartition is the
    first stage boundary; the aggregation the second.
    """
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = df.repartition(parts, key).withColumn("_tl_r", workload(F.col(col)).cast("bigint"))
    return staged.groupBy(key).agg(F.count(F.lit(1)).alias("n"),
                                   F.max("_tl_r").alias("result_max"),
                                   F.sum("_tl_r").alias("result_sum"))


def run_barrier(df: DataFrame, id_col: str, fn: Callable[[bytes], int] | None = None,
                col: str = "payload", num_partitions: int | None = None) -> DataFrame:
    """``(id, result)`` computed in barrier mode; ``fn`` maps a payload to
    a number (default: W1, a whole batch at once).

    All tasks are gang-scheduled; Spark fails the stage when there are
    fewer free slots than partitions, so the input is cut into at most
    ``num_partitions`` (default: the default parallelism) partitions.
    """
    spark = df.sparkSession
    n = num_partitions or spark.sparkContext.defaultParallelism
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(col).alias("payload")).repartition(n)

    def _run(batches):
        for b in batches:
            if fn is None:
                vals = bytes_np.reduce_bytes(b.column(1), np.maximum, -128).cast(pa.int64())
            else:
                vals = pa.array([None if p is None else fn(p) for p in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), vals], ["id", "result"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("result", T.LongType())])
    return src.mapInArrow(_run, schema, barrier=True)


def run_barrier_scaled(df: DataFrame, id_col: str, col: str = "payload",
                       num_partitions: int | None = None) -> DataFrame:
    """E3 in two phases of one gang-scheduled stage:
    ``(id, result, low, high, scaled)``.

    Every task computes the workload (W1) of its rows, then all exchange the
    smallest and largest result they saw (``BarrierTaskContext.allGather``, which
    returns only when every task has come that far), and each scales its results
    to thousandths of the common range. No second stage and no second pass over
    the payloads; tasks that did not run together could not finish. A task
    holds two numbers for each of its rows, never a payload. Results of empty
    payloads count as W1 defines them; NULL payloads have NULLs and no part in
    the range.
    """
    n = num_partitions or df.sparkSession.sparkContext.defaultParallelism
    src = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(col).alias("payload")).repartition(n)

    def _run(batches):
        from pyspark import BarrierTaskContext
        ids, results = [], []
        for b in batches:
            ids.append(b.column(0))
            known = pc.is_valid(b.column(1))
            found = bytes_np.reduce_bytes(b.column(1), np.maximum, -128).cast(pa.int64())
            results.append(pc.if_else(known, found, pa.scalar(None, pa.int64())))
        own = pc.min_max(pa.chunked_array(results, pa.int64()))
        seen = [json.loads(x) for x in BarrierTaskContext.get().allGather(
            json.dumps([own["min"].as_py(), own["max"].as_py()]))]
        low = min((a for a, _ in seen if a is not None), default=None)
        high = max((b for _, b in seen if b is not None), default=None)
        for i, r in zip(ids, results):
            scaled = [None if x is None else (x - low) * 1000 // max(high - low, 1) for x in r.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [i, r, pa.array([low] * len(i), pa.int64()), pa.array([high] * len(i), pa.int64()),
                 pa.array(scaled, pa.int64())], names=["id", "result", "low", "high", "scaled"])

    return src.mapInArrow(_run, "id long, result long, low long, high long, scaled long", barrier=True)


class Persisted:
    """A cached input for workloads bound to its blocks.

    ``with Persisted(df) as cached: ...`` marks the input as cached (the first
    workload fills the blocks) and unpersists it at the end; ``fill()`` makes
    the blocks exist before any workload runs.
    """

    def __init__(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_ONLY):
        self.df = df.persist(level)

    def fill(self) -> int:
        """Compute all blocks; the number of rows."""
        return self.df.count()

    def run(self, workload: Callable[[Column], Column], col: str = "payload",
            out: str = "result") -> DataFrame:
        return run_plain(self.df, workload, col, out)

    def unpersist(self) -> None:
        self.df.unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.unpersist()


def slice_count(df: DataFrame, result: str | None = "result") -> DataFrame:
    """Number of slices executed (one per row).

    Counting the workload's ``result`` column makes the workload run: a
    plain row count lets Catalyst prune the unused workload projection."""
    if result and result in df.columns:
        done = F.count(F.when(F.col(result).isNotNull() | F.col(result).isNull(), F.lit(1)))
        return df.agg(done.alias("slices"))
    return df.agg(F.count(F.lit(1)).alias("slices"))


def staged_count(df: DataFrame, col: str) -> DataFrame:
    """The original's two-shuffle count: group by identity, map every
    group to 1, group by that value, count the groups. 1 for any non-empty
    input (0 for an empty one), not the number of slices."""
    first = df.groupBy(col).agg(F.count(F.lit(1)).alias("_tl_n"))
    ones = first.select(F.lit(1).alias("one"))
    return ones.groupBy("one").agg(F.count(F.lit(1)).alias("_tl_m")).agg(
        F.count(F.lit(1)).alias("staged_count"))
