"""Seeded generators of partitioned data (G1-G9) and random processes.

Every generator has two entry points:

* a range form (``spark, n, ...``) that makes exactly the partition count
  asked for (``spark.range(start, end, 1, numPartitions)`` gives each
  partition one contiguous slice), and
* a ``*_for(df, id_col, ...)`` form that adds payloads, keys or samples to
  the rows of any DataFrame, e.g. ids taken from a table.

All randomness is counter-based (``functions.rng``): the same seed gives the
same rows whatever the partitioning, and a re-run task after an executor
loss recomputes identical values.
"""

from __future__ import annotations

import functools
import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng

# ------------------------------------------------------------------ G1-G3


def index_partitions(spark: SparkSession, n: int) -> DataFrame:
    """G1: integers ``id`` = 1..n (INT), exactly one per partition."""
    return spark.range(1, n + 1, 1, n).select(F.col("id").cast("int").alias("id"))


def zero_partitions(spark: SparkSession, num_partitions: int, partition_size: int) -> DataFrame:
    """``(id INT, payload BINARY)``; one record of ``partition_size``
    zero bytes per partition, ids 1-based. Compresses to almost nothing."""
    return index_partitions(spark, num_partitions).select(
        "id", rng.zeros(partition_size).alias("payload"))


def random_partitions(spark: SparkSession, num_partitions: int, partition_size: int,
                      seed: int = 42) -> DataFrame:
    """As G2 with pseudo-random, incompressible bytes."""
    return random_payloads_for(index_partitions(spark, num_partitions), "id",
                               F.lit(partition_size), seed)


def partitions_for(df: DataFrame, id_col: str, num_partitions: int) -> DataFrame:
    """G1 on given ids: ``(id, part)``, the rows dealt to ``num_partitions``
    partitions by ``part`` = (id - 1) mod num_partitions."""
    part = F.pmod(F.col(id_col) - 1, F.lit(int(num_partitions))).cast("int")
    return (df.select(F.col(id_col).alias("id"), part.alias("part"))
            .repartition(int(num_partitions), "part"))


def chunked_payloads_for(df: DataFrame, id_col: str, size: Column | int, max_record_bytes: int,
                         seed: int = 42, zero: bool = False) -> DataFrame:
    """Payloads too large for one row: ``(id, chunk, payload)`` rows of at most
    ``max_record_bytes`` (a multiple of 16) each, chunk ``k`` holding bytes
    ``[k * max_record_bytes, ...)`` of the same payload as the one-row form
    (zeros, or ``PAYLOAD(seed, id, size)``). A 1 GiB partition becomes, e.g.,
    16 rows of 64 MiB, well under the 2 GiB limit of one value."""
    if max_record_bytes <= 0 or max_record_bytes % 16:
        raise ValueError("max_record_bytes must be a positive multiple of 16")
    size = size if isinstance(size, Column) else F.lit(int(size))
    m = F.lit(int(max_record_bytes))
    n_chunks = F.greatest(F.ceil(size / m).cast("bigint"), F.lit(1))
    rows = df.select(F.col(id_col).alias("id"), size.alias("_tl_size"),
                     F.explode(F.sequence(F.lit(0).cast("bigint"), n_chunks - 1)).alias("chunk"))
    start = F.col("chunk") * m
    length = F.least(m, F.col("_tl_size") - start).cast("int")
    body = rng.zeros(length) if zero else rng.payload_slice(seed, F.col("id"), start, length)
    return rows.select("id", "chunk", body.alias("payload"))


def random_payloads_for(df: DataFrame, id_col: str, size: Column | int, seed: int = 42,
                        out: str = "payload") -> DataFrame:
    """Add ``size`` random bytes keyed by (seed, id) to every row."""
    size = size if isinstance(size, Column) else F.lit(int(size))
    return df.withColumn(out, rng.payload(seed, F.col(id_col), size))


# ------------------------------------------------------------------ G4


#: Largest dict of sizes that is broadcast.
MAX_DICT = 10_000


def sized_payloads_for(df: DataFrame, id_col: str, label_col: str, sizes: DataFrame | dict,
                       default_size: int = 1, seed: int = 42) -> DataFrame:
    """Payload size looked up by a label, ``default_size`` when the
    label is not listed (an empty table means the default everywhere).

    ``sizes`` is ``(label, size)``. A dict of at most ``MAX_DICT`` labels is
    turned into a broadcast table, which keeps the partitions of ``df``; more
    labels raise (give them as a table). A table is left-joined and AQE decides
    on a broadcast from its runtime size.
    """
    if isinstance(sizes, dict):
        if len(sizes) > MAX_DICT:
            raise ValueError(f"more than {MAX_DICT} labels: give the sizes as a table")
        spark = df.sparkSession
        schema = T.StructType([T.StructField("_tl_label", T.StringType()),
                               T.StructField("_tl_size", T.IntegerType())])
        table = spark.createDataFrame([(str(k), int(v)) for k, v in sizes.items()], schema)
        table = F.broadcast(table)
        key = F.col(label_col).cast("string")
    else:
        table = sizes.select(F.col(sizes.columns[0]).alias("_tl_label"),
                             F.col(sizes.columns[1]).cast("int").alias("_tl_size"))
        key = F.col(label_col)
    joined = df.join(table, key == F.col("_tl_label"), "left").drop("_tl_label")
    size = F.coalesce(F.col("_tl_size"), F.lit(int(default_size)))
    return (joined.withColumn("size", size).drop("_tl_size")
            .withColumn("payload", rng.payload(seed, F.col(id_col), F.col("size"))))


def sized_partitions(spark: SparkSession, num_partitions: int, sizes: dict,
                     default_size: int = 1, n_slots: int | None = None,
                     seed: int = 42) -> DataFrame:
    """G4 / G4t / G4e: ``(id, label, size, payload)``; ids are the 0-based
    partition index; the label is the slot ``pmod(id, n_slots)`` (a stand-in
    for the executor that builds it; P2 reports the real one afterwards)."""
    n_slots = n_slots or max(len(sizes), 1)
    base = spark.range(0, num_partitions, 1, num_partitions).select(F.col("id").cast("int").alias("id"))
    return sized_by_slot(base, "id", sizes, n_slots, default_size, seed, first=0)


def sized_by_slot(df: DataFrame, id_col: str, sizes: dict, n_slots: int, default_size: int = 1,
                  seed: int = 42, first: int = 1) -> DataFrame:
    """G4e / G4t on given ids: the label is the slot (executor or thread)
    ``pmod(id - first, n_slots)`` that the id is dealt to."""
    base = df.select(F.col(id_col).alias("id"),
                     F.pmod(F.col(id_col) - first, F.lit(n_slots)).cast("string").alias("label"))
    return sized_payloads_for(base, "id", "label", sizes, default_size, seed)


def _host_of_partition(batches):
    import socket

    import pyarrow as pa
    host = socket.gethostname()
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([host] * b.num_rows, pa.string())], ["id", "label"])


def sized_partitions_by_host(spark: SparkSession, num_partitions: int, sizes: dict,
                             default_size: int = 1, seed: int = 42) -> DataFrame:
    """G4h: the size follows the machine that builds the partition.

    The host is read inside the task (``mapInArrow``); a retry on another
    machine may change it, so persist the result before reuse.
    """
    base = spark.range(0, num_partitions, 1, num_partitions).select(F.col("id").cast("int").alias("id"))
    return sized_by_host(base, "id", sizes, default_size, seed)


def sized_by_host(df: DataFrame, id_col: str, sizes: dict, default_size: int = 1,
                  seed: int = 42) -> DataFrame:
    """G4h on given ids: the label is the machine that builds the row."""
    base = df.select(F.col(id_col).alias("id"))
    kind = base.schema["id"].dataType.simpleString()
    hosted = base.mapInArrow(_host_of_partition, f"id {kind}, label string")
    return sized_payloads_for(hosted, "id", "label", sizes, default_size, seed)


# ------------------------------------------------------------------ G5, G6


def keyed_records_for(df: DataFrame, id_col: str, num_keys: int, record_size: int,
                      seed: int = 42) -> DataFrame:
    """G5 on given ids: ``key`` uniform in [0, num_keys), ``payload`` of
    ``record_size`` random bytes; both keyed by (seed, id)."""
    key = F.floor(rng.uniform(seed, "key", F.col(id_col)) * F.lit(num_keys)).cast("int")
    return df.select(F.col(id_col).alias("id"), key.alias("key"),
                     rng.payload(seed, F.col(id_col), F.lit(record_size)).alias("payload"))


def keyed_records(spark: SparkSession, num_partitions: int, num_keys: int, num_records: int,
                  record_size: int, seed: int = 42) -> DataFrame:
    """``num_records`` rows ``(id, key, payload)`` in exactly
    ``num_partitions`` partitions; 64-bit ids, so no batching is needed."""
    base = spark.range(0, num_records, 1, num_partitions)
    return keyed_records_for(base, "id", num_keys, record_size, seed)


def union_batches(pieces: list[DataFrame]) -> DataFrame:
    """Bag union by column name (duplicates kept).

    Each union adds its pieces' partitions to one plan; thousands of pieces
    make the plan itself large (the original notes failures near 1024), so
    prefer one ``range`` with more rows over many small pieces.
    """
    if not pieces:
        raise ValueError("no pieces")
    return functools.reduce(DataFrame.unionByName, pieces)


# ------------------------------------------------------------------ G7, G8


def process_column(spec, seed, tag: str, *ids: Column, strict: bool = False) -> Column:
    """One sample of a random process as a Column.

    Specs (fixed values: the letters and arities of the original tool):
      ``()``                   constant 1.0
      ``("c", rate)``          constant 1/rate
      ``("x", rate)``          exponential, -ln(U)/rate
      ``("e", k, rate)``       Erlang-k, -(ln U1 + ... + ln Uk)/rate (rate per phase)
      ``("w", shape[, scale])`` Weibull, scale * (-ln U)^(1/shape);
                               default scale 1/Gamma(1 + 1/shape) (mean 1)
    Anything else warns and gives 1.0 (``strict=True`` raises).
    """
    spec = tuple(spec or ())
    if len(spec) == 0:
        return F.lit(1.0)
    kind = str(spec[0])
    if kind == "c" and len(spec) == 2:
        return F.lit(1.0 / float(spec[1]))
    if kind == "x" and len(spec) == 2:
        return -F.ln(rng.uniform(seed, tag, *ids)) / F.lit(float(spec[1]))
    if kind == "e" and len(spec) == 3:
        k, rate = int(spec[1]), float(spec[2])
        logs = [F.ln(rng.uniform(seed, f"{tag}.{j}", *ids)) for j in range(1, k + 1)]
        return -functools.reduce(lambda a, b: a + b, logs) / F.lit(rate)
    if kind == "w" and len(spec) in (2, 3):
        shape = float(spec[1])
        scale = float(spec[2]) if len(spec) == 3 else 1.0 / math.gamma(1.0 + 1.0 / shape)
        return F.lit(scale) * F.pow(-F.ln(rng.uniform(seed, tag, *ids)), F.lit(1.0 / shape))
    msg = f"unrecognized random process spec {spec!r}; using constant 1.0"
    if strict:
        raise ValueError(msg)
    warnings.warn(msg, stacklevel=2)
    return F.lit(1.0)


def process_mean(spec) -> float:
    """Theoretical mean of a process spec (for checks)."""
    spec = tuple(spec or ())
    if not spec:
        return 1.0
    kind = spec[0]
    if kind in ("c", "x"):
        return 1.0 / float(spec[1])
    if kind == "e":
        return int(spec[1]) / float(spec[2])
    if kind == "w":
        shape = float(spec[1])
        scale = float(spec[2]) if len(spec) == 3 else 1.0 / math.gamma(1.0 + 1.0 / shape)
        return scale * math.gamma(1.0 + 1.0 / shape)
    return 1.0


def job_tasks_for(jobs: DataFrame, job_col: str, tasks_per_job: int | Column,
                  service_spec, seed: int = 42) -> DataFrame:
    """Per job, ``tasks_per_job`` tasks with a drawn service time.

    ``(job, task, service)``; tasks 1..k come from ``explode(sequence)``
    (no cross join) and every draw is keyed by (job, task), so no two
    tasks share a random stream.
    """
    k = tasks_per_job if isinstance(tasks_per_job, Column) else F.lit(int(tasks_per_job))
    t = jobs.select(F.col(job_col).alias("job"),
                    F.explode(F.sequence(F.lit(1), k)).alias("task"))
    return t.withColumn("service", process_column(service_spec, seed, "service",
                                                  F.col("job"), F.col("task")))


def job_tasks(spark: SparkSession, num_jobs: int, tasks_per_job: int, service_spec,
              seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    """G8 range form: jobs 1..num_jobs."""
    jobs = spark.range(1, num_jobs + 1, 1, num_partitions or spark.sparkContext.defaultParallelism)
    return job_tasks_for(jobs, "id", tasks_per_job, service_spec, seed)


# ------------------------------------------------------------------ G9


def square_points_for(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """One random point of the 2x2 square at the origin per id."""
    x = F.lit(2.0) * rng.uniform(seed, "px", F.col(id_col)) - F.lit(1.0)
    y = F.lit(2.0) * rng.uniform(seed, "py", F.col(id_col)) - F.lit(1.0)
    return df.select(F.col(id_col).alias("id"), x.alias("x"), y.alias("y"))


def square_points(spark: SparkSession, n: int, num_partitions: int, seed: int = 42) -> DataFrame:
    return square_points_for(spark.range(0, n, 1, num_partitions), "id", seed)


def pi_estimate(points: DataFrame) -> DataFrame:
    """4 * share of points inside the unit circle; one partial aggregate."""
    inside = F.when(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1.0, 1).otherwise(0)
    return points.agg(F.count(F.lit(1)).alias("n"), F.sum(inside).alias("inside")).select(
        "n", "inside", (F.lit(4.0) * F.col("inside") / F.col("n")).alias("pi_estimate"))
