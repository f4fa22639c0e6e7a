"""Session helpers: a local session for tests and benches, table loading, and
the shared checkpoint folder.

On a cluster the session is built by the caller; nothing here overrides
settings that are already present.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the session's Python workers import ``tasklens``.

    On a local master the folder holding the package is put on the
    ``PYTHONPATH`` that PySpark hands to every Python worker it starts (UDFs
    are pickled by reference to their module), whatever their working
    directory. On a cluster the package is zipped once per session and handed
    to the executors with ``addPyFile``.
    """
    import tasklens
    root = os.path.dirname(os.path.dirname(os.path.abspath(tasklens.__file__)))
    sc = spark.sparkContext
    if not (sc.master == "local" or sc.master.startswith("local[")):
        if sc.applicationId not in _SHIPPED:
            folder = tempfile.mkdtemp(prefix="tasklens-zip-")
            sc.addPyFile(shutil.make_archive(os.path.join(folder, "tasklens"), "zip", root, "tasklens"))
            _SHIPPED.add(sc.applicationId)
        return
    env = sc.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "tasklens") -> SparkSession:
    """Local session with AQE on and the UI off (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TASKLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's ``spark.checkpoint.dir``.

    On a cluster this names a shared folder and is read as is. Only when it
    is unset on a local master (tests) a fresh folder under the system temp
    dir is set; on a cluster that would be each machine's own disk, so an unset
    folder is an error there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tasklens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # a core setting some sessions refuse at run time
            pass
    spark.sparkContext.setCheckpointDir(current)
    return current


def written(df: DataFrame) -> DataFrame:
    """Write a table once below the session's checkpoint folder and read it
    back: like a checkpoint, compressed and by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tasklens/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it Spark deletes the shuffle files of a query when the query ends. For
    what is written or counted once: by default the files stay until the driver
    collects the plan as garbage, beside those of the queries that follow."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, by: list[str] | None = None,
           min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the
    session's default parallelism (e.g. one file with one big row group), so
    that heavy per-row work before the first shuffle uses every core.

    A no-op on large inputs, whose scans have at least that many splits.
    Rows go by a hash of ``by`` (a key; default all columns): deterministic
    on a retry and no map-side sort (a round-robin repartition sorts first).
    Hash only what is read anyway, or column pruning stops at the scan.
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    try:
        parts = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access: leave the plan as it is
        return df
    if parts < n:
        cols = by or df.columns
        return df.repartition(n, F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    return df
