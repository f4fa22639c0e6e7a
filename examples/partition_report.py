"""Partition placement report: cached partitions, workloads chosen per slot,
and where every partition was stored and run, read from the session's own
event log.

usage: python examples/partition_report.py [event-log dir] [partitions] [bytes per partition]
"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

log_dir = sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="events-")
n_parts = int(sys.argv[2]) if len(sys.argv) > 2 else 10
size = int(sys.argv[3]) if len(sys.argv) > 3 else 1

spark = (SparkSession.builder.appName("partition-report")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
         .config("spark.eventLog.logBlockUpdates.enabled", "true").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

from tasklens.operators import modes as E  # noqa: E402
from tasklens.operators import placement as P  # noqa: E402
from tasklens.operators import workloads as W  # noqa: E402
from tasklens.sources import eventlog as ev  # noqa: E402
from tasklens.sources import generators as G  # noqa: E402

# n partitions of `size` zero bytes, cached on disk and materialised
data = G.zero_partitions(spark, n_parts, size).withColumn("slot", F.pmod("id", F.lit(3)).cast("string"))
with E.Persisted(data, StorageLevel.DISK_ONLY) as cached:
    cached.fill()
    by_slot = {"0": lambda c: W.scramble_head(c, 42, F.col("id"), 64).cast("bigint"),
               "1": lambda c: W.byte_max(c).cast("bigint"),
               "2": lambda c: W.random_element(c, 42, F.col("id")).cast("bigint")}
    ran = W.apply_workload_by(cached.df, "slot", by_slot, lambda c: F.length(c).cast("bigint"))
    ran.write.format("noop").mode("overwrite").save()

    lines = ev.current_app_log(spark)
    placed = P.placement(lines).where(F.col("rdd_id").isNotNull())
    P.report_by_executor(placed).show(truncate=False)
    P.executor_partitions(P.block_locations(lines)).show(truncate=False)
spark.stop()
