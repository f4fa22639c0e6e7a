"""A session that reads its own event log while running: run a workload on
a persisted table, then report jobs, tasks and placement of this very app.

usage: python own_log_app.py <event log dir> <rolling: 0|1>
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

out, rolling = sys.argv[1], sys.argv[2] == "1"
spark = (SparkSession.builder.master("local[2]").appName("own-log")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", out)
         .config("spark.eventLog.rolling.enabled", str(rolling).lower())
         .config("spark.eventLog.logBlockUpdates.enabled", "true")
         .config("spark.ui.enabled", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

from tasklens.operators import metrics as M  # noqa: E402
from tasklens.operators import modes as E  # noqa: E402
from tasklens.operators import placement as P  # noqa: E402
from tasklens.operators import workloads as W  # noqa: E402
from tasklens.sources import eventlog as ev  # noqa: E402
from tasklens.sources import generators as G  # noqa: E402

payloads = G.zero_partitions(spark, 6, 1000)
with E.Persisted(payloads, StorageLevel.DISK_ONLY) as cached:
    cached.fill()
    cached.run(lambda c: W.byte_max(c)).write.format("noop").mode("overwrite").save()
    lines = ev.current_app_log(spark)
    res = {
        "jobs": M.jobs(lines).count(),
        "tasks": ev.task_end_events(lines, ["task_id"]).count(),
        "blocks": P.block_locations(lines).where(F.col("disksize") > 0).count(),
        "placed": P.placement(lines).where(F.col("storage_executor").isNotNull()).count(),
    }
print("RESULT " + json.dumps(res))
spark.stop()
