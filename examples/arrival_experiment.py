"""Arrival experiment as tables: jobs with exponential inter-arrival times,
tasks with exponential service times, and their departures when run one
job at a time (FIFO), fork-join (task i on worker i) or in barrier mode.

usage: python examples/arrival_experiment.py [jobs] [tasks per job] [arrival rate] [service rate]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

n_jobs = int(sys.argv[1]) if len(sys.argv) > 1 else 100
tasks = int(sys.argv[2]) if len(sys.argv) > 2 else 6
arrival_rate = float(sys.argv[3]) if len(sys.argv) > 3 else 0.5
service_rate = float(sys.argv[4]) if len(sys.argv) > 4 else 1.0

spark = SparkSession.builder.appName("arrival-experiment").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

from tasklens.operators import queueing as Q  # noqa: E402
from tasklens.sources import generators as G  # noqa: E402

jobs = spark.range(1, n_jobs + 1).select(F.lit(0).alias("q"), F.col("id").alias("job"),
                                         G.process_column(("x", arrival_rate), 42, "ia", F.col("id")).alias("ia"))
jobs = Q.arrival_schedule(jobs, ["q"], ["job"], "ia", method="window")
task_rows = (G.job_tasks_for(jobs, "job", tasks, ("x", service_rate))
             .join(jobs.select("job", "q", "arrival"), "job"))
fork_join = Q.forkjoin_departures(task_rows, ["q"], "job", "task", ["arrival", "job"])
barrier = Q.barrier_departures(task_rows, ["q"], "job", ["arrival", "job"])
summary = lambda df, name: df.agg(F.lit(name).alias("mode"), F.avg("sojourn").alias("mean_sojourn"),
                                  F.expr("percentile(sojourn, 0.95)").alias("p95_sojourn"))
summary(fork_join, "fork-join").unionByName(summary(barrier, "barrier")).show()
spark.stop()
