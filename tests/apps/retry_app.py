"""Run a few operators with task failures injected into first attempts
(tasks are retried: master local[4,3]) and print their results as JSON.

usage: python retry_app.py <sf_dir> <inject: 0|1>
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

sf_dir, inject = sys.argv[1], sys.argv[2] == "1"
spark = (SparkSession.builder.master("local[4,3]").appName("retry")
         .config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false")
         .getOrCreate())
spark.sparkContext.setLogLevel("OFF")

from tasklens.operators import queueing as Q  # noqa: E402
from tasklens.operators import workloads as W  # noqa: E402
from tasklens.plans.ranking import global_row_number  # noqa: E402
from tasklens.sources import generators as G  # noqa: E402
from tasklens.sources.eventlog import epoch_us  # noqa: E402


@F.pandas_udf(T.BooleanType())
def flaky(s: pd.Series) -> pd.Series:
    """Fail the first attempt of every even partition (when injecting)."""
    ctx = TaskContext.get()
    if inject and ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
        marks = os.environ.get("RETRY_MARKS")
        if marks:   # one marker file per injected failure
            open(os.path.join(marks, f"{ctx.stageId()}-{ctx.partitionId()}-{os.getpid()}-{id(s)}"), "w").close()
        raise RuntimeError("injected task failure")
    return pd.Series([True] * len(s))


out = {}
orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(4, "o_orderkey")
k = G.keyed_records_for(orders.where(flaky("o_orderkey")), "o_orderkey", 7, 8)
out["keyed"] = sorted((r.id, r.key, r.payload.hex()) for r in k.collect())

li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate")
order = li.columns
n = global_row_number(li.where(flaky("l_orderkey")), order, "rn")
n = n.where(flaky("rn"))                       # fail again after the numbering
out["rownum"] = sorted((r.rn, r.l_orderkey, r.l_partkey, r.l_suppkey) for r in n.collect())

ev = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4, "event_id")
jobs = ev.where(flaky("event_id")).select(
    "user_id", "event_id", epoch_us(F.col("ts")).alias("arrival"),
    F.round(F.col("value") * 300.0 * 1000000.0).cast("bigint").alias("service"))
fifo = Q.fifo_departures(jobs, ["user_id"], ["arrival", "event_id"], block=F.floor(F.col("arrival") / F.lit(600_000_000)))
out["fifo"] = sorted((r.event_id, r.departure) for r in fifo.where(flaky("event_id")).collect())

docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4, "doc_id")
w3 = docs.where(flaky("doc_id")).select("doc_id", W.pair_sign_sum(F.encode("text", "UTF-8")).alias("s"))
out["w3"] = sorted((r.doc_id, r.s) for r in w3.collect())

print("RESULT " + json.dumps(out))
spark.stop()
