"""Skew demo: one queue / one key holds a third of all rows.

Times the one-window plans against the blocked / range-partitioned plans on
the same input and checks that they agree. Input: ``events`` (queue =
user_id, with every event whose xxhash64(event_id) % 3 == 0 moved to queue
-1) and ``lineitem`` (key = l_orderkey, a third of rows moved to key -1).

usage: python scripts/skew_demo.py [sf_dir]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tasklens.operators import queueing as Q  # noqa: E402
from tasklens.plans import ranking  # noqa: E402
from tasklens.session import ensure_checkpoint_dir, local_session  # noqa: E402
from tasklens.sources.eventlog import epoch_us  # noqa: E402


def timed(df):
    t0 = time.perf_counter()
    rows = df.collect()
    return round(time.perf_counter() - t0, 2), rows


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16)
    ensure_checkpoint_dir(spark)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    hot = F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("user_id"))
    jobs = ev.select(hot.alias("q"), "event_id", epoch_us(F.col("ts")).alias("arrival"),
                     F.round(F.col("value") * 1000.0).cast("bigint").alias("service"))
    out = {"rows": jobs.count(), "largest_queue": jobs.groupBy("q").count().agg(F.max("count")).first()[0]}
    summary = lambda d: d.agg(F.sum("sojourn").alias("s"), F.max("waiting").alias("w"))
    for method in ("window", "blocked"):
        timed(summary(Q.fifo_departures(jobs, ["q"], ["arrival", "event_id"], method=method)))  # warm-up
        t, r = timed(summary(Q.fifo_departures(jobs, ["q"], ["arrival", "event_id"], method=method)))
        out[f"fifo_{method}_sec"] = t
        out[f"fifo_{method}_check"] = [r[0].s, r[0].w]
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.when(F.pmod(F.xxhash64("l_partkey", "l_suppkey"), F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("l_orderkey"))
    li = li.withColumn("k", key)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate"]
    plain = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    for name, r in (("window", li.withColumn("pos", plain)), ("ranges", ranking.rank_within(li, ["k"], order))):
        t, rows = timed(r.agg(F.sum(F.col("pos") * F.col("l_partkey")).alias("s"), F.max("pos").alias("m")))
        out[f"rank_{name}_sec"] = t
        out[f"rank_{name}_check"] = [rows[0].s, rows[0].m]
    print(json.dumps(out))


if __name__ == "__main__":
    main()
