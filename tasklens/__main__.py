"""Command line: tables from Spark event logs.

    python -m tasklens index-stats <logs...> [--stage-index K] [--out PATH]
    python -m tasklens tasks <logs...> [--stage-index K] [--out PATH]
    python -m tasklens placement <logs...> [--out PATH]

``<logs>`` are files, folders or globs (rolled ``eventlog_v2_*`` folders
included). Without ``--out`` the first rows are printed; with it the whole
table is written as Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import metrics as M
from .operators import placement as P
from .sources import eventlog as ev


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m tasklens", description=__doc__.split("\n\n")[0])
    ap.add_argument("table", choices=["index-stats", "tasks", "placement"])
    ap.add_argument("logs", nargs="+")
    ap.add_argument("--stage-index", type=int, default=None,
                    help="k-th stage of every log (1-based); default: all stages")
    ap.add_argument("--rolled", action="store_true", help="logs are rolled eventlog_v2_* folders")
    ap.add_argument("--out", default=None, help="write the table as Parquet here")
    ap.add_argument("--rows", type=int, default=50, help="rows to print without --out")
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName("tasklens").getOrCreate()
    lines = ev.read_event_log(spark, a.logs, rolled=a.rolled or None)
    if a.table == "index-stats":
        df = M.task_index_stats(lines, stage_index=a.stage_index).orderBy("taskIndex")
    elif a.table == "tasks":
        df = M.flat_tasks_full(lines, stage_index=a.stage_index)
    else:
        df = P.placement(lines)
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
