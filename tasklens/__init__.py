"""tasklens: partition workloads, queueing arithmetic and task-metric tables
as plain PySpark DataFrame operators.

Families (one module each):

* ``sources.generators``   seeded tables with exact partition counts, sizes,
                           keys and skew (G1-G9)
* ``sources.eventlog``     Spark event logs -> typed fact tables (S1)
* ``operators.metrics``    jobs / stages / tasks tables and per-index stats
* ``operators.workloads``  byte-array workloads over BINARY payloads
* ``operators.records``    keyed big-endian records: compare, max, sort
* ``operators.pairs``      pair sign sums (inversion counts) at any group size
* ``operators.queueing``   arrival schedules and FIFO / fork-join departures
* ``operators.placement``  block locations, task placement, partition profile
* ``operators.modes``      plain / staged / barrier / persisted execution
* ``streaming.eventlog_stream``  the metric tables kept current from a folder
"""

__version__ = "0.1.0"

from .operators.metrics import (  # noqa: E402,F401
    flat_tasks,
    flat_tasks_full,
    index_stats,
    jobs,
    job_stages,
    nth_stage,
    stages,
    task_index_stats,
)
from .operators.placement import block_locations, placement  # noqa: E402,F401
from .operators.queueing import (  # noqa: E402,F401
    arrival_schedule,
    barrier_departures,
    fifo_departures,
    forkjoin_departures,
)
from .sources.eventlog import materialize_event_log, read_event_log  # noqa: E402,F401
from .streaming.eventlog_stream import read_event_log_stream  # noqa: E402,F401
