"""Where partitions live and where their tasks ran.

The original asks the block-manager master over RPC at run time. Here the
same facts come from the event log: with
``spark.eventLog.logBlockUpdates.enabled=true`` every cache write or drop
is a ``SparkListenerBlockUpdated`` line, so placement is a table that can
be joined with the task table, for one run or thousands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from ..sources import eventlog as ev

#: Rows of a block of the as-of join.
BLOCK_ROWS = 1_000_000


def storage_description(disk: Column, mem: Column, off_heap: Column, deser: Column,
                        replicas: Column) -> Column:
    """Spark's storage-level description text, e.g.
    ``"Disk Memory Deserialized 1x Replicated"``."""
    return F.concat(
        F.when(disk, F.lit("Disk ")).otherwise(F.lit("")),
        F.when(mem & off_heap, F.lit("Memory (off heap) ")).when(mem, F.lit("Memory ")).otherwise(F.lit("")),
        F.when(deser, F.lit("Deserialized ")).otherwise(F.lit("Serialized ")),
        replicas.cast("string"), F.lit("x Replicated"))


def block_locations(lines: DataFrame, live_only: bool = True) -> DataFrame:
    """The last known state of every cached block on every executor.

    ``(app, rdd_id, part_id, exec_id, host, memsize, disksize,
    storage_level, storage_flags, replicas)``; blocks whose last update has
    no storage (dropped) are left out; ``live_only`` also leaves out RDDs
    that were unpersisted. ``storage_flags`` = 8·disk + 4·memory +
    2·off-heap + 1·deserialized.
    """
    bu = ev.block_update_events(lines).where(F.col("block_id").startswith("rdd_"))
    last = (bu.groupBy("log", "block_id", "exec_id")
            .agg(F.max_by(F.struct("host", "memsize", "disksize", "use_disk", "use_memory",
                                   "use_off_heap", "deserialized", "replicas"), "seq").alias("b")))
    b = lambda n: F.col(f"b.{n}")
    valid = b("use_disk") | b("use_memory") | b("use_off_heap")
    out = last.where(valid).select(
        F.col("log").alias("app"),
        F.regexp_extract("block_id", r"^rdd_(\d+)_(\d+)$", 1).cast("int").alias("rdd_id"),
        F.regexp_extract("block_id", r"^rdd_(\d+)_(\d+)$", 2).cast("int").alias("part_id"),
        "exec_id", b("host").alias("host"), b("memsize").alias("memsize"),
        b("disksize").alias("disksize"),
        storage_description(b("use_disk"), b("use_memory"), b("use_off_heap"),
                            b("deserialized"), b("replicas")).alias("storage_level"),
        (b("use_disk").cast("int") * 8 + b("use_memory").cast("int") * 4
         + b("use_off_heap").cast("int") * 2 + b("deserialized").cast("int")).alias("storage_flags"),
        b("replicas").alias("replicas"))
    if live_only:
        gone = ev.unpersist_events(lines).select(F.col("log").alias("app"), "rdd_id").distinct()
        out = out.join(gone, ["app", "rdd_id"], "left_anti")
    return out


def stage_cached_rdds(lines: DataFrame) -> DataFrame:
    """``(app, stage_id, rdd_id)``: the persisted RDDs a stage reads
    (RDD Info entries with a disk or memory storage level)."""
    st = ev.stage_events(lines, rdd_info=True).select(
        F.col("log").alias("app"), "stage_id", F.explode("rdd_info").alias("r"))
    lvl = F.col("r.`Storage Level`")
    return (st.where(F.coalesce(lvl["Use Disk"], F.lit(False)) | F.coalesce(lvl["Use Memory"], F.lit(False)))
            .select("app", "stage_id", F.col("r.`RDD ID`").alias("rdd_id")).distinct())


def placement(lines: DataFrame, live_only: bool = False) -> DataFrame:
    """P2 / P2h: per task, the executor that ran it and where its partition
    is stored: ``(app, stage_id, task_id, part_id, exec_executor,
    storage_executor, memsize, disksize)``; one row per storage location,
    NULL storage when the partition is not cached (left joins)."""
    tasks = ev.task_end_events(lines, ["stage_id", "task_id", "partition_id", "executor_id"]).select(
        F.col("log").alias("app"), "stage_id", "task_id",
        F.col("partition_id").alias("part_id"), F.col("executor_id").alias("exec_executor"))
    linked = tasks.join(stage_cached_rdds(lines), ["app", "stage_id"], "left")
    loc = block_locations(lines, live_only).select(
        "app", "rdd_id", "part_id", F.col("exec_id").alias("storage_executor"), "memsize", "disksize")
    cols = ["app", "stage_id", "task_id", "part_id", "rdd_id", "exec_executor", "storage_executor",
            "memsize", "disksize"]
    # tasks of stages without a cached RDD have no key; a NULL key would hash
    # all of them into one shuffle partition, so they get distinct negative
    # keys that match nothing (RDD ids are >= 0) and spread over partitions
    salted = F.coalesce(F.col("rdd_id"), -1 - F.pmod(F.col("task_id"), F.lit(1 << 20)).cast("int"))
    left = linked.withColumn("_tl_rdd", salted)
    right = loc.withColumnRenamed("rdd_id", "_tl_rdd")
    return left.join(right, ["app", "_tl_rdd", "part_id"], "left").select(*cols)


def last_as_of(updates: DataFrame, probes: DataFrame, keys: list[str], seq: str, state: list[str],
               block: Column | None = None, block_rows: int = BLOCK_ROWS, each: str | None = None,
               held: str | None = None, since: str | None = None) -> DataFrame:
    """As-of join: ``probes`` with the ``state`` columns of the last update of
    their key that comes before them by ``seq`` (NULL if none does).

    Updates and probes are one table, sorted by ``seq``, and the last state is
    carried over the probes. A key is cut into blocks of ``seq`` (``block``, a
    value that never falls along it; by default as many equal steps as give
    ``block_rows`` rows), so a hot key is as many windows as it has blocks; the
    last state of every block is carried over the few rows of the block table.
    The common table is written once below the session's checkpoint folder.

    With ``each``, a column of the updates, a key has a state for every value of it
    (every executor that reported a block): a probe becomes a row for each state in
    which the column ``held`` is true and that is not from before the probe's place
    ``since`` (NULL: any), and one with NULLs if there is none. Probes are not
    multiplied for it on their way: see ``_holders_as_of``.
    """
    if each is not None:
        return _holders_as_of(updates, probes, keys, seq, state, each, held, since, block_rows)
    names = [c for c in probes.columns if c not in (*keys, seq)]
    u = updates.select(*keys, seq, F.struct(*state).alias("_tl_s"),
                       *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in names],
                       F.lit(False).alias("_tl_probe"))
    p = probes.select(*keys, seq, F.lit(None).cast(u.schema["_tl_s"].dataType).alias("_tl_s"), *names,
                      F.lit(True).alias("_tl_probe"))
    rows = written(u.unionByName(p))        # the lines are parsed and joined once
    if block is None:
        n, least, most = rows.agg(F.count(F.lit(1)), F.min(seq), F.max(seq)).first()
        step = max(float(most - least) * block_rows / n, 1.0) if n and most is not None else 1.0
        block = F.floor((F.col(seq) - F.lit(least)).cast("double") / step)
    rows = rows.withColumn("_tl_b", block)
    # of equal places, probes come first: an update counts only for what follows it
    w = Window.partitionBy(*keys, "_tl_b").orderBy(F.col(seq), F.col("_tl_probe").desc())
    inside = F.last("_tl_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.where("NOT _tl_probe").groupBy(*keys, "_tl_b").agg(F.max_by("_tl_s", seq).alias("_tl_s"))
    # the state at a block's begin: the last of the blocks before it
    order = Window.partitionBy(*keys).orderBy("_tl_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = (rows.where("_tl_probe").select(*keys, "_tl_b").distinct()
              .join(ends, [*keys, "_tl_b"], "full")
              .select(*keys, "_tl_b", F.last("_tl_s", ignorenulls=True).over(order).alias("_tl_before")))
    out = rows.withColumn("_tl_s", inside).where("_tl_probe").join(begins, [*keys, "_tl_b"], "left")
    found = F.coalesce("_tl_s", "_tl_before")
    return out.select(*keys, seq, *names, *[found[c].alias(c) for c in state])


#: Rows of a group of ``_holders_as_of``, and probe-holder pairs looked up at once.
GROUP_ROWS, PAIRS = 200_000, 1 << 20


def _place(c: Column, wide: bool) -> list[Column]:
    """A place as two numbers of up to 18 digits below and the rest above; one that is
    a bigint is the lower number as it is."""
    if not wide:
        return [F.when(c.isNotNull(), F.lit(0).cast("bigint")), c.cast("bigint")]
    big = F.lit(10 ** 18)
    wide = c.cast("decimal(38,0)")
    low = (wide % big).cast("bigint")
    return [((wide - low) / big).cast("bigint"), low]


def _holders_as_of(updates: DataFrame, probes: DataFrame, keys: list[str], seq: str, state: list[str],
                   each: str, held: str, since: str, block_rows: int) -> DataFrame:
    """``last_as_of`` with a state for every value of ``each``.

    Both tables are read more than once: they should be written ones. Updates and
    probes meet in groups of some ``GROUP_ROWS`` rows: many keys of one
    block of ``seq``, which is cut into as many blocks as the longest key needs. The
    last states before a block come into it as updates with their own places."""
    names = [c for c in probes.columns if c not in (*keys, seq, since)]
    blank = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    u = updates.select(*keys, seq, each, *state, held, *blank(probes, [since, *names]), F.lit(1).alias("_tl_u"))
    p = probes.select(*keys, seq, *blank(updates, [each, *state, held]), since, *names, F.lit(0).alias("_tl_u"))
    sizes = u.select(*keys, seq).unionByName(p.select(*keys, seq)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(seq).alias("least"), F.max(seq).alias("most"))
    n, longest, least, most = sizes.agg(F.sum("n"), F.max("n"), F.min("least"), F.max("most")).first()
    blocks = -(-(longest or 1) // min(block_rows, GROUP_ROWS))
    step = max(float((most or 0) - (least or 0)) / blocks, 1.0)
    block = F.least(F.floor((F.col(seq) - F.lit(least)).cast("double") / step), F.lit(blocks - 1))
    u, p = u.withColumn("_tl_b", block), p.withColumn("_tl_b", block)
    rows = u.unionByName(p)
    if blocks > 1:
        ends = u.groupBy(*keys, each, "_tl_b").agg(F.max_by(F.struct(seq, *state, held), seq).alias("_tl_e"))
        after = F.lead("_tl_b").over(Window.partitionBy(*keys, each).orderBy("_tl_b"))
        asked = p.select(*keys, F.col("_tl_b").alias("_tl_at")).distinct()
        # the state at a block's begin is the last end before it
        begins = (ends.withColumn("_tl_next", after).join(asked, keys)
                  .where((F.col("_tl_at") > F.col("_tl_b")) & (F.col("_tl_at") <= F.coalesce("_tl_next", "_tl_at"))))
        rows = rows.unionByName(begins.select(
            *keys, each, *[F.col(f"_tl_e.{c}").alias(c) for c in (seq, *state, held)],
            *blank(probes, [since, *names]), F.lit(1).alias("_tl_u"), F.col("_tl_at").alias("_tl_b")))
    groups = max(-(-(n or 1) // (GROUP_ROWS * blocks)), 1)
    wide = any(not isinstance(rows.schema[c].dataType, T.IntegralType) for c in (seq, since))
    rows = rows.withColumns(dict(zip(["_tl_hi", "_tl_lo"], _place(F.col(seq), wide), strict=True)))
    rows = rows.withColumns(dict(zip(["_tl_shi", "_tl_slo"], _place(F.col(since), wide), strict=True))).drop(since)
    out = [*keys, seq, *names, each, *state]
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in out])

    def find(t: pa.Table) -> pa.Table:
        return _held_rows(t, keys, [*keys, seq, *names], each, state, held).cast(to_arrow(schema))

    from pyspark.sql.pandas.types import to_arrow_schema as to_arrow
    return (rows.groupBy(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_tl_g"), "_tl_b")
            .applyInArrow(find, schema))


def _codes(*columns) -> np.ndarray:
    """Numbers that tell the rows of the columns apart."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        one = c if isinstance(c, np.ndarray) else pc.dictionary_encode(
            c, null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1]
    return out


def _held_rows(t: pa.Table, keys: list[str], own: list[str], each: str, state: list[str], held: str) -> pa.Table:
    """The probes of a group, each with the states held at its place."""
    number = lambda c, null: pc.fill_null(t[c], null).to_numpy()
    update = t["_tl_u"].to_numpy()
    hi, lo = number("_tl_hi", 0), number("_tl_lo", 0)
    first = np.iinfo(np.int64).min
    since_hi, since_lo = number("_tl_shi", first), number("_tl_slo", first)
    alive = pc.fill_null(t[held], False).to_numpy()
    rank = np.empty(len(update), np.int64)          # of equal places, probes come first
    rank[np.lexsort((update, lo, hi))] = np.arange(len(update))
    key = _codes(*[t[c] for c in keys])
    ups, probes = np.flatnonzero(update == 1), np.flatnonzero(update == 0)
    pair = _codes(key[ups], t[each].take(pa.array(ups)))        # ordered by key, then holder
    order = np.lexsort((rank[ups], pair))
    ups, pair = ups[order], pair[order]
    line = pair * len(update) + rank[ups]
    pair_key = key[ups[np.unique(pair, return_index=True)[1]]]
    start, stop = (np.searchsorted(pair_key, key[probes], side) for side in ("left", "right"))
    many = stop - start
    left, right = [], []
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // PAIRS, prepend=0))
    for some in np.split(np.arange(len(probes)), cuts):
        who = np.repeat(some, many[some])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
        p, row = start[who] + nth, probes[who]
        at = np.searchsorted(line, p * len(update) + rank[row]) - 1
        fits = at >= 0
        fits[fits] = pair[at[fits]] == p[fits]
        at = np.where(fits, at, 0)
        found = ups[at] if len(ups) else at
        later = (hi[found] > since_hi[row]) | ((hi[found] == since_hi[row]) & (lo[found] >= since_lo[row]))
        good = fits & later & alive[found]
        none = np.setdiff1d(some, who[good])
        left += [row[good], probes[none]]
        right += [found[good], np.full(len(none), -1)]
    left, right = (np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int64) for x in (left, right))
    states = t.select([each, *state]).take(pa.array(right, mask=right < 0))
    mine = t.select(own).take(pa.array(left))
    return pa.table({**{c: mine[c] for c in own}, **{c: states[c] for c in (each, *state)}})


def placement_as_of(lines: DataFrame, at: str = "task", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """P2 at run time: where a task's partition was stored when the task was
    launched (``at="task"``: its TaskStart line) or when its stage was submitted
    (``at="stage"``: what a driver sees that asks before the job runs), not where
    it was at the end of the log. The columns of ``placement``.

    Blocks that were dropped, moved to another executor, or belonged to an RDD
    that was unpersisted before that line, are not there; later changes do not
    count. One row for each executor that held the partition then, and one with
    NULLs for a task whose partition nobody held. A task without the line in
    question counts from its stage's."""
    if at not in ("task", "stage"):
        raise ValueError("at must be 'task' or 'stage'")
    begun = ev.placed_events(lines)
    tasks = (ev.task_end_events(lines, ["stage_id", "stage_attempt", "task_id", "partition_id", "executor_id"])
             .withColumnRenamed("log", "app"))
    st = (begun.where("kind = 'stage'").groupBy(F.col("log").alias("app"), "stage_id", F.col("attempt").alias("stage_attempt"))
          .agg(F.min("seq").alias("_tl_stage"), F.first("rdds").alias("rdds")))
    probes = tasks.join(st, ["app", "stage_id", "stage_attempt"], "left")
    place = F.col("_tl_stage")
    if at == "task":
        own = begun.where("kind = 'task'").groupBy(F.col("log").alias("app"), "task_id", F.col("stage_id"),
                                                  F.col("attempt").alias("stage_attempt")).agg(F.min("seq").alias("_tl_task"))
        probes = probes.join(own, ["app", "stage_id", "stage_attempt", "task_id"], "left")
        place = F.coalesce("_tl_task", "_tl_stage")
    probes = probes.select("app", "stage_id", "task_id", F.col("partition_id").alias("part_id"),
                           F.explode_outer("rdds").alias("rdd_id"), F.col("executor_id").alias("exec_executor"),
                           place.alias("seq"))

    # the text of an RDD's block is matched once for its two numbers
    blocks = ev.block_update_events(lines, ["block_id", "exec_id", "memsize", "disksize",
                                            "use_disk", "use_memory", "use_off_heap"])
    numbers = F.split(F.regexp_extract("block_id", r"^rdd_(\d+_\d+)$", 1), "_")
    updates = blocks.withColumn("_tl_n", numbers).where(F.size("_tl_n") == 2).select(
        F.col("log").alias("app"), F.col("_tl_n")[0].cast("int").alias("rdd_id"),
        F.col("_tl_n")[1].cast("int").alias("part_id"),
        F.col("exec_id").alias("storage_executor"), "seq", "memsize", "disksize",
        (F.col("use_disk") | F.col("use_memory") | F.col("use_off_heap")).alias("held"))
    key = ["app", "rdd_id", "part_id"]
    updates = written(updates)
    # a few lines for each RDD
    gone = ev.unpersist_events(lines, seq=True).groupBy(F.col("log").alias("app"), "rdd_id").agg(
        F.collect_set("seq").alias("gone"))
    asked = F.col("rdd_id").isNotNull() & F.col("seq").isNotNull()
    last_gone = F.array_max(F.filter("gone", lambda g: g < F.col("seq")))
    # the tasks are parsed and joined once, for those that are looked up and the others
    probes = written(probes.join(gone, ["app", "rdd_id"], "left").withColumn("since", last_gone).drop("gone"))
    known = last_as_of(updates, probes.where(asked), key, "seq", ["memsize", "disksize"],
                       block_rows=block_rows, each="storage_executor", held="held", since="since")
    columns = ["app", "stage_id", "task_id", "part_id", "rdd_id", "exec_executor", "storage_executor", "memsize", "disksize"]
    return known.select(*columns).unionByName(probes.where(~asked).select(*columns[:6]), allowMissingColumns=True)


def executor_partitions(locations: DataFrame, by: str = "exec_id", page_size: int = 4096) -> DataFrame:
    """A3: per (app, executor, rdd) the sorted partition ids it holds, in
    pages of ``page_size`` ids (``page`` = part_id div page_size), so that no
    row grows with the number of partitions."""
    paged = locations.withColumn("page", F.floor(F.col("part_id") / F.lit(int(page_size))).cast("bigint"))
    return (paged.groupBy("app", by, "rdd_id", "page")
            .agg(F.count(F.lit(1)).alias("n_parts"),
                 F.sort_array(F.collect_list("part_id")).alias("part_ids")))


def executor_partition_bitmaps(locations: DataFrame, by: str = "exec_id") -> DataFrame:
    """A3 as bitmaps: ``(app, executor, rdd_id, bucket, bitmap)``, a bit for each
    of the 32768 partition ids of a bucket.

    Every map task sends 4 KiB for a bucket at most, however many ids it saw, and
    partial bitmaps are or-ed: nothing is collected or sorted. Ids are counted
    from 1 in the bitmap functions, so that id 0 shares a bucket with its
    neighbours."""
    at = F.col("part_id").cast("bigint") + 1
    return (locations.groupBy("app", by, "rdd_id", F.bitmap_bucket_number(at).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")))


def merged_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of several tables (days, logs) or of fewer keys, or-ed by ``keys``
    and bucket."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_pages(bitmaps: DataFrame, page_size: int = 4096) -> DataFrame:
    """The ids of bitmaps, in pages of ``page_size`` ids (a multiple of 8 that
    divides 32768): ``(..., page, n_parts, part_ids)``, as ``executor_partitions``
    gives them. Only bytes with a bit set are looked at twice."""
    if page_size % 8 or 32768 % page_size:
        raise ValueError("page_size must be a multiple of 8 that divides 32768")
    width, pages = page_size // 8, 32768 // page_size
    keys = [c for c in bitmaps.columns if c not in ("bucket", "bitmap")]
    cut = bitmaps.select(*keys, "bucket", "bitmap", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("slice")).select(
        *keys, ((F.col("bucket") - 1) * pages + F.col("slice")).cast("bigint").alias("page"),
        F.substring("bitmap", F.col("slice") * width + 1, F.lit(width)).alias("bits"))
    zero = F.lit(bytearray(1))
    full = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.substring("bits", i + 1, F.lit(1)) != zero)

    def ids(i):
        value = F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int")
        first = F.col("page").cast("bigint") * page_size + i * 8
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(value, b) == 1),
                           lambda b: (first + b).cast("int"))
    out = cut.withColumn("part_ids", F.flatten(F.transform(full, ids)))
    return out.where(F.size("part_ids") > 0).select(
        *keys, "page", F.size("part_ids").cast("bigint").alias("n_parts"), "part_ids")


def report_by_executor(placed: DataFrame) -> DataFrame:
    """A4: runner rows grouped by the executor that ran them: task count,
    tasks whose partition was stored on the same executor, byte sums."""
    same = (F.col("exec_executor") == F.col("storage_executor")).cast("int")
    return (placed.groupBy("app", "exec_executor")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("task_id").alias("n_tasks"),
                 F.sum(F.coalesce(same, F.lit(0))).alias("n_local"),
                 F.sum("memsize").alias("mem_bytes"), F.sum("disksize").alias("disk_bytes")))


def _host_rows(batches):
    import socket

    import pyarrow as pa
    host = socket.gethostname()
    for b in batches:
        yield b.append_column("host", pa.array([host] * b.num_rows, pa.string()))


def partition_profile(df: DataFrame, key: str | None = None, payload: str | None = None,
                      with_host: bool = False, part: Column | None = None) -> DataFrame:
    """Per partition of ``df``: rows, payload bytes, min/max key (and
    the host that computed it). A skew report; one partial aggregate.
    ``part``: a partition column of the table instead of Spark's own."""
    base = df.withColumn("part", F.spark_partition_id() if part is None else part)
    aggs = [F.count(F.lit(1)).alias("rows")]
    if payload:
        aggs.append(F.sum(F.length(payload)).alias("bytes"))
    if key:
        aggs += [F.min(key).alias("min_key"), F.max(key).alias("max_key")]
    if with_host:
        cols = ["part"] + ([payload] if payload else []) + ([key] if key else [])
        schema = base.select(*cols).schema.add("host", "string")
        base = base.select(*cols).mapInArrow(_host_rows, schema)
        return base.groupBy("part").agg(*aggs, F.first("host").alias("host"))
    return base.groupBy("part").agg(*aggs)
