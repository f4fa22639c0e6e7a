"""Row numbers without a single-task window.

``Window.orderBy(...)`` with no partition puts every row in one task, and
``Window.partitionBy(key)`` puts a hot key in one task. ``rank_within`` deals
the rows of frequent keys to ranges by a sample sort, whose splitters are whole
keys and order columns, ranks inside each range and adds the sizes of the ranges
before it; ``global_row_number`` does so with all rows. Each has one plan for
every size of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition << 33) + index


def _num_parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def global_row_number(df: DataFrame, order: list[str | Column], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (ORDER BY order...)`` (1-based, BIGINT), distributed.

    ``order`` should be a total order (a full tie-break); rows equal on all
    of it get consecutive numbers in an arbitrary order. The sorted rows are
    written once to the session's checkpoint folder, so that the counts of
    the range partitions and the rows themselves come from one sampling of
    the range bounds, also after an executor is lost.
    """
    n = _num_parts(df, num_partitions)
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = (sorted_df
              .withColumn("_tl_mid", F.monotonically_increasing_id())
              .withColumn("_tl_pid", F.shiftright(F.col("_tl_mid"), _LOCAL_BITS))
              .withColumn("_tl_loc", F.col("_tl_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    ensure_checkpoint_dir(df.sparkSession)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_tl_pid").agg(F.count(F.lit(1)).alias("_tl_cnt"))
    # at most n rows: one per range partition
    offsets = counts.select(
        "_tl_pid",
        F.coalesce(F.sum("_tl_cnt").over(
            Window.orderBy("_tl_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_tl_off"))
    return (tagged.join(F.broadcast(offsets), "_tl_pid")
            .withColumn(out, F.col("_tl_off") + F.col("_tl_loc") + 1)
            .drop("_tl_mid", "_tl_pid", "_tl_loc", "_tl_off"))


#: Rows of a key from which on its ranks are computed range by range, and rows
#: of such a range.
SPLIT_ROWS = 100_000


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the right keys are dropped."""
    names = {k: f"_tl_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{r}`")) for k, r in names.items()]
    if how in ("left_semi", "left_anti"):
        return left.join(right, cond, how)
    return left.join(right, cond, how).drop(*names.values())


def ranges_within(df: DataFrame, keys: list[str], order: list[str | Column], split_rows: int = SPLIT_ROWS,
                  splits: int = 1, part: str = "_tl_part",
                  range_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of frequent keys with the range ``part``).

    The rows of keys with over ``split_rows`` rows (0: of every key) are written
    once and dealt to ranges of about ``range_rows`` rows (default: as many; at
    least ``splits`` ranges) by ``repartitionByRange`` on the keys and all of the order:
    its splitters are sampled whole keys, so records that share a long prefix, or
    jobs of one hour, are split where they differ, and the number of ranges
    follows the rows. The ranges are written as well, so that all that is computed
    of them comes from one sampling. Only rows that are equal in all of the
    order stay together.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tl_n")).where(F.col("_tl_n") > int(split_rows))
    heavy = written(same_keys(df, hot.drop("_tl_n"), keys, "left_semi"))
    size = int(range_rows or split_rows) or SPLIT_ROWS
    rows = heavy.count()
    rest = same_keys(df, heavy.select(*keys).distinct(), keys, "left_anti")
    if not rows:                                       # nothing to deal out
        return rest, heavy.withColumn(part, F.lit(0))
    parts = max(int(splits), -(-rows // size), 1)
    return rest, written(heavy.repartitionByRange(parts, *keys, *order).withColumn(part, F.spark_partition_id()))


def rank_within(df: DataFrame, keys: list[str], order: list[str | Column],
                out: str = "pos", split_rows: int = SPLIT_ROWS, splits: int = 1) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` (1-based, BIGINT).

    Ordinary keys are one window each; the rows of frequent ones are ranked in
    the ranges of ``ranges_within``, and the sizes of the ranges before are added (a
    key has at most one row for each of its ranges in the table of sizes).
    """
    rest, ranged = ranges_within(df, keys, order, split_rows, splits)
    sizes = ranged.groupBy(*keys, "_tl_part").agg(F.count(F.lit(1)).alias("_tl_n"))
    before = Window.partitionBy(*keys).orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_tl_part", F.coalesce(F.sum("_tl_n").over(before), F.lit(0)).alias("_tl_off"))
    local = ranged.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_tl_part").orderBy(*order)))
    in_ranges = same_keys(local, offsets, [*keys, "_tl_part"]).withColumn(out, F.col(out) + F.col("_tl_off"))
    rest = rest.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return rest.unionByName(in_ranges.drop("_tl_part", "_tl_off"))
