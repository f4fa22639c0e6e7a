"""Pair sign sums (W3 / J4) when a group's values are spread over rows.

Σ_{i<j} sign(v_i - v_j) within a group, ordered by position, is a
quadratic self-join if done naively, and one hot group would put n² pairs
in one task. Here the work is linear and split:

1. the values of an ordinary group (at most ``block_size`` rows) are one array,
   by a single shuffle on the group; an Arrow function sums whole batches of short
   arrays at once;
2. the rows of a larger group are dealt to ranges of its order
   (``plans.ranking.ranges_within``: whole order keys, about ``SPLIT_ROWS`` rows), and a
   range is cut into blocks of ``block_size`` consecutive rows; each block is one
   row (``collect_list`` bounded by ``block_size``) and an Arrow function returns its
   inner sign sum, its 256-bin value histogram h and
   D[u] = #{v in block: v < u} - #{v in block: v > u};
3. pairs across blocks: Σ_b Σ_u h_b[u] · Σ_{b' > b} D_b'[u], a suffix sum
   per (group, u) over the block table (n / block_size · 256 rows).

Values must be signed bytes (-128..127), the reference's element type.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytes_np
from ..plans.ranking import SPLIT_ROWS, ranges_within, same_keys

#: Values of the blocks that are summed up and handed back at once.
BATCH_VALUES, BATCH_BLOCKS = 1 << 18, 256


def _summaries(keys: list[T.StructField]) -> tuple[Callable, T.StructType]:
    """Function and schema of (keys..., inner, hist, d) of rows (keys..., whether a
    histogram is wanted, the block's values in order or its bytes). A part of
    a batch is in hand at a time, so memory does not follow the number of blocks."""
    names = [*[k.name for k in keys], "inner", "hist", "d"]
    longs = T.ArrayType(T.LongType())

    def lists(rows: list, at: list[int], n: int) -> pa.Array:
        size = np.zeros(n, np.int64)
        size[at] = 256
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat),
                                        mask=pa.array(size == 0))

    def run(batches):
        for whole in batches:
            column = whole.column(whole.num_columns - 1)
            start = 0
            while start < whole.num_rows:
                n = held = 0
                while n < BATCH_BLOCKS and start + n < whole.num_rows and (not n or held < BATCH_VALUES):
                    block = column[start + n]
                    held += len(block) if block.is_valid and pa.types.is_list(column.type) else len(block.as_buffer() or b"") if block.is_valid else 0
                    n += 1
                part = whole.slice(start, n)
                start += n
                inner, hists, ds, at = [], [], [], []
                for i, (want, block) in enumerate(zip(part.column(len(keys)).to_pylist(), part.column(len(keys) + 1), strict=True)):
                    a = _signed(block)
                    if want:
                        total, hist, d = bytes_np.block_summary(a)
                        hists.append(hist)
                        ds.append(d)
                        at.append(i)
                    else:
                        total = bytes_np.pair_sign_sum(a)
                    inner.append(total)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keys)], pa.array(inner, pa.int64()), lists(hists, at, n), lists(ds, at, n)],
                    names=names)

    more = [T.StructField("inner", T.LongType()), T.StructField("hist", longs), T.StructField("d", longs)]
    return run, T.StructType([*keys, *more])


def _signed(block: pa.Scalar) -> np.ndarray:
    """Signed bytes of a list of values or of a binary."""
    if not block.is_valid:
        return np.zeros(0, np.int8)
    if not isinstance(block, pa.ListScalar):
        return bytes_np.as_int8(block.as_py())
    val = block.values.to_numpy(zero_copy_only=False)
    if len(val) and (val.min() < -128 or val.max() > 127):
        raise ValueError("pair_sign_sum_rows expects signed byte values")
    return val.astype(np.int8)


def _summed_blocks(blocks: DataFrame, group: list[str], multi: Column, values: Column) -> DataFrame:
    """(group..., _tl_blk, _tl_multi, inner, hist, d) of block rows."""
    rows = blocks.select(*group, "_tl_blk", multi.alias("_tl_multi"), multi.alias("_tl_want"), values.alias("_tl_v"))
    run, schema = _summaries(rows.schema.fields[:-2])
    return rows.mapInArrow(run, schema)


def pair_sign_sum_rows(df: DataFrame, group: list[str], value: str | Column,
                       order: list[str], block_size: int = 4096) -> DataFrame:
    """``(group..., pair_sign_sum BIGINT)`` for every group of ``df``.

    Rows with a NULL value are left out. The block summaries of large groups (an
    Arrow function) are computed once and feed a single table of cells: per block one
    ``inner`` cell and its 256 value cells.
    """
    v = F.col(value) if isinstance(value, str) else value
    base = (df.select(*group, *[c for c in order if c not in group], v.cast("int").alias("_tl_v"))
            .where(F.col("_tl_v").isNotNull()))
    rest, ranged = ranges_within(base, group, list(order), split_rows=block_size, range_rows=SPLIT_ROWS)
    by_order = [F.col(c) for c in order if c not in group]
    row = F.struct(*by_order, F.col("_tl_v"))
    values = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_tl_v"])
    small = rest.groupBy(*group).agg(values.alias("_tl_v"))
    kinds = [T.StructField(g, small.schema[g].dataType) for g in group]
    out = small.mapInArrow(_short_sums, T.StructType([*kinds, T.StructField("pair_sign_sum", T.LongType())]))

    place = F.row_number().over(Window.partitionBy(*group, "_tl_part").orderBy(*order)) - 1
    block = F.shiftleft(F.col("_tl_part").cast("bigint"), 32) + F.floor(place / F.lit(block_size))
    blocks = (ranged.withColumn("_tl_pos", place).withColumn("_tl_blk", block)
              .groupBy(*group, "_tl_blk")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("_tl_pos").alias("pos"),
                                                        F.col("_tl_v").alias("v")))).alias("items")))
    summ = _summed_blocks(blocks, group, F.lit(True), F.transform("items", lambda x: x["v"]))
    return out.unionByName(_combine_blocks(summ, group))


def _short_sums(batches):
    """(group..., pair sign sum) of (group..., values in order)."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        sums = bytes_np.pair_sign_sums(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.int64())],
                                         names=[*b.schema.names[:-1], "pair_sign_sum"])


def _combine_blocks(summ: DataFrame, group: list[str]) -> DataFrame:
    """``(group..., _tl_blk, _tl_multi, inner, hist, d)`` block summaries -> sign sums.

    One table of cells: per block its ``inner`` sum, and for groups of
    several blocks its 256 value cells (h, D). Pairs across blocks are
    sum over u of h_b[u] * (sum of D_b'[u] over later blocks b'), a suffix
    window per (group, u) over blocks."""
    inner_cell = F.array(F.struct(F.lit(-1).alias("u"), F.col("inner").alias("h"),
                                  F.lit(0).cast("bigint").alias("d")))
    value_cells = F.transform(F.arrays_zip(F.col("hist").alias("h"), F.col("d")),
                              lambda x, i: F.struct(i.alias("u"), x["h"].alias("h"), x["d"].alias("d")))
    cells = summ.select(*group, "_tl_blk", F.explode(
        F.when(F.col("_tl_multi"), F.concat(inner_cell, value_cells)).otherwise(inner_cell)).alias("c"))
    # pairs across blocks: sum over u of h_b[u] * (sum of D_b'[u] over later blocks b')
    w = (Window.partitionBy(*group, "c.u").orderBy("_tl_blk")
         .rowsBetween(1, Window.unboundedFollowing))
    later = F.coalesce(F.sum("c.d").over(w), F.lit(0))
    part = F.when(F.col("c.u") < 0, F.col("c.h")).otherwise(F.col("c.h") * later)
    return (cells.select(*group, part.alias("_tl_part"))
            .groupBy(*group).agg(F.sum("_tl_part").alias("pair_sign_sum")))


def pair_sign_sum_chunked(df: DataFrame, keys: list[str], chunk: str = "chunk",
                          payload: str = "payload") -> DataFrame:
    """W3 for payloads stored as ordered chunk rows ``(keys..., chunk,
    payload)``: each chunk is a block; the result equals W3 over the
    concatenated payload, with no row ever holding more than one chunk."""
    blocks = df.select(*keys, F.col(chunk).alias("_tl_blk"), F.col(payload).alias("_tl_p"))
    several = blocks.groupBy(*keys).agg((F.max("_tl_blk") > F.min("_tl_blk")).alias("_tl_multi"))
    blocks = same_keys(blocks, several, keys, "inner")
    return _combine_blocks(_summed_blocks(blocks, keys, F.col("_tl_multi"), F.col("_tl_p")), keys)
