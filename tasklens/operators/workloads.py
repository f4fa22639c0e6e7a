"""Byte-array workloads (W1-W9) over a BINARY payload column.

Each workload maps one record (one payload) to one value; every record is
processed whole. Position-independent reductions over large payloads run
as Arrow-batched UDFs with NumPy kernels (``functions.bytes_np``);
random-position workloads are plain Column expressions (JVM side) because
they touch O(log n) or O(writes) bytes.

Random choices are counter-based: ``U(seed, tag, id, ...)`` (see
``functions.rng``), so the same record gets the same draw on a retry.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bytes_np, rng

# ------------------------------------------------------------------ UDF kernels


@F.arrow_udf(T.IntegerType())
def _byte_max_udf(a: pa.Array) -> pa.Array:
    return bytes_np.reduce_bytes(a, np.maximum, -128)


@F.arrow_udf(T.IntegerType())
def _byte_min_udf(a: pa.Array) -> pa.Array:
    return bytes_np.reduce_bytes(a, np.minimum, None)


@F.pandas_udf(T.LongType())
def _pair_sign_sum_udf(s: pd.Series) -> pd.Series:
    out = [None if b is None else bytes_np.pair_sign_sum(bytes_np.as_int8(b)) for b in s]
    return pd.Series(out, dtype="Int64")


# ------------------------------------------------------------------ W1, W2, W3


def byte_max(payload: Column, method: str = "arrow") -> Column:
    """Largest signed byte; an empty payload gives -128."""
    if method == "native":
        return F.coalesce(F.array_max(rng.bytes_array(payload)), F.lit(-128))
    return _byte_max_udf(payload)


def byte_min(payload: Column, method: str = "arrow") -> Column:
    """Smallest signed byte (the head after a sort); NULL when empty."""
    if method == "native":
        return F.array_min(rng.bytes_array(payload))
    return _byte_min_udf(payload)


def pair_sign_sum(payload: Column) -> Column:
    """Σ_{i<j} sign(a[i] - a[j]) over the signed bytes (BIGINT).

    +1 per inversion, -1 per ascent. Exact and near-linear per record
    (block histograms instead of all pairs). For values spread over rows
    (one group = many rows) use ``operators.pairs.pair_sign_sum_rows``.
    """
    return _pair_sign_sum_udf(payload)


# ------------------------------------------------------------------ W4, W5


def random_element(payload: Column, seed, *ids: Column, tag: str = "w4") -> Column:
    """One uniformly chosen signed byte; NULL when empty."""
    n = F.length(payload)
    pos = F.floor(rng.uniform(seed, tag, *ids) * n).cast("int")
    return F.when(n > 0, rng.byte_at(payload, pos))


def log_walk(payload: Column, seed, *ids: Column) -> Column:
    """struct(walk_sum, element).

    The walk starts in the middle, steps ±n, ±n/2, ... (a fair coin per
    step), is clamped to [0, n-1], and sums the bytes it lands on; the
    returned ``element`` is a uniform random byte, as in the original.
    """
    n = F.length(payload)
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"))
    init = F.struct(F.floor(n / 2).cast("int").alias("i"), n.alias("x"),
                    F.lit(0).cast("bigint").alias("s"))

    def step(acc, k):
        up = rng.uniform(seed, "w5c", *ids, k) < F.lit(0.5)
        moved = F.when(up, acc["i"] + acc["x"]).otherwise(acc["i"] - acc["x"])
        i = F.least(F.greatest(moved, F.lit(0)), n - 1)
        return F.struct(i.alias("i"), F.floor(acc["x"] / 2).cast("int").alias("x"),
                        (acc["s"] + rng.byte_at(payload, i)).alias("s"))

    walked = F.aggregate(steps, init, step)
    return F.when(n > 0, F.struct(walked["s"].alias("walk_sum"),
                                  random_element(payload, seed, *ids, tag="w5").alias("element")))


# ------------------------------------------------------------------ W6


#: Draws that are made at once.
_DRAWS = 1 << 14


@F.arrow_udf(T.BinaryType())
def _scramble_udf(payload: pa.Array, positions: pa.Array, values: pa.Array, n_writes: pa.Array) -> pa.Array:
    out = []
    n = n_writes[0].as_py() if len(n_writes) else 1
    step = max(_DRAWS // (2 * n), 1)
    for at in range(0, len(payload), step):
        keys = [*positions[at:at + step].to_pylist(), *values[at:at + step].to_pylist()]
        where, what = np.split(bytes_np.uniforms(keys, n), 2)
        what = np.floor(what * 256) - 128
        for b, u, v in zip(payload[at:at + step], where, what):
            if not b.is_valid or not len(b.as_buffer()):
                out.append(b.as_py())
            else:
                data = b.as_buffer()
                out.append(bytes_np.scramble(data, np.floor(u * len(data)).astype(np.int64), v))
    return pa.array(out, pa.binary())


def _writes(payload: Column, seed, id_col: Column, n_writes: int) -> tuple[Column, Column]:
    """Positions and values of the writes, drawn in the JVM."""
    ks, n = F.sequence(F.lit(1), F.lit(int(n_writes))), F.length(payload)
    return (F.transform(ks, lambda k: F.floor(rng.uniform(seed, "w6p", id_col, k) * n).cast("bigint")),
            F.transform(ks, lambda k: (F.floor(rng.uniform(seed, "w6v", id_col, k) * 256) - 128).cast("int")))


def scramble_bytes(payload: Column, seed, id_col: Column, n_writes: int) -> Column:
    """Overwrite ``n_writes`` random positions with random bytes.

    Write k (1..n_writes) goes to ``floor(U(seed,'w6p',id,k)·n)`` with the
    value ``floor(U(seed,'w6v',id,k)·256) - 128``; a later write to the same
    position wins. Count-based instead of clock-based. The writes are drawn where
    they are made, from the keys up to k, and assigned at once: O(n + writes).
    """
    if n_writes < 1:
        return payload
    return _scramble_udf(payload, rng.key(seed, "w6p", id_col), rng.key(seed, "w6v", id_col), F.lit(int(n_writes)))


def scramble_head(payload: Column, seed, id_col: Column, n_writes: int) -> Column:
    """W6h: the first signed byte after ``scramble_bytes``: the last value
    written to position 0, or the byte that stands there."""
    head = rng.byte_at(payload, F.lit(0))
    if n_writes < 1:
        return head
    pos, val = _writes(payload, seed, id_col, n_writes)
    hits = F.filter(F.arrays_zip(pos.alias("p"), val.alias("v")), lambda w: w["p"] == 0)
    last = F.try_element_at(hits, F.lit(-1))["v"]
    return F.when(F.length(payload) > 0, F.coalesce(last, head))


# ------------------------------------------------------------------ W8, W9


def arrow_workload(fn: Callable[[np.ndarray], object], return_type) -> Callable[[Column], Column]:
    """Wrap a per-record NumPy function (signed int8 array -> scalar) as an
    Arrow-batched Column function."""

    @F.pandas_udf(return_type)
    def _udf(s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else fn(bytes_np.as_int8(b)) for b in s])

    return _udf


def apply_workload(df: DataFrame, workload: Callable[[Column], Column], col: str = "payload",
                   out: str = "result") -> DataFrame:
    """Run a workload on every record and keep its result.

    ``workload`` maps a Column to a Column (built-in expressions, or
    ``arrow_workload`` for NumPy code); the projection is narrow, so it runs
    in the same stage as its input.
    """
    return df.withColumn(out, workload(F.col(col)))


def apply_workload_by(df: DataFrame, label: str | Column,
                      workloads: dict[object, Callable[[Column], Column]],
                      default: Callable[[Column], Column], col: str = "payload",
                      out: str = "result") -> DataFrame:
    """Choose the workload by a label (executor slot, host, language...);
    labels not listed take ``default``.

    Python workloads are computed ahead of a CASE, for every row; so each
    workload is given NULL in the rows of other labels, and must map NULL to
    NULL (or to anything: the CASE does not take it)."""
    lab = F.col(label) if isinstance(label, str) else label
    expr, listed = None, F.lit(False)
    for key, fn in workloads.items():
        cond = F.coalesce(lab == F.lit(key), F.lit(False))
        mine = fn(F.when(cond, F.col(col)))
        expr = F.when(cond, mine) if expr is None else expr.when(cond, mine)
        listed = listed | cond
    d = default(F.when(~listed, F.col(col)))
    return df.withColumn(out, d if expr is None else expr.otherwise(d))


# ------------------------------------------------------------------ chunked payloads


def chunk_payloads(df: DataFrame, keys: list[str], payload: str = "payload",
                   max_record_bytes: int = 1 << 26) -> DataFrame:
    """Cut a BINARY column into ordered chunk rows ``(keys..., chunk,
    payload)`` of at most ``max_record_bytes`` each (an empty payload keeps
    one empty chunk)."""
    m = F.lit(int(max_record_bytes))
    n = F.length(payload)
    parts = F.greatest(F.ceil(n / m).cast("bigint"), F.lit(1))
    rows = df.select(*keys, payload, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("chunk"))
    return rows.select(*keys, "chunk", F.substring(payload, (F.col("chunk") * m + 1).cast("int"),
                                                   m).alias(payload))


def byte_max_chunked(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """W1 over chunk rows: the largest signed byte of the whole payload."""
    return df.groupBy(*keys).agg(F.max(byte_max(F.col(payload))).alias("byte_max"))


def byte_min_chunked(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """W2 over chunk rows: the smallest signed byte (NULL when all empty)."""
    return df.groupBy(*keys).agg(F.min(byte_min(F.col(payload))).alias("byte_min"))
