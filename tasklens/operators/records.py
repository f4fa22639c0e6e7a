"""Keyed records read as big-endian integers.

A record is a BINARY value. The documented order ("compare as the bytes of
an arbitrary-size big-endian integer") is unsigned: leading zero bytes do
not count. ``signed=True`` gives the order the original code really used
for equal lengths: byte by byte, each byte signed (-128..127).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.ranking import rank_within


def be_record(x: Column, width: int | None = None) -> Column:
    """Big-endian bytes of a non-negative integer; minimal length by default
    (``0`` -> ``X'00'``), or exactly ``width`` bytes."""
    h = F.hex(x)
    if width is None:
        h = F.when(F.length(h) % 2 == 1, F.concat(F.lit("0"), h)).otherwise(h)
    else:
        h = F.lpad(h, 2 * int(width), "0")
    return F.unhex(h)


def _stripped_hex(rec: Column) -> Column:
    return F.regexp_replace(F.hex(rec), "^(00)+", "")


def record_order_key(rec: Column, signed: bool = False) -> Column:
    """A sortable key equal to the record order. Unsigned: the length without
    leading zero bytes (4 bytes), then these bytes, as one BINARY that sorts by
    its first eight bytes before anything else is looked at."""
    if signed:
        return rng.bytes_array(rec)
    stripped = F.ltrim(rec.cast("string"), F.lit("\0")).cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(stripped)), 8, "0")), stripped)


def record_lt(a: Column, b: Column, signed: bool = False) -> Column:
    """``a < b`` as big-endian integers.

    Unsigned: both sides are left-padded with zero bytes to one length and
    compared as BINARY (unsigned, lexicographic). Signed: equal lengths
    only (unequal lengths raise, as the original misreads them).
    """
    if signed:
        same = F.length(a) == F.length(b)
        return F.when(same, rng.bytes_array(a) < rng.bytes_array(b)).otherwise(
            F.raise_error(F.lit("signed record_lt needs equal lengths")).cast("boolean"))
    m = F.greatest(F.length(a), F.length(b))
    zero = F.lit(bytearray(b"\x00"))
    return F.lpad(a, m, zero) < F.lpad(b, m, zero)


def group_records(df: DataFrame, key: str, rec: str, order: list[str] | None = None,
                  page: Column | None = None) -> DataFrame:
    """A1: ``(key, records ARRAY<BINARY>)``, all records of a key in a row.

    This is the grouped form the original works on; one group must fit in
    one row. ``order`` fixes the element order (else arrival order).
    ``page`` bounds the rows: with it the result is ``(key, page, records)``,
    one row for each value of ``page`` in a key. Take a value that never
    falls along ``order`` and holds boundedly many records, and the arrays of
    a key's pages, one after the other, are the key's records.
    """
    keys = [key]
    if page is not None:
        df = df.withColumn("page", page)
        keys = [key, "page"]
    if order:
        items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order],
                                                     F.col(rec).alias("_tl_rec"))))
        recs = F.transform(items, lambda s: s["_tl_rec"])
    else:
        recs = F.collect_list(rec)
    return df.groupBy(*keys).agg(recs.alias("records"))


def keyed_max_last_byte(df: DataFrame, key: str, rec: str, signed: bool = False,
                        width: int | None = None) -> DataFrame:
    """A2: per key, the largest record; its last byte as a signed BIGINT.

    A partial aggregate of an order key (no record arrays are built);
    0 when the largest record is empty. ``width``: no record is longer than
    so many bytes (7 at most; signed: all have just so many), so the order key
    is a BIGINT and the aggregate a hash aggregate; other lengths raise.
    """
    if width is not None:
        if not 1 <= width <= 7:
            raise ValueError("width must be 1..7")
        n = F.length(rec)
        bad = (n != width) if signed else (n > width)
        num = F.coalesce(F.conv(F.hex(rec), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
        flip = F.lit(int("80" * width, 16)).cast("bigint")
        order = F.when(bad, F.raise_error(F.lit("record length beyond width")).cast("bigint")).otherwise(
            num.bitwiseXOR(flip) if signed else num)
        top = F.max(order)
        low = (top.bitwiseXOR(flip) if signed else top).bitwiseAND(F.lit(255).cast("bigint"))
        return df.groupBy(key).agg(F.coalesce(rng.signed_byte(low), F.lit(0)).cast("bigint")
                                   .alias("max_last_byte"))
    if signed:
        top = F.max(rng.bytes_array(F.col(rec)))
        last = F.element_at(top, -1)
        return df.groupBy(key).agg(F.coalesce(last, F.lit(0)).cast("bigint").alias("max_last_byte"))
    h = _stripped_hex(F.col(rec))
    top = F.max(F.struct(F.length(h).alias("len"), h.alias("hex")))
    tail = F.substring(top["hex"], -2, 2)
    last = F.when(top["len"] > 0, rng.signed_byte(F.conv(tail, 16, 10).cast("int"))).otherwise(0)
    return df.groupBy(key).agg(last.cast("bigint").alias("max_last_byte"))


def sort_records(df: DataFrame, key: str, rec: str, tie: list[str] | None = None,
                 signed: bool = False, split_rows: int | None = None) -> DataFrame:
    """O1: stable sort of each key's records; adds 1-based ``pos`` (BIGINT).

    Ties under the record order keep the order of ``tie`` columns. Frequent
    keys are cut into ranges of whole records (``plans.ranking.rank_within``).
    """
    okey = "_tl_okey"
    with_key = df.withColumn(okey, record_order_key(F.col(rec), signed))
    more = {"split_rows": split_rows} if split_rows is not None else {}
    return rank_within(with_key, [key], [okey, *(tie or [])], out="pos", **more).drop(okey)
