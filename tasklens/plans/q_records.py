"""Registered queries of the record family (W3 rows form / J4, W7, A1, A2,
O1) over ``lineitem`` grouped by ``l_orderkey``; record = big-endian bytes
of ``l_partkey``; ties broken by the full lineitem row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import pairs as P
from ..operators import records as R
from ..sources.tablelog import LINEITEM_ORDER
from .registry import register, tables

TIE = [c for c in LINEITEM_ORDER if c != "l_orderkey"]


def lineitem(spark, sf_dir):
    (li,) = tables(spark, sf_dir, "lineitem")
    return li


@register("W3_pair_sign_sum")
def w3(spark, sf_dir):
    """Pair sign sums of each order's signed low bytes of l_partkey."""
    li = lineitem(spark, sf_dir)
    v = rng.signed_byte(F.pmod(F.col("l_partkey"), F.lit(256)))
    return P.pair_sign_sum_rows(li, ["l_orderkey"], v, TIE)


@register("W3b_pair_sign_sum_supplier")
def w3b(spark, sf_dir):
    """J4/W3 over suppliers (few large groups), in blocks of 64 positions, so
    that sums across blocks are part of the check."""
    li = lineitem(spark, sf_dir)
    v = rng.signed_byte(F.pmod(F.col("l_partkey"), F.lit(256)))
    order = ["l_orderkey", *[c for c in TIE if c != "l_suppkey"]]
    return P.pair_sign_sum_rows(li, ["l_suppkey"], v, order, block_size=64)


@register("W7_record_lt")
def w7(spark, sf_dir):
    """l_partkey record < l_suppkey record as unsigned big-endian integers."""
    li = lineitem(spark, sf_dir)
    lt = R.record_lt(R.be_record(F.col("l_partkey")), R.be_record(F.col("l_suppkey")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lt.alias("lt"))


@register("W7s_record_lt_signed")
def w7s(spark, sf_dir):
    """W7 signed: the same on 4-byte records compared byte-wise signed."""
    li = lineitem(spark, sf_dir)
    a = R.be_record(F.col("l_partkey"), 4)
    b = R.be_record(F.col("l_suppkey") * 131, 4)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     R.record_lt(a, b, signed=True).alias("lt"))


@register("A1_group_records")
def a1(spark, sf_dir):
    """A1: every order's records (big-endian l_partkey) in row order, in pages
    of four line numbers."""
    li = lineitem(spark, sf_dir).withColumn("rec", R.be_record(F.col("l_partkey")))
    g = R.group_records(li, "l_orderkey", "rec", order=TIE,
                        page=F.floor(F.col("l_linenumber") / 4).cast("bigint"))
    return g.select("l_orderkey", "page", F.size("records").alias("n_records"),
                    F.array_join(F.transform("records", lambda r: F.hex(r)), ",").alias("records_hex"))


@register("A2_keyed_max_last_byte")
def a2(spark, sf_dir):
    """A2: per order, the last byte (signed) of its largest record."""
    li = lineitem(spark, sf_dir).withColumn("rec", R.be_record(F.col("l_partkey")))
    return R.keyed_max_last_byte(li, "l_orderkey", "rec", width=7)


@register("A2s_keyed_max_last_byte_signed")
def a2s(spark, sf_dir):
    """A2 signed: the same under the byte-wise signed order of 4-byte records."""
    li = lineitem(spark, sf_dir).withColumn("rec", R.be_record(F.col("l_partkey"), 4))
    return R.keyed_max_last_byte(li, "l_orderkey", "rec", signed=True, width=4)


@register("O1_sort_records")
def o1(spark, sf_dir):
    """O1: stable sort of every order's records; position within the order."""
    li = lineitem(spark, sf_dir).withColumn("rec", R.be_record(F.col("l_partkey")))
    s = R.sort_records(li, "l_orderkey", "rec", tie=TIE)
    return s.select("l_orderkey", "pos", F.hex("rec").alias("rec_hex"), "l_linenumber", "l_suppkey")
