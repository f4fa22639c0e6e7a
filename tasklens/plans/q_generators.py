"""Registered queries of the generator family.

Ids are the keys of ``supplier`` and ``orders`` rows, size tables come from
``nation``; the number of partitions is a parameter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..sources import generators as G
from .registry import register, rounded, tables

SEED = 42
PROCESS_SPECS = {
    "const": ("c", 2.0),
    "expo": ("x", 0.5),
    "erlang": ("e", 3, 1.5),
    "weibull": ("w", 2.0),
    "weibull_scaled": ("w", 1.5, 2.0),
    "default": (),
    "unknown": ("z", 1.0),
}


#: Partitions of the G1-G3 tables.
PARTS = 16


def _suppliers(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    return G.partitions_for(supplier, "s_suppkey", PARTS)


@register("G1_index_partitions")
def g1(spark, sf_dir):
    """G1: the supplier keys dealt to 16 partitions, with the partition."""
    return _suppliers(spark, sf_dir)


@register("G2_zero_partitions")
def g2(spark, sf_dir):
    """One 17-byte zero payload per supplier; length and md5 of its hex."""
    return _suppliers(spark, sf_dir).withColumn("payload", rng.zeros(17)).select(
        "id", "part", F.length("payload").alias("n_bytes"), F.md5(F.hex("payload")).alias("payload_md5"))


@register("G3_random_partitions")
def g3(spark, sf_dir):
    """One 40-byte seeded random payload per supplier, as hex."""
    return G.random_payloads_for(_suppliers(spark, sf_dir), "id", 40, SEED).select(
        "id", "part", F.length("payload").alias("n_bytes"), F.hex("payload").alias("payload_hex"))


def _nation_sizes(nation):
    # nations of regions 0-2 list a size, the rest take the default
    return nation.where(F.col("n_regionkey") <= 2).select(
        F.col("n_nationkey").alias("label"), (F.col("n_nationkey") + 3).alias("size"))


@register("G4_sized_partitions")
def g4(spark, sf_dir):
    """Payload size looked up by supplier nation in a sizes table from nation (regions 0-2), default 1."""
    supplier, nation = tables(spark, sf_dir, "supplier", "nation")
    df = G.sized_payloads_for(supplier.select(F.col("s_suppkey").alias("id"),
                                              F.col("s_nationkey").alias("label")),
                              "id", "label", _nation_sizes(nation), default_size=1, seed=SEED)
    return df.select("id", "label", "size", F.hex("payload").alias("payload_hex"))


def _by_slot(spark, sf_dir, slots):
    (supplier,) = tables(spark, sf_dir, "supplier")
    df = G.sized_by_slot(supplier, "s_suppkey", {"0": 5, "1": 9}, slots, default_size=2, seed=SEED)
    return df.select("id", "label", "size", F.hex("payload").alias("payload_hex"))


@register("G4e_sized_by_slot")
def g4e(spark, sf_dir):
    """G4e: payload size by the executor slot (of 3) that a supplier key is
    dealt to; slots 0 and 1 have sizes, slot 2 takes the default."""
    return _by_slot(spark, sf_dir, 3)


@register("G4t_sized_by_thread")
def g4t(spark, sf_dir):
    """G4t: the same by thread (of 5)."""
    return _by_slot(spark, sf_dir, 5)


@register("G4h_sized_by_host")
def g4h(spark, sf_dir):
    """G4h: payload size by the host that builds each supplier's row; only an
    unknown host has a size of its own, so that the result names no host."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    df = G.sized_by_host(supplier, "s_suppkey", {"no such host": 3}, default_size=8, seed=SEED)
    return df.select("id", "size", F.hex("payload").alias("payload_hex"))


@register("G5_keyed_records")
def g5(spark, sf_dir):
    """One keyed record per order key: key uniform in [0, 7), 8 random bytes."""
    (orders,) = tables(spark, sf_dir, "orders")
    df = G.keyed_records_for(orders, "o_orderkey", num_keys=7, record_size=8, seed=SEED)
    return df.select("id", "key", F.hex("payload").alias("payload_hex"))


@register("G6_union_batches")
def g6(spark, sf_dir):
    """The keyed records built in three pieces (of the order keys) and bag-unioned."""
    (orders,) = tables(spark, sf_dir, "orders")
    pieces = [G.keyed_records_for(orders.where(F.coalesce(F.pmod("o_orderkey", F.lit(3)), F.lit(0)) == i),
                                  "o_orderkey", num_keys=7, record_size=8, seed=SEED)
              for i in range(3)]
    return G.union_batches(pieces).select("id", "key", F.hex("payload").alias("payload_hex"))


@register("G7_processes")
def g7(spark, sf_dir):
    """One sample per order key of every random process spec (c, x, e, w, w with scale, default, unknown)."""
    (orders,) = tables(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cols = [G.process_column(spec, SEED, name, k).alias(name)
            for name, spec in PROCESS_SPECS.items()]
    return rounded(orders.select(k.alias("id"), *cols))


@register("G8_job_tasks")
def g8(spark, sf_dir):
    """Per order (job) 4 tasks with exponential service times keyed by (job, task)."""
    (orders,) = tables(spark, sf_dir, "orders")
    return rounded(G.job_tasks_for(orders, "o_orderkey", 4, ("x", 1.0), SEED))


@register("G9_square_points")
def g9(spark, sf_dir):
    """One random point of the 2x2 square per order key."""
    (orders,) = tables(spark, sf_dir, "orders")
    return rounded(G.square_points_for(orders, "o_orderkey", SEED))


@register("G9_pi_estimate")
def g9pi(spark, sf_dir):
    """4 x share of the order-keyed points inside the unit circle."""
    (orders,) = tables(spark, sf_dir, "orders")
    return G.pi_estimate(G.square_points_for(orders, "o_orderkey", SEED))


@register("G2c_zero_partitions_chunked")
def g2c(spark, sf_dir):
    """G2 with payloads larger than one row may hold: 100 zero bytes per
    supplier in chunk rows of at most 32 bytes."""
    df = G.chunked_payloads_for(_suppliers(spark, sf_dir), "id", 100, 32, zero=True)
    return df.select("id", "chunk", F.length("payload").alias("n_bytes"),
                     F.md5(F.hex("payload")).alias("payload_md5"))


@register("G3c_random_partitions_chunked")
def g3c(spark, sf_dir):
    """G3 in chunk rows: chunk k holds bytes [32k, 32k+32) of PAYLOAD(id, 100)."""
    df = G.chunked_payloads_for(_suppliers(spark, sf_dir), "id", 100, 32, seed=SEED)
    return df.select("id", "chunk", F.hex("payload").alias("payload_hex"))
