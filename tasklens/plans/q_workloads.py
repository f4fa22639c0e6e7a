"""Registered queries of the byte-workload family (W1-W9) over whole
``documents`` texts (UTF-8 bytes of every document, no prefix)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import workloads as W
from ..session import spread
from .registry import register, tables

SEED = 42
N_WRITES = 16


def docs(spark, sf_dir):
    (documents,) = tables(spark, sf_dir, "documents")
    return spread(documents, ["doc_id"]).select("doc_id", "lang",
                                                F.encode("text", "UTF-8").alias("payload"))


@register("W1_byte_max")
def w1(spark, sf_dir):
    """Largest signed byte of every document (whole UTF-8 text)."""
    return docs(spark, sf_dir).select("doc_id", W.byte_max(F.col("payload")).alias("byte_max"))


@register("W2_byte_min")
def w2(spark, sf_dir):
    """Smallest signed byte of every document."""
    return docs(spark, sf_dir).select("doc_id", W.byte_min(F.col("payload")).alias("byte_min"))


@register("W3_doc_pair_sign_sum")
def w3d(spark, sf_dir):
    """Sum over byte pairs i<j of sign(a_i - a_j) for every whole document."""
    return docs(spark, sf_dir).select(
        "doc_id", W.pair_sign_sum(F.col("payload")).alias("pair_sign_sum"))


@register("W4_random_element")
def w4(spark, sf_dir):
    """One seeded random byte of every document."""
    return docs(spark, sf_dir).select(
        "doc_id", W.random_element(F.col("payload"), SEED, F.col("doc_id")).alias("element"))


@register("W5_log_walk_element")
def w5(spark, sf_dir):
    """The halving random walk's byte sum and a random byte of every document."""
    walk = W.log_walk(F.col("payload"), SEED, F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", walk["walk_sum"].alias("walk_sum"),
                                      walk["element"].alias("element"))


@register("W6_scramble_bytes")
def w6(spark, sf_dir):
    """Every document after 16 seeded random byte writes (length, md5 of hex)."""
    s = W.scramble_bytes(F.col("payload"), SEED, F.col("doc_id"), N_WRITES)
    return docs(spark, sf_dir).select("doc_id", F.length(s).alias("n_bytes"),
                                      F.md5(F.hex(s)).alias("payload_md5"))


@register("W6h_scramble_head")
def w6h(spark, sf_dir):
    """W6h: the first byte of every scrambled document."""
    return docs(spark, sf_dir).select(
        "doc_id", W.scramble_head(F.col("payload"), SEED, F.col("doc_id"), N_WRITES).alias("head"))


def _count_high(a: np.ndarray) -> int:
    return int(np.count_nonzero(a < 0))


@register("W8_apply_workload")
def w8(spark, sf_dir):
    """A NumPy per-record workload: bytes >= 0x80 (negative when signed)."""
    fn = W.arrow_workload(_count_high, T.LongType())
    return W.apply_workload(docs(spark, sf_dir), fn, out="n_high").select("doc_id", "n_high")


@register("W9_apply_workload_by")
def w9(spark, sf_dir):
    """The workload chosen by document language (en: max, de: min, fr: random byte, else length)."""
    d = docs(spark, sf_dir)
    by_lang = {
        "en": lambda c: W.byte_max(c).cast("bigint"),
        "de": lambda c: W.byte_min(c).cast("bigint"),
        "fr": lambda c: W.random_element(c, SEED, F.col("doc_id")).cast("bigint"),
    }
    out = W.apply_workload_by(d, "lang", by_lang, lambda c: F.length(c).cast("bigint"))
    return out.select("doc_id", "lang", "result")


def doc_chunks(spark, sf_dir, max_record_bytes: int = 4096):
    return W.chunk_payloads(docs(spark, sf_dir), ["doc_id"], max_record_bytes=max_record_bytes)


@register("W1c_byte_max_chunked")
def w1c(spark, sf_dir):
    """W1 over every document cut into 4 KiB chunk rows."""
    return W.byte_max_chunked(doc_chunks(spark, sf_dir), ["doc_id"]).select(
        "doc_id", F.col("byte_max").cast("int").alias("byte_max"))


@register("W3c_doc_pair_sign_sum_chunked")
def w3c(spark, sf_dir):
    """W3 over every document cut into 4 KiB chunk rows (chunks as blocks)."""
    from ..operators.pairs import pair_sign_sum_chunked
    return pair_sign_sum_chunked(doc_chunks(spark, sf_dir), ["doc_id"])


@register("W6m_scramble_many_writes")
def w6m(spark, sf_dir):
    """W6 with 1000 writes per document (the O(n + writes) Arrow path)."""
    s = W.scramble_bytes(F.col("payload"), SEED, F.col("doc_id"), 1000)
    return docs(spark, sf_dir).select("doc_id", F.length(s).alias("n_bytes"),
                                      F.md5(F.hex(s)).alias("payload_md5"))
