"""Randomised properties (hypothesis) of the kernels and scans."""

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import pair_sign_sum_bruteforce
from tasklens.functions import bytes_np
from tasklens.operators import queueing as Q

byte_lists = st.lists(st.integers(-128, 127), max_size=300)


@given(byte_lists)
@settings(max_examples=200, deadline=None)
def test_pair_sign_sum_matches_bruteforce(vals):
    a = np.array(vals, dtype=np.int8)
    assert bytes_np.pair_sign_sum(a) == pair_sign_sum_bruteforce(a)


@given(byte_lists)
@settings(max_examples=100, deadline=None)
def test_pair_sign_sum_reverses_sign(vals):
    a = np.array(vals, dtype=np.int8)
    assert bytes_np.pair_sign_sum(a[::-1]) == -bytes_np.pair_sign_sum(a)


@given(st.lists(st.integers(-128, 127), min_size=1, max_size=200), st.integers(1, 199))
@settings(max_examples=100, deadline=None)
def test_block_summaries_compose(vals, cut):
    """inner(A) + inner(B) + cross(A, B) == inner(A + B) with cross from the
    histogram of A and the D vector of B, as the row form combines blocks."""
    a = np.array(vals, dtype=np.int8)
    cut = min(cut, len(a))
    left, right = a[:cut], a[cut:]
    s1, h1, _ = bytes_np.block_summary(left)
    s2, _, d2 = bytes_np.block_summary(right)
    assert s1 + s2 + int((h1 * d2).sum()) == bytes_np.pair_sign_sum(a)


def _loop(jobs):
    out, last = [], None
    for a, s in jobs:
        d = (a if last is None else max(a, last)) + s
        out.append(d)
        last = d
    return out


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 20)), min_size=1, max_size=40),
       st.integers(1, 9))
@settings(max_examples=15, deadline=None)
def test_fifo_blocked_matches_loop(spark, jobs, block):
    jobs = sorted(jobs)
    rows = [(1, i, a, s) for i, (a, s) in enumerate(jobs)]
    df = spark.createDataFrame(rows, "q int, j int, arrival bigint, service bigint")
    got = Q.fifo_departures(df, ["q"], ["arrival", "j"], block=F.floor(F.col("arrival") / block))
    got = [r.departure for r in got.orderBy("j").collect()]
    assert got == _loop(jobs)
