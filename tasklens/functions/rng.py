"""Counter-based random numbers and payload bytes, as Column expressions.

Every draw is a pure function of (seed, tag, ids...), so a value does not
depend on partitioning, task retries or executor loss, and DuckDB computes
the same numbers from the same formula (see ``plans.oracle``).

Fixed formulas (they must equal the DuckDB twins exactly):

* ``U(seed, tag, ids...) = (int(first 13 hex digits of md5(s)) + 0.5) / 2**52``
  with ``s = concat_ws(':', seed, tag, ids...)``; never 0 or 1.
* ``PAYLOAD(seed, id, n)`` = the first n bytes of
  ``unhex(md5(seed:id:0) || md5(seed:id:1) || ...)``; n = 0 gives ``X''``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2 ** 52)


def _s(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def _key(seed, tag, *ids) -> Column:
    return F.concat_ws(":", _s(seed), _s(tag), *[_s(i) for i in ids])


def key(seed, tag, *ids) -> Column:
    """What is hashed for a draw; ``bytes_np.uniforms`` takes it without the last id."""
    return _key(seed, tag, *ids)


def uniform(seed, tag, *ids) -> Column:
    """U in (0, 1), a deterministic function of its arguments."""
    hex13 = F.substring(F.md5(_key(seed, tag, *ids)), 1, 13)
    return (F.conv(hex13, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO_POW_52)


def payload(seed, id_col, n) -> Column:
    """``n`` pseudo-random bytes keyed by (seed, id); BINARY."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    blocks = F.greatest(F.ceil(n / F.lit(16)).cast("int"), F.lit(1))
    hexes = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.md5(F.concat_ws(":", _s(seed), _s(id_col), k.cast("string"))),
    )
    full = F.unhex(F.array_join(hexes, ""))
    return F.when(n <= 0, F.lit(bytearray())).otherwise(F.substring(full, 1, n))


def payload_slice(seed, id_col, start, n) -> Column:
    """Bytes ``[start, start + n)`` of ``PAYLOAD(seed, id, .)``; ``start``
    must be a multiple of 16 (an md5 block boundary)."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    start = start if isinstance(start, Column) else F.lit(int(start))
    first = (start / F.lit(16)).cast("bigint")
    blocks = F.greatest(F.ceil(n / F.lit(16)).cast("bigint"), F.lit(1))
    hexes = F.transform(
        F.sequence(first, first + blocks - 1),
        lambda k: F.md5(F.concat_ws(":", _s(seed), _s(id_col), k.cast("string"))),
    )
    full = F.unhex(F.array_join(hexes, ""))
    return F.when(n <= 0, F.lit(bytearray())).otherwise(F.substring(full, 1, n))


def zeros(n) -> Column:
    """``n`` zero bytes; BINARY."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.when(n <= 0, F.lit(bytearray())).otherwise(
        F.lpad(F.lit(bytearray()), n, F.lit(bytearray(b"\x00"))))


def signed_byte(unsigned: Column) -> Column:
    """0..255 -> -128..127."""
    return F.when(unsigned >= 128, unsigned - 256).otherwise(unsigned).cast("int")


def byte_at(b: Column, pos0: Column) -> Column:
    """Signed byte at 0-based position ``pos0`` of BINARY ``b``."""
    one = F.substring(b, pos0 + 1, 1)
    return signed_byte(F.conv(F.hex(one), 16, 10).cast("int"))


def byte_from_signed(v: Column) -> Column:
    """-128..127 (or 0..255) -> a one-byte BINARY."""
    return F.unhex(F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0"))


def bytes_array(b: Column) -> Column:
    """BINARY -> ARRAY<INT> of signed bytes (small payloads only)."""
    n = F.length(b)
    arr = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                      lambda i: byte_at(b, i))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(arr)


def gamma(x: float) -> float:
    """Driver-side Gamma function for the Weibull default scale."""
    return math.gamma(x)
