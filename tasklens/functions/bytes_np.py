"""NumPy kernels for one byte array (run inside Arrow-batched UDFs).

Bytes are read as signed int8 (-128..127), the order the workloads use.
Each kernel is linear or near-linear in the array length and needs bounded
memory, so a whole document (not a prefix) is processed in one call.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

import numpy as np

_BLOCK = 32          # within-block pairs are compared directly
_SEGMENT = 1 << 18   # bounded working memory per step


def byte_buffer(a) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, signed bytes) of an Arrow binary or string array, as views."""
    import pyarrow as pa
    wide = pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type)
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.int8)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    return off, np.frombuffer(data, np.int8) if data is not None else np.zeros(0, np.int8)


def reduce_bytes(a, ufunc, empty: int | None):
    """One signed byte per value of an Arrow binary array: ``ufunc`` reduced
    over its bytes in a single call for the whole batch; ``empty`` for values
    without bytes, null for nulls."""
    import pyarrow as pa
    off, data = byte_buffer(a)
    size = np.diff(off)
    has = size > 0
    out = np.full(len(a), 0 if empty is None else empty, np.int32)
    if has.any():
        # values without bytes take no room: the others follow each other
        out[has] = ufunc.reduceat(data[off[0]:off[-1]], (off[:-1] - off[0])[has])
    null = np.asarray(a.is_null())
    return pa.array(out, mask=null | ~has if empty is None else null)


def as_int8(b) -> np.ndarray:
    return np.frombuffer(bytes(b), dtype=np.int8)


def _segment_sign_sum(seg: np.ndarray, before: np.ndarray) -> int:
    """Σ sign(a_i - a_j) over pairs i<j with j in ``seg``; values 0..255.

    ``before`` is the value histogram of everything preceding ``seg``.
    """
    n = len(seg)
    # pairs with an earlier segment
    cb = np.cumsum(before)
    lt = cb - before               # earlier values < x
    gt = cb[-1] - cb               # earlier values > x
    total = int((gt - lt)[seg].sum())
    # pairs across blocks of this segment
    nb = -(-n // _BLOCK)
    blk = np.arange(n) // _BLOCK
    hist = np.bincount(blk * 256 + seg, minlength=nb * 256).reshape(nb, 256)
    prefix = np.cumsum(hist, axis=0) - hist
    cp = np.cumsum(prefix, axis=1)
    total += int(((cp[:, -1:] - cp) - (cp - prefix))[blk, seg].sum())
    # pairs inside a block
    m = np.full(nb * _BLOCK, -1, dtype=np.int16)
    m[:n] = seg
    m = m.reshape(nb, _BLOCK)
    d = np.sign(m[:, :, None] - m[:, None, :]).astype(np.int8)
    valid = m >= 0
    mask = np.triu(np.ones((_BLOCK, _BLOCK), dtype=bool), 1)[None] & valid[:, :, None] & valid[:, None, :]
    total += int(d[mask].sum(dtype=np.int64))
    return total


_SMALL = 48


def pair_sign_sum(a: np.ndarray) -> int:
    """Σ_{i<j} sign(a[i] - a[j]) for signed bytes; O(n · (32 + 256/32))."""
    if len(a) <= _SMALL:   # direct: all pairs of a short array
        x = a.astype(np.int16)
        return int(np.triu(np.sign(x[:, None] - x[None, :]), 1).sum())
    v = a.astype(np.int64) + 128
    total = 0
    before = np.zeros(256, dtype=np.int64)
    for s in range(0, len(v), _SEGMENT):
        seg = v[s:s + _SEGMENT]
        total += _segment_sign_sum(seg, before)
        before += np.bincount(seg, minlength=256)
    return total


def block_summary(a: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """For one block of signed bytes: (inner sign sum, histogram, D) where
    D[u] = #{x in block: x < u} - #{x in block: x > u} over u = -128..127."""
    v = a.astype(np.int64) + 128
    hist = np.bincount(v, minlength=256).astype(np.int64)
    c = np.cumsum(hist)
    below = c - hist
    above = c[-1] - c
    return pair_sign_sum(a), hist, below - above


_MD5_T = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_MD5_S = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)


def md5_heads(block: np.ndarray) -> np.ndarray:
    """First 8 bytes of the md5 of messages of one block each, as big-endian numbers.

    ``block``: (messages, 64) bytes, padded as md5 wants it. All messages go through
    a step together: many short ones are hashed several times faster than one by one."""
    m = np.ascontiguousarray(block.view("<u4").T)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(block), x, np.uint32) for x in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += _MD5_T[i]
        a, d, c, turned = d, c, b, f << _MD5_S[i]
        turned |= f >> np.uint32(32 - _MD5_S[i])
        turned += b
        b = turned
    first, second = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b), start, strict=False))
    return (first << np.uint64(32)) | second


@lru_cache(4)
def _numbers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers 1 to n as text, each with the byte that ends an md5 message, and their lengths."""
    text = [b"%d" % k for k in range(1, n + 1)]
    size = np.array([len(t) for t in text])
    rows = b"".join((t + b"\x80").ljust(len(text[-1]) + 1, b"\0") for t in text)
    return np.frombuffer(rows, np.uint8).reshape(n, -1), size


def uniforms(keys: list[str], n: int) -> np.ndarray:
    """U of ``functions.rng`` for ``<key>:1`` to ``<key>:n``, a row for each key: the
    first 52 bits of each md5 and a half, over 2^52."""
    text, size = _numbers(n)
    block = np.zeros((len(keys), n, 64), np.uint8)
    long = {}
    for row, key in zip(block, keys, strict=True):
        prefix = f"{key}:".encode()
        end = len(prefix) + text.shape[1]
        if end > 56:                                     # does not fit one block
            long[key] = [md5(b"%s%d" % (prefix, k), usedforsecurity=False).digest()[:8] for k in range(1, n + 1)]
            continue
        row[:, :len(prefix)] = np.frombuffer(prefix, np.uint8)
        row[:, len(prefix):end] = text
        row[:, 56:58] = ((len(prefix) + size) * 8).astype("<u2").view(np.uint8).reshape(n, 2)
    head = md5_heads(block.reshape(-1, 64)).reshape(len(keys), n)
    for i, key in enumerate(keys):
        if key in long:
            head[i] = np.frombuffer(b"".join(long[key]), ">u8")
    return ((head >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0 ** 52


def scramble(b: bytes, pos: np.ndarray, val: np.ndarray) -> bytes:
    """W6 on one payload: byte ``pos[k]`` becomes ``val[k]`` for every k in
    order (a later write to a position wins); O(n + writes)."""
    out = np.frombuffer(b, np.int8).copy()
    out[pos] = val.astype(np.int8)
    return out.tobytes()


#: Records up to this length are summed many at once.
SHORT = 64


def pair_sign_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pair sign sums of many records of signed bytes, one after the other in
    ``values``: short ones of one length as the rows of a matrix, column by
    column; long ones each by itself."""
    if len(values) and (values.min() < -128 or values.max() > 127):
        raise ValueError("pair sign sums need signed byte values")
    values = values.astype(np.int16)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(lengths), np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if n <= SHORT:
            m = values[starts[rows][:, None] + np.arange(n)]
            for d in range(1, n):
                out[rows] += np.sign(m[:, :-d] - m[:, d:]).sum(axis=1)
        else:
            for r in rows:
                out[r] = pair_sign_sum(values[starts[r]:starts[r] + n].astype(np.int8))
    return out
