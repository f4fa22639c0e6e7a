"""Two-stage suffix sorting of bytes in numpy, up to a limited depth."""

from __future__ import annotations

import numpy as np


def prefixes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number (zeros after
    the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= padded[j:j + len(text)] << np.uint64(56 - 8 * j)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the empty suffix is
    the smallest."""
    step = np.append(np.sign(np.diff(text.astype(np.int16))), -1)
    at = np.where(step != 0, np.arange(len(text)), len(text) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def sort_directly(pos: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their next ``depth`` bytes, eight at a time; only
    positions that are still tied are sorted again."""
    n = len(key8)
    key = key8[pos]
    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        nxt = pos[at] + d
        key = np.where(nxt < n, key8[np.minimum(nxt, n - 1)], np.uint64(0))
        # suffixes that have ended come first
        order = np.lexsort((key, nxt < n, group))
        pos[at] = pos[at][order]
        key, group, inside = key[order], group[order], (nxt < n)[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = ((key[1:] != key[:-1]) | (group[1:] != group[:-1]) | (inside[1:] != inside[:-1]))
        new[at] = fresh
    return pos


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of ``text`` (uint8), ordered by their first
    ``depth`` bytes at least.

    Only suffixes smaller than their successors are sorted directly. The
    others are induced: the buckets of first bytes are scanned upwards, and
    every suffix found puts the one that begins a byte before it, if larger,
    at the next place of that byte's bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(text)
    direct = sort_directly(np.flatnonzero(small), prefixes(text), depth)
    first = text[direct]
    edges = np.searchsorted(first, np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    queue[text[n - 1]].append(np.array([n - 1]))        # induced by the empty suffix
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)):
        found = []
        part = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        queue[c] = []
        while len(part):                                # runs of the same byte
            found.append(part)
            part = part[part > 0] - 1
            part = part[(text[part] == c) & ~small[part]]
        found.append(direct[edges[c]:edges[c + 1]])
        bucket = np.concatenate(found)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(np.diff(byte)) + 1
        for piece in np.split(before, cut):
            if len(piece):
                queue[text[piece[0]]].append(piece)
    return np.concatenate(out)


def equal_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes (8 at least) from the positions are equal;
    they lie within the text."""
    key8 = prefixes(text)
    same = np.ones(len(a), bool)
    for d in [*range(0, length - 8, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = key8[a[at] + d] == key8[b[at] + d]
    return same
