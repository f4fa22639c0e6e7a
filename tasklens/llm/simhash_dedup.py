"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for the majority of its shingles' hashes. Two
fingerprints within Hamming distance r collide in at least one of 2^(r+1) - 1
tables: bit i is given a non-zero vector m(i) of r + 1 bits, all of them in
turn (powers of two first), and table v keeps the bits whose m(i) has an odd number of ones in
common with v. The vectors of at most r differing bits span less than r + 1
dimensions, so some v is orthogonal to all of them and its table keeps none of
the differing bits.

A fingerprint stands once in each table, so one bucket holds at most the
(2^(r+1) - 1)-th part of the rows. A bucket of over ``BUCKET`` fingerprints is
dealt out again by a covering of the bits that its table left out (the left-out
bits halve each time and the fingerprints of a bucket differ in those bits
only). A bucket whose table leaves out at most ``CUBE`` bits holds at most
2^CUBE fingerprints and is linked by flipping these bits, so two rounds of
refinement are enough. Buckets return a spanning forest of their links, never
all pairs.

Edge cases: null and empty texts, and texts without a word, have fingerprint
zero and are linked like any other; repeated rows are all returned; an empty
table gives an empty result; other columns are not read by the operator. A
null doc_id takes no part in the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import (arrow_texts, by_place, checkpointed, connected_components, renamed,
                                  utf8)

BITS = 64
SEED = 42
#: Largest bucket that is compared pair by pair, within one Python batch.
BUCKET = 1024
#: Left-out bits at which a large bucket is linked by flips instead of refined.
CUBE = 16
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text, shingle: int) -> int:
    """Unsigned SimHash of a text's word shingles (repeats included)."""
    words = utf8(text).translate(LOWER_BYTES).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:max(len(words) - shingle + 1, 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(line[s:e], SEED) for s, e in
                      zip(starts[at:at + CHUNK], ends[at:at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in arrow_texts(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def covering(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them are
    left out together by some mask; as signed longs."""
    n = (1 << (radius + 1)) - 1
    # powers of two first: few bits span all dimensions, so that each mask keeps some
    order = sorted(range(1, n + 1), key=lambda m: (m.bit_count() > 1, m))
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << b for i, b in enumerate(bits) if (order[i % n] & v).bit_count() % 2)
        masks.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return masks


def left_out(mask: int) -> list[int]:
    """The bit positions that a mask does not keep."""
    m = mask % (1 << BITS)
    return [b for b in range(BITS) if not m >> b & 1]


def finer(mask: int, radius: int) -> list[int]:
    """Masks that refine ``mask`` by a covering of the bits it leaves out (more
    than ``CUBE``: of so many, each mask keeps some)."""
    return [x | mask for x in covering(left_out(mask), radius)]


def refined(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows (mask, fp) dealt out to the finer masks of their mask."""
    for f in frames:
        for mask, fps in f.groupby("mask")["fp"]:
            masks = np.array(finer(int(mask), radius), np.int64)
            yield pd.DataFrame({"mask": np.repeat(masks, len(fps)), "fp": np.tile(fps, len(masks))})


def bucket_links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int):
    """Spanning forest of the links within sorted buckets: (fp, root) arrays."""
    last = np.r_[(mask[1:] != mask[:-1]) | (key[1:] != key[:-1]), True]
    group = np.cumsum(last) - last
    pairs_i, pairs_j = [], []
    i, off = np.arange(len(fp)), 1
    while True:
        i = i[i + off < len(fp)]
        i = i[group[i] == group[i + off]]
        if not len(i):
            break
        near = i[np.bitwise_count((fp[i] ^ fp[i + off]).view(np.uint64)) <= radius]
        pairs_i.append(near)
        pairs_j.append(near + off)
        off += 1
    label = np.arange(len(fp))
    if pairs_i:
        a, b = np.concatenate(pairs_i), np.concatenate(pairs_j)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def cube_links(mask: int, fp: np.ndarray, radius: int):
    """bucket_links of one bucket by flipping up to ``radius`` of the bits that
    ``mask`` leaves out: every fingerprint looks at its neighbours once."""
    free = left_out(mask)
    place = np.zeros(len(fp), np.int64)
    for i, b in enumerate(free):
        place |= (fp.view(np.uint64) >> np.uint64(b) & np.uint64(1)).astype(np.int64) << i
    flips = np.arange(1, 1 << len(free))
    flips = flips[np.bitwise_count(flips) <= radius]
    at = np.full(1 << len(free), -1)
    at[place] = np.arange(len(fp))
    fresh = at >= 0
    a, b = [], []
    for start in np.flatnonzero(fresh):
        if not fresh[start]:
            continue
        fresh[start], queue = False, [np.array([start])]
        while queue:
            edge = queue.pop()
            if len(edge) > 256:
                queue.append(edge[256:])
            near = (edge[:256, None] ^ flips).ravel()
            near = np.unique(near[fresh[near]])
            if len(near):
                fresh[near] = False
                queue.append(near)
                a.append(fp[at[near]])
                b.append(np.full(len(near), fp[at[start]]))
    none = np.zeros(0, fp.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def solve_buckets(rows: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(mask, a, b) of rows (mask, key, fp): links a-b with a null mask, and
    the members a of buckets that are too large, with their mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(f):
            size = f.groupby(["mask", "key"], sort=False)["fp"].transform("size").to_numpy()
            small = f[size <= bucket]
            found = [bucket_links(*(small[c].to_numpy() for c in ("mask", "key", "fp")), radius)] if len(small) else []
            for (mask, _), g in f[size > bucket].groupby(["mask", "key"]):
                found.append(cube_links(int(mask), g["fp"].to_numpy(), radius))
            a, b = (np.concatenate(c) for c in zip(*found, strict=True))
            return pd.DataFrame({"mask": pd.array([None] * len(a), "Int64"), "a": a, "b": b})

        def wide(masks):
            return BITS - np.bitwise_count(masks.to_numpy().view(np.uint64)) > CUBE

        rest, over = None, None     # the unfinished last bucket; the large one being passed on
        for f in frames:
            if rest is not None:
                f = pd.concat([rest, f], ignore_index=True)
            if over is not None:
                same = (f["mask"] == over[0]) & (f["key"] == over[1])
                n = int(same.to_numpy().argmin()) if not same.all() else len(f)
                if n:
                    yield pd.DataFrame({"mask": f["mask"][:n], "a": f["fp"][:n], "b": f["fp"][:n]})
                f, rest = f.iloc[n:], None
                if not len(f):
                    continue
                over = None
            size = f.groupby(["mask", "key"], sort=False)["fp"].transform("size").to_numpy()
            large = (size > bucket) & wide(f["mask"])
            if large.any():
                big = f[large]
                yield pd.DataFrame({"mask": big["mask"], "a": big["fp"], "b": big["fp"]})
            end = (f["mask"].iat[-1], f["key"].iat[-1])
            if large[-1]:
                over, rest, open_ = end, None, np.zeros(len(f), bool)
            else:
                open_ = ((f["mask"] == end[0]) & (f["key"] == end[1])).to_numpy()
                rest = f[open_]
            done = f[~large & ~open_ & (size > 1)]
            if len(done):
                yield links(done)
        if rest is not None and len(rest) > 1:
            yield links(rest)

    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInPandas(run, "mask long, a long, b long")


def near_links(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links whose components are those of all pairs of the distinct
    fingerprints ``fp`` within ``radius``."""
    masks = F.array(*[F.lit(m).cast("long") for m in covering(list(range(BITS)), radius)])
    rows = fps.select("fp", F.explode(masks).alias("mask"))
    links = None
    while True:
        found = checkpointed(solve_buckets(
            rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"),
            radius, bucket))
        new = found.filter("mask IS NULL").select("a", "b")
        links = new if links is None else links.unionAll(new)
        over = found.filter("mask IS NOT NULL")
        if over.isEmpty():
            return links
        rows = over.select("mask", F.col("a").alias("fp")).mapInPandas(
            lambda frames: refined(frames, radius), "mask long, fp long")


def near_duplicates(documents: DataFrame, shingle: int = 4, radius: int = 4,
                    bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (signed long), component (a fingerprint that stands for the
    class) and component_id (smallest doc_id of the class) of every row."""
    prints = checkpointed(fingerprints(documents, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = connected_components(near_links(classes.select("fp"), radius, bucket))
    classes = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = classes.join(lowest, "component").select("fp", "component", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component", "component_id")


def keep_one(documents: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the
    smallest doc_id stays (one of them if that row is repeated)."""
    cols = documents.columns
    doc_id, text = (f"c{cols.index(c)}" for c in ("doc_id", "text"))
    found = checkpointed(near_duplicates(documents, shingle, radius))
    kept = (found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("n")))
    out = by_place(documents).join(kept, F.col(doc_id).eqNullSafe(F.col("kept")))
    if not kept.filter("n > 1").isEmpty():
        again = out.filter("n > 1").dropDuplicates([doc_id, text])
        out = out.filter("n = 1").unionAll(again)
    return renamed(out, cols)


def hex_digits(fp: str):
    """16 lowercase hex digits of a long column's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
