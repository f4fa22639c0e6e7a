"""Exact substring deduplication with suffix arrays.

Every byte that lies in a ``length``-byte window which also starts earlier
(smaller doc_id, or the same document further left) is removed.

1. Each window is anchored at the smallest hashed ``gram`` bytes in it, so
   equal windows have equal anchors. The windows of one anchor follow each
   other: they are a *piece* of the text. Pieces are known by their anchor's
   hash and a hash of their bytes; equal pieces are one piece with a first
   owner, and the later owners' windows are repeats.
2. Pieces that share their anchor's hash with other pieces are cut out of the
   texts, once each, and dealt out by that hash: equal windows meet in one task.
3. A task takes whole groups of pieces up to ``SHARD`` bytes, sorts their
   suffixes by two-stage sorting and compares neighbours' common prefixes: runs
   of suffixes that share ``length`` bytes are equal windows. All but the
   earliest of a run are repeats.
4. A group of over ``GROUP`` pieces is not gathered in one task: its pieces
   are anchored anew by more bytes, up to whole windows, of which the earliest
   place is a minimum that is partly computed before the shuffle. So a passage
   in a third of all documents is no large task.

Edge cases: null and empty texts have no bytes; texts shorter than ``length``
lose nothing; repeated rows and repeated doc_ids are told apart by their place
(equal ids: the row that is read first is the earlier one, null ids come last);
an empty table gives an empty result; columns passed through may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tasklens.llm.common import written
from tasklens.llm.suffix_array import equal_prefixes, suffix_array

LENGTH = 100
GRAM = 24
SHARD = 2 << 20
#: Pieces of one anchor that are sorted in one task: at most about 3 MB.
GROUP = 1 << 14
#: Bytes of text that are hashed at a time (positions fit 24 bits).
CHUNK = 4 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes from each position."""
    n = len(text) - gram + 1
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(text) - 1, BASE)], dtype=np.uint64)
    total = np.cumsum(np.r_[np.uint64(0), BYTE_CODE[text] * power], dtype=np.uint64)
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE)], dtype=np.uint64)
    h = (total[gram:] - total[:n]) * back
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pieces(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Pieces of the documents that stand at ``starts`` in ``text``: anchor
    hash, first and last window start (places in ``text``) and document."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(text, gram)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)       # of the window at each place
    windows = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(starts)), windows)
    place = np.arange(len(doc)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    a = anchor[place]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return (h[a[first]], place[first], place[last], doc[first]) if len(a) else (
        none.astype(np.uint64), none, none, none)


def _parts(batches, length: int, limit: int = CHUNK):
    """(keys, texts as bytes) of about ``limit`` bytes; a longer text is cut
    into parts that share all but a byte of a window, with their offsets."""
    for b in batches:
        keys, texts = b.column(0).to_pylist(), b.column(1)
        out, size = [], 0
        for k, t in zip(keys, texts, strict=True):
            t = t.as_buffer().to_pybytes() if t.is_valid else b""
            for at in range(0, max(len(t) - length + 1, 1), limit):
                part = t[at:at + limit + length - 1] if len(t) > limit else t
                out.append((k, at, part))
                size += len(part)
                if size >= limit:
                    yield out
                    out, size = [], 0
        if out:
            yield out


def anchor_rows(parts: list, length: int, gram: int) -> pd.DataFrame:
    """Rows (h, g, k, lo, hi, repeat): pieces by anchor hash and content hash,
    with key and window starts. ``repeat``: a piece with these hashes stands
    earlier in ``parts``, so all its windows are repeats."""
    parts = sorted(parts, key=lambda p: p[:2])
    data = b"".join(p[2] for p in parts)
    sizes = np.array([len(p[2]) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    h, lo, hi, doc = pieces(np.frombuffer(data, np.uint8), starts, sizes, length, gram)
    digest = xxhash.xxh3_64_intdigest
    g = np.array([digest(data[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)],
                 np.uint64)
    repeat = pd.DataFrame({"h": h, "g": g}).duplicated().to_numpy()
    key = np.array([p[0] for p in parts], np.int64)
    shift = np.array([p[1] for p in parts], np.int64) - starts
    return pd.DataFrame({"h": h.view(np.int64), "g": g.view(np.int64), "k": key[doc],
                         "lo": lo + shift[doc], "hi": hi + shift[doc], "repeat": repeat})


def find_pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, g, k, lo, hi, repeat) of all pieces of (k, data), repeats joined."""

    def run(batches):
        for parts in _parts(batches, length):
            rows = anchor_rows(parts, length, gram)
            again = rows[rows["repeat"]]
            if len(again):      # neighbouring repeated pieces are one interval
                again = again.sort_values(["k", "lo"])
                fresh = (again["k"] != again["k"].shift()) | (again["lo"] != again["hi"].shift() + 1)
                run_of = fresh.cumsum()
                again = again.groupby(run_of, sort=False).agg(
                    {"h": "first", "g": "first", "k": "first", "lo": "first", "hi": "last", "repeat": "first"})
                # any partition will do: no hash is kept
                again["h"], again["g"] = again["k"], again["lo"]
            out = pd.concat([rows[~rows["repeat"]], again], ignore_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c].to_numpy(np.int64)) for c in ("h", "g", "k", "lo", "hi")]
                + [pa.array(out["repeat"].to_numpy(bool))], names=["h", "g", "k", "lo", "hi", "repeat"])

    return docs.select("k", "data").mapInArrow(
        run, "h long, g long, k long, lo long, hi long, repeat boolean")


def solve_shard(x: np.ndarray, sizes: np.ndarray, k: np.ndarray, lo: np.ndarray, length: int):
    """Repeated windows among pieces: (k, lo, hi) intervals. The pieces stand
    one after the other in ``x``."""
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    sa = suffix_array(x, length)
    sa = sa[sa + length <= ends[piece[sa]]]             # suffixes that hold a window
    none = np.zeros((3, 0), np.int64)
    if len(sa) < 2:
        return none
    same = equal_prefixes(x, sa[:-1], sa[1:], length)
    like = np.append(False, same) | np.append(same, False)
    run = np.cumsum(np.append(True, ~same))[like]
    sa = sa[like]
    if not len(sa):
        return none
    start = lo[piece] + np.arange(len(x)) - (ends - sizes)[piece]
    # the earliest window of a run is the smallest (k, start)
    order = np.lexsort((start[sa], k[piece[sa]], run))
    again = np.append(False, np.diff(run[order]) == 0)
    repeat = np.zeros(len(x), bool)
    repeat[sa[order[again]]] = True
    mark = np.flatnonzero(repeat)
    new = np.append(True, (np.diff(mark) > 1) | (np.diff(piece[mark]) > 0))
    first, last = mark[new], mark[np.append(new[1:], True)]
    return np.stack([k[piece[first]], start[first], start[last]])


class Pieces:
    """Rows of pieces as arrays; their bytes stand one after the other."""

    def __init__(self, h, k, lo, sizes, text):
        self.h, self.k, self.lo, self.sizes, self.text = h, k, lo, sizes, text

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Pieces:
        p = b.column(3)
        offsets = np.frombuffer(p.buffers()[1], np.int32)[p.offset:p.offset + len(p) + 1]
        data = p.buffers()[2]
        text = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
        return cls(*(b.column(i).to_numpy() for i in range(3)), np.diff(offsets).astype(np.int64), text)

    @classmethod
    def joined(cls, parts: list[Pieces]) -> Pieces:
        return cls(*(np.concatenate([getattr(p, a) for p in parts]) for a in ("h", "k", "lo", "sizes", "text")))

    def cut(self, at: int) -> tuple[Pieces, Pieces]:
        """The rows before and from ``at``."""
        b = int(self.sizes[:at].sum())
        return (Pieces(self.h[:at], self.k[:at], self.lo[:at], self.sizes[:at], self.text[:b]),
                Pieces(self.h[at:], self.k[at:], self.lo[at:], self.sizes[at:], self.text[b:]))

    def where(self, keep: np.ndarray) -> Pieces:
        return Pieces(self.h[keep], self.k[keep], self.lo[keep], self.sizes[keep],
                      self.text[np.repeat(keep, self.sizes)])


def solve_groups(rows: DataFrame, length: int, shard: int) -> DataFrame:
    """(k, lo, hi): intervals of repeated windows among pieces (h, k, lo, piece)
    whose groups of equal h are of bounded size."""

    def solve(p: Pieces):
        new = np.append(True, p.h[1:] != p.h[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(p.h)))
        p = p.where(np.repeat(count > 1, count))
        if len(p.h):
            found = solve_shard(p.text, p.sizes, p.k, p.lo, length)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["k", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Pieces] = []
        size = 0
        for b in batches:
            held.append(Pieces.of(b))
            size += len(held[-1].text)
            if size >= shard:
                p = Pieces.joined(held)
                done, rest = p.cut(int(np.argmax(p.h == p.h[-1])))  # sorted: the open group is last
                if len(done.h):
                    yield from solve(done)
                held, size = [rest], len(rest.text)
        if held:
            yield from solve(Pieces.joined(held))

    dealt = rows.repartition("h").sortWithinPartitions("h")
    return dealt.select("h", "k", "lo", "piece").mapInArrow(run, "k long, lo long, hi long")


def finer_pieces(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces (h, k, lo, piece) cut into pieces with longer anchors."""

    def run(frames):
        for f in frames:
            data = b"".join(f["piece"])
            sizes = f["piece"].str.len().to_numpy(np.int64)
            starts = np.cumsum(sizes) - sizes
            for at in range(0, len(f), 4096):
                s = slice(at, at + 4096)
                base = starts[at]
                part = np.frombuffer(data[base:base + int(sizes[s].sum())], np.uint8)
                h, lo, hi, doc = pieces(part, starts[s] - base, sizes[s], length, gram)
                raw = part.tobytes()
                yield pd.DataFrame({
                    "h": h.view(np.int64), "k": f["k"].to_numpy()[s][doc],
                    "lo": f["lo"].to_numpy()[s][doc] + lo - (starts[s] - base)[doc],
                    "piece": [raw[a:b] for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]})

    return rows.mapInPandas(run, "h long, k long, lo long, piece binary")


def repeated_windows(docs: DataFrame, length: int, gram: int, shard: int, group: int) -> DataFrame:
    """(k, lo, hi): starts of windows of (k, data) that also start earlier."""
    found = find_pieces(docs, length, gram)
    by_h = Window.partitionBy("h")
    owner = F.row_number().over(by_h.partitionBy("h", "g").orderBy("k", "lo"))
    ranked = (found.repartition("h").withColumn("owner", F.when(F.col("repeat"), 2).otherwise(owner))
              .withColumn("n", F.sum(F.when(F.col("owner") == 1, 1).otherwise(0)).over(by_h)))
    # later owners of a piece repeat it; the first goes on if other pieces share its anchor
    kept = written(ranked.filter("owner > 1 OR n > 1").select(
        "h", "k", "lo", "hi", "n", (F.col("owner") > 1).alias("repeat")))
    out = kept.filter("repeat").select("k", "lo", "hi")
    first = kept.filter("NOT repeat")

    # the texts are shuffled once here, whatever the sizes of the groups
    cut = F.substr("data", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + length).cast("int"))
    first = written(first.join(docs, "k").select("h", "k", "lo", "n", cut.alias("piece")))
    out = out.unionAll(solve_groups(first.filter(F.col("n") <= group), length, shard))
    large = first.filter(F.col("n") > group)
    if large.isEmpty():
        return out
    while True:
        gram = length if length - gram < 16 else gram + (length - gram) // 2
        rows = written(finer_pieces(large, length, gram))
        if gram == length:
            # a piece is one window: all but its earliest place are repeats
            earliest = rows.groupBy("piece").agg(F.min(F.struct("k", "lo")).alias("first"))
            again = rows.join(earliest, "piece").filter(F.struct("k", "lo") != F.col("first"))
            return out.unionAll(again.select("k", "lo", F.col("lo").alias("hi")))
        hot = rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > group).select("h")
        hot = written(hot)
        out = out.unionAll(solve_groups(rows.join(hot, "h", "left_anti"), length, shard))
        if hot.isEmpty():
            return out
        large = rows.join(hot, "h", "left_semi")


def keyed(documents: DataFrame, doc_id: str = "id") -> DataFrame:
    """The documents with a unique long ``k`` in the order of their ids.

    Unique ids are their own keys; otherwise (repeated or null ids, or ids
    that are no integers) the rows are numbered in order and written down.
    """
    order = F.col(doc_id).asc_nulls_last()
    if documents.schema[doc_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        n = documents.select(doc_id).groupBy(doc_id).agg(F.count("*").alias("n"))
        if n.filter(F.col(doc_id).isNull() | (F.col("n") > 1)).isEmpty():
            return documents.withColumn("k", F.col(doc_id).cast("long"))
    ordered = (documents.withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(order, "place").sortWithinPartitions(order, "place").drop("place"))
    return written(ordered.withColumn("k", F.monotonically_increasing_id()))


def _cut(documents, keep, clean, length, gram=GRAM, shard=SHARD, group=GROUP) -> DataFrame:
    """The kept columns by place (without the text, if ``clean``) and the
    struct ``got`` of the figures and the remaining text."""
    docs = keyed(documents.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep) if c != "text"]))
    docs = docs.filter("k IS NOT NULL").drop("id")
    spans = repeated_windows(docs.select("k", "data"), length, gram, shard, group)
    # at most one interval for each window of a document
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * clean

    @F.pandas_udf(out)
    def apply(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for d, s in zip(data, spans, strict=True):
            d, kept, at, removed = bytes(d), [], 0, 0
            runs = joined(s, length)
            for lo, hi in runs:
                kept.append(d[at:lo])
                at, removed = hi, removed + hi - lo
            rest = b"".join([*kept, d[at:]])
            row = (len(d), removed, len(runs), hashlib.sha256(rest).hexdigest())
            rows.append((*row, rest.decode("utf-8", "ignore")) if clean else row)
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256",
                                           *["text"] * clean])

    return docs.join(spans, "k", "left").withColumn("got", apply("data", "spans"))


def remove_repeats(documents: DataFrame, keep: list[str], length: int = LENGTH, **limits) -> DataFrame:
    """Columns ``keep`` of every document with n_bytes, n_removed, n_spans
    (maximal removed runs) and kept_sha256 of the remaining bytes."""
    got = _cut(documents, keep, False, length, **limits)
    return got.select(*[(F.col("data").cast("string") if c == "text" else F.col(f"c{i}")).alias(c)
                        for i, c in enumerate(keep)],
                      *[F.col(f"got.{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def deduplicate(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with the remaining text (``n_chars`` follows). What a cut
    leaves of a character is dropped, and a null text becomes empty."""
    cols, text = documents.columns, F.col("got.text")
    got = _cut(documents, cols, True, length)

    def column(i, c):
        if c == "text":
            return text
        if c == "n_chars":
            return F.when(F.col("got.n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(f"c{i}"))
        return F.col(f"c{i}")

    return got.select(*[column(i, c).alias(c) for i, c in enumerate(cols)])


def joined(spans, length: int) -> list[tuple[int, int]]:
    """Byte intervals covered by intervals of window starts, in order."""
    out: list[tuple[int, int]] = []
    if spans is None:
        return out
    for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
