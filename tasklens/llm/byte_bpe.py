"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

The encoder's pattern splits a text into words. Every distinct word of the
corpus is merged once, by a numpy kernel over the words of a sorted partition: a
word's bytes are a row of piece ids, and each step joins the leftmost pair of least
rank in every word that still has one and looks up the two ranks that this changes,
until no neighbours join into a known piece.

Documents are read in blocks of about ``BLOCK`` characters (or one longer
document). A block holds its distinct words and each document as numbers of
them, compressed. A word's rows, one for each block that holds it, meet in one
task and come back to their blocks with its ids, packed by task and block, so no text and no word of a
document is shuffled by itself. Decoding concatenates the ids' binary pieces.

A null text counts as empty and has no ids. Words of over ``LONG`` bytes, for
which these steps are quadratic, are merged by a heap with the same rule (leftmost pair of least rank). Long texts are whole blocks of their
own. Repeated rows and null ids are kept, each with its ids. An empty table
gives an empty result. No special token is known. Ids that are no piece of the
vocabulary, or null ids, decode to null. Of the other columns only those named
in ``by`` are read; their names may be anything.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 25       # characters of a block's documents
LONG = 256            # bytes of a word that is still merged by steps
NONE = (1 << 31) - 1  # rank of what is no piece


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file (base64 piece and rank in a line).

    The file is one of the driver's; what is read is as large as the vocabulary.
    """
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap of pairs (rank, place) over linked pieces."""
    n = len(word)
    end, last, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def push(i):
        j = end[i]
        if j < n:
            r = ranks.get(word[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two pieces has grown meanwhile
        end[i], alive[j] = stop, False
        if stop < n:
            last[stop] = i
        push(i)
        if last[i] >= 0:
            push(last[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Pairs:
    """Which two pieces join, and into which rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {ranks[p[:i]] << 32 | ranks[p[i:]]: r for p, r in ranks.items()
                 for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        size = 1 << (4 * len(pairs) + 4).bit_length()
        self.shift = np.uint64(65 - size.bit_length())
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):                                # open addressing: the first of a slot takes it
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            took = free[one]
            self.keys[at[took]] = keys[left[took]]
            self.ranks[at[took]] = [pairs[k] for k in keys[left[took]].tolist()]
            rest = np.ones(len(left), bool)
            rest[took] = False
            left, at = left[rest], (at[rest] + 1) % size

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the joined pieces, ``NONE`` of those that do not join; an id below
        zero is no piece."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = key[todo]
        at = self.slot(key)
        while len(todo):
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (found >= 0)
            todo, key, at = todo[more], key[more], (at[more] + 1) % len(self.keys)
        return out


def merge_words(data: np.ndarray, size: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all ids) of words of ``size`` bytes, none empty, whose
    bytes follow each other in ``data``."""
    start = np.cumsum(size) - size
    count = np.empty(len(size), np.int64)
    lengths = np.unique(size)
    parts, rows = [], []
    for low, high in zip(np.append(0, lengths), lengths):
        which = np.flatnonzero((size > low) & (size <= high))
        step = max((1 << 20) // int(high), 1)
        for k in range(0, len(which), step):
            some = which[k:k + step]
            ids = pairs.byte[data[start[some][:, None] + np.arange(high)]]
            n = merged_rows(ids, pairs)
            count[some] = n
            rows.append(some)
            parts.append(ids[np.arange(high) < n[:, None]])
    if not rows:
        return count, np.empty(0, np.int32)
    rows, flat = np.concatenate(rows), np.concatenate(parts)
    n = count[rows]
    here = np.empty(len(rows), np.int64)
    here[rows] = np.cumsum(n) - n
    take = np.repeat(here - (np.cumsum(count) - count), count) + np.arange(len(flat))
    return count, flat[take]


def merged_rows(ids: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Merge words of equal length in place, a row of piece ids each; the number of ids
    that are left at the beginning of each row."""
    n, width = ids.shape
    left = np.full(n, width, np.int64)
    ranks = np.full((n, width), NONE, np.int32)
    ranks[:, :-1] = pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    row, a, r = np.arange(n), ids.copy(), ranks
    while len(row):
        at = r.argmin(axis=1)
        lines = np.arange(len(row))
        least = r[lines, at]
        going = least < NONE
        if not going.all():                              # these are done
            ids[row[~going]] = a[~going]
            row, a, r, at, least = row[going], a[going], r[going], at[going], least[going]
            lines = np.arange(len(row))
            if not len(row):
                break
        left[row] -= 1
        # what stands behind the joined pair moves up
        source = np.arange(width) + (np.arange(width) > at[:, None])
        np.minimum(source, width - 1, out=source)
        a, r = np.take_along_axis(a, source, 1), np.take_along_axis(r, source, 1)
        a[lines, at] = least
        a[:, -1], r[:, -1] = -1, NONE
        after = np.where(at + 1 < width, a[lines, np.minimum(at + 1, width - 1)], -1)
        r[lines, at] = pairs.rank(least, after)
        some = np.flatnonzero(at > 0)
        r[some, at[some] - 1] = pairs.rank(a[some, at[some] - 1], least[some])
    return left


class Blocks:
    """Rows of blocks from batches of documents (key columns, then the text)."""

    def __init__(self, task: int, pattern: str):
        import regex
        self.split = regex.compile(pattern).findall
        self.number = task << 32
        self.fresh()

    def fresh(self):
        self.places: defaultdict = defaultdict()
        self.places.default_factory = self.places.__len__
        self.chars, self.parts, self.keys = 0, [], []

    def add(self, text: str):
        words = self.split(text)
        self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.uint32, len(words)))
        self.chars += len(text)

    def row(self) -> pa.RecordBatch:
        """The block's row; a fresh one begins."""
        keys = pa.Table.from_batches(self.keys).combine_chunks()
        structs = pa.StructArray.from_arrays(
            [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in keys.columns],
            fields=list(keys.schema))
        flat = np.concatenate([*self.parts, np.empty(0, np.uint32)])
        # frequent words get small numbers, which compress well
        order = np.argsort(-np.bincount(flat, minlength=len(self.places)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        words = list(self.places)
        data = [words[i].encode() for i in order]
        packed = [packed_ints(np.array([len(p) for p in self.parts])), packed_ints(number[flat]),
                  packed_ints(np.array([len(w) for w in data])), pa.compress(b"".join(data), codec="zstd", asbytes=True)]
        sizes = [len(self.parts), len(flat), len(data), sum(map(len, data))]
        out = [pa.array([self.number], pa.int64()), pa.array([sizes], pa.list_(pa.int64())),
               pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), structs),
               *[pa.array([x], pa.binary()) for x in packed]]
        self.number += 1
        self.fresh()
        return pa.RecordBatch.from_arrays(out, names=["block", "sizes", "keys", *PACKED])


#: Compressed parts of a block: words of each document, the documents' words by
#: number, lengths of the words, their bytes.
PACKED = ["lengths", "flat", "word_lengths", "word_bytes"]


def packed_ints(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their lowest bytes first, compressed."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked_ints(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, "<u4")
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def word_blocks(docs: DataFrame, by: list[str], pattern: str, text: str) -> DataFrame:
    """Rows of blocks: number, compressed documents and distinct words."""
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)], F.col(text).alias("text"))
    size = BLOCK

    def build(batches):
        from pyspark import TaskContext
        blocks = Blocks(TaskContext.get().partitionId(), pattern)
        for batch in batches:
            keys, done = batch.select(batch.schema.names[:-1]), 0
            for k, t in enumerate(batch.column(batch.num_columns - 1), 1):
                blocks.add(t.as_py() or "")
                if blocks.chars >= size:
                    blocks.keys.append(keys.slice(done, k - done))
                    yield blocks.row()
                    done = k
            if done < batch.num_rows:
                blocks.keys.append(keys.slice(done))
        if blocks.parts:
            yield blocks.row()

    keys = T.StructType(rows.schema.fields[:-1])
    return rows.mapInArrow(build, T.StructType([
        T.StructField("block", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(keys)), *[T.StructField(c, T.BinaryType()) for c in PACKED]]))


def listed_words(batches):
    """(block, place, word) of block rows."""
    for batch in batches:
        for r in batch.select(["block", "sizes", *PACKED[2:]]).to_pylist():
            n, size = r["sizes"][2:]
            if not n:
                continue
            ends = np.concatenate([[0], np.cumsum(unpacked_ints(r["word_lengths"], n), dtype=np.int64)])
            data = pa.decompress(r["word_bytes"], size, codec="zstd")
            words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), data).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["block"])), pa.array(np.arange(n, dtype=np.int32)), words],
                names=["block", "place", "word"])


def words_together(words: DataFrame) -> DataFrame:
    """(block, place, word) with the rows of a word, one for each block that holds it, one
    after the other in one task."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by number: the words are few bytes but much work, and would be coalesced
    return words.repartition(n, "word").sortWithinPartitions("word")


def with_ids(batches, pairs: Pairs):
    """(block, place, ids, long) of rows (block, place, word) that are sorted by word: the
    merges of a word are made at the first of its rows in a batch. A word of over
    ``LONG`` bytes has no ids yet, but stands in ``long``."""
    for b in batches:
        if not b.num_rows:
            continue
        word = b.column(2).cast(pa.large_binary())
        ends = np.frombuffer(word.buffers()[1], np.int64)[word.offset:][:len(word) + 1]
        size = np.diff(ends)
        new = np.append(True, np.asarray(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1))))
        long = size > LONG
        some = np.flatnonzero(new & ~long)
        data = np.frombuffer(word.buffers()[2] or b"", np.uint8)
        take = np.repeat(ends[some] - (np.cumsum(size[some]) - size[some]), size[some])
        count, ids = merge_words(data[take + np.arange(len(take))], size[some], pairs)
        start = np.cumsum(count) - count
        of = np.cumsum(new & ~long) - 1                 # the word of each row
        each = np.zeros(len(size), np.int64)
        each[~long] = count[of[~long]]
        stop = np.cumsum(each)
        begin = np.zeros(len(size), np.int64)
        begin[~long] = start[of[~long]]
        take = np.repeat(begin - (stop - each), each) + np.arange(int(stop[-1]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(ids[take], pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), lists, word.take(pa.array(np.arange(len(word)), mask=~long)).cast(pa.binary())],
            names=["block", "place", "ids", "long"])


#: Rows of words that a task packs at once.
PACK_ROWS = 1 << 19


def packed_by_block(batches, ranks: dict[bytes, int]):
    """(block, [words, ids], places, counts, ids) of rows (block, place, ids, long): the
    words that a task has for a block as compressed numbers, ``PACK_ROWS`` rows at a
    time; long words are merged here. Row by row most of what goes back to the
    blocks would be the rows' own frame."""
    held, rows = [], 0

    def packs():
        block = np.concatenate([b for b, _, _, _ in held])
        place = np.concatenate([p for _, p, _, _ in held])
        count = np.concatenate([c for _, _, c, _ in held])
        values = np.concatenate([v for _, _, _, v in held])
        start = np.cumsum(count) - count
        order = np.lexsort((place, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for at in np.split(order, cuts):
            n = count[at]
            take = np.repeat(start[at] - np.cumsum(n) + n, n)
            ids = values[take + np.arange(len(take))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[at[:1]]), pa.array([[len(at), len(ids)]], pa.list_(pa.int64())),
                 *[pa.array([packed_ints(x)], pa.binary()) for x in (np.diff(place[at], prepend=0), n, ids)]],
                names=["block", "sizes", *PACKED_IDS])

    for b in batches:
        for i in np.flatnonzero(np.asarray(b.column(3).is_valid())).tolist():
            ids = np.array(merge_long(b.column(3)[i].as_py(), ranks), np.int32)
            held.append((b.column(0)[i:i + 1].to_numpy(), b.column(1)[i:i + 1].to_numpy(), np.array([len(ids)]), ids))
        b = b.filter(b.column(3).is_null())
        ids = b.column(2)
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.int64),
                     ids.flatten().to_numpy()))
        rows += b.num_rows
        if rows >= PACK_ROWS:
            yield from packs()
            held, rows = [], 0
    if any(len(b) for b, _, _, _ in held):
        yield from packs()


#: Compressed parts of the words of a block: distances of their places, numbers of their ids, the ids.
PACKED_IDS = ["places", "counts", "ids"]


def unpacked_words(known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, numbers of ids, ids) of the packed rows of a block."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4"))]
    for r in known.to_pylist():
        n, n_ids = r["sizes"]
        places, counts = (unpacked_ints(r[c], n).astype(np.int64) for c in PACKED_IDS[:2])
        parts.append((np.cumsum(places), counts, unpacked_ints(r["ids"], n_ids)))
    place, count, ids = zip(*parts, strict=True)
    return np.concatenate(place), np.concatenate(count), np.concatenate(ids)


def encode(docs: DataFrame, by: list[str], ranks: dict[bytes, int], pattern: str, text: str = "text",
           ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns ``by`` and the ids, little-endian unsigned 32-bit integers
    in one binary value; with ``decoded`` also a column of that name, the bytes
    that these ids decode to (as ``decode`` gives them, without a pass of its own).

    ``docs`` must give the same rows in the same order when it is read again, as
    a table does; write the result of a shuffle to a table first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = word_blocks(docs, by, pattern, text).repartition(n, "block")
    # two readers of one exchange: a function keeps Spark from pruning its columns
    words = blocks.mapInArrow(listed_words, "block long, place int, word string")
    pairs = Pairs(ranks)
    merged = words_together(words).mapInArrow(
        lambda batches: packed_by_block(with_ids(batches, pairs), ranks), "block long, sizes array<bigint>, " + ", ".join(f"{c} binary" for c in PACKED_IDS))
    names = [f"c{i}" for i in range(len(by))]
    pieces_of = {rank: piece for piece, rank in ranks.items()} if decoded else None
    kinds = [docs.schema[c].dataType for c in by]

    results = ["ids", "decoded"] if decoded else ["ids"]

    def assemble(block: pa.Table, known: pa.Table) -> pa.Table:
        place, count, values = unpacked_words(known)
        size = np.empty(len(place), np.int64)
        start = np.empty(len(place), np.int64)
        size[place] = count
        start[place] = np.cumsum(count) - count
        out = []
        for i in range(block.num_rows):
            row = block.slice(i, 1)
            keys = row.column("keys").combine_chunks()
            keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten()
            n_docs, n_words, _, _ = row.column("sizes")[0].as_py()
            lengths = unpacked_ints(row.column("lengths")[0].as_py(), n_docs)
            flat = unpacked_ints(row.column("flat")[0].as_py(), n_words)
            texts, at = [], 0
            for n in lengths.tolist():
                w = flat[at:at + n]
                at += n
                take = np.repeat(start[w] - np.cumsum(size[w]) + size[w], size[w])
                texts.append(values[take + np.arange(len(take))].tobytes())
            columns = [pa.array(texts, pa.binary())]
            if pieces_of:
                columns.append(pa.array([joined_pieces(t, pieces_of) for t in texts], pa.binary()))
            out.append(pa.Table.from_arrays([*keys.flatten(), *columns], names=[*names, *results]))
        return pa.concat_tables(out)

    fields = [T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]
    out = (blocks.groupBy("block").cogroup(merged.groupBy("block"))
           .applyInArrow(assemble, T.StructType([*fields, *[T.StructField(c, T.BinaryType()) for c in results]])))
    return out.toDF(*by, ids, *([decoded] if decoded else []))


def joined_pieces(data: bytes, pieces: dict[int, bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(data, "<u4").tolist()))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of binary ids: their pieces, concatenated."""
    pieces = {rank: piece for piece, rank in ranks.items()}

    @F.pandas_udf("binary")
    def joined(column: pd.Series) -> pd.Series:
        def text(data):
            if data is None or len(data) % 4:
                return None
            try:
                return joined_pieces(data, pieces)
            except KeyError:
                return None
        return column.map(text)
    return joined(ids)
