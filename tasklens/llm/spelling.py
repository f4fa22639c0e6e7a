"""Spelling variants grouped by blocked Gram matrices.

Words are the runs of letters that occur often enough over all documents; each
text is counted in its task, so only sums of words are shuffled. Two words one
edit apart (one code point inserted, deleted or replaced) have letter counts
at a squared distance of 1, at adjacent lengths, or 2, at the same length.

A block holds the words of one length with the same counts of ``GROUPS`` groups
of letters (the groups are balanced by the letters' frequencies). A word one
edit away lies in the same block, or in one that differs by one letter more in
one group, or by one less in a group and one more in another, so only such
blocks meet. A block is cut into chunks of at most about ``CELLS`` code points,
which are the rows of a small table; every pair of chunks is solved by itself:
the product of their letter-count matrices gives all squared distances, pairs
at more than two are out (as are anagrams, at zero), and the rest are verified
on the code points. A chunk pair returns sums by word, never the pairs.

A word's form is its near word of largest n (ties: smallest in code-point
order) if that is at least ``RATIO`` times the word's own; roots are found by
pointer jumping over the forms, which cannot form a circle, as n grows.

A null text has no words; of a row with a null id no letter is deleted. Very
long texts are counted like others; a very long word is a chunk of its own.
Rows that are repeated count each time, an empty table gives an empty result.
Only the id and the text are read; other columns may have any name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import utf8, written

GROUPS = 5
CELLS = 1 << 15       # code points of a chunk of words (a word shorter than 16 counts as 16)
FLUSH = 1 << 19       # distinct words that a task counts before it gives them on
VERIFY = 1 << 16      # candidate pairs verified at once
RATIO = 2

#: The letters of the runs: lower-case ASCII, and U+00C0 to U+00FF as UTF-8.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))


def spoiled(run: bytes, h: int) -> bytes:
    """The run without its code point ``h % length``."""
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def counted_words(docs: DataFrame, spoil: int | None, shortest: int, least: int,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs with at least ``shortest`` code points and ``least``
    occurrences. With ``spoil``, a run whose crc32 of ``doc_id:run`` it divides
    has lost a letter."""
    def count(batches):
        total: dict[bytes, int] = {}

        def counts():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["word", "n"])

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[bytes, int] = {}
                for w in RUN.findall(utf8(t).lower()):  # bytes.lower() changes A-Z only
                    own[w] = own.get(w, 0) + 1
                start = zlib.crc32(f"{key}:".encode())
                for w, n in own.items():
                    if len(w) < shortest:
                        continue
                    if spoil and key is not None:
                        h = zlib.crc32(w, start)
                        if h % spoil == 0:
                            w = spoiled(w, h)
                    if len(w) >= shortest and (w.isascii() or len(w.decode()) >= shortest):
                        total[w] = total.get(w, 0) + n
                if len(total) >= FLUSH:
                    yield counts()
                    total.clear()
        if total:
            yield counts()

    return (docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def letter_groups(words: DataFrame) -> list[str]:
    """The letters in groups of about equal frequency: the most frequent letter
    first, each to the group that has least so far. At most one row a letter
    reaches the driver."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()
    groups, load = [""] * GROUPS, [0] * GROUPS
    for r in sorted(rows, key=lambda r: (-r["count"], r["c"])):
        g = load.index(min(load))
        groups[g] += r["c"]
        load[g] += r["count"]
    return groups


def chunked(words: DataFrame, groups: list[str]) -> DataFrame:
    """(block, chunk, members): words of equal counts by group, in pieces."""
    def held(letters: str) -> Column:
        return F.length("word") - F.length(F.translate("word", letters, ""))

    keyed = words.withColumn("block", F.array(*[held(g) for g in groups]))
    width = F.greatest(F.length("word"), F.lit(16))
    sizes = keyed.groupBy("block").agg(F.ceil(F.sum(width) / CELLS).alias("pieces"))
    placed = keyed.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("word"), "pieces"))
    return placed.groupBy("block", "chunk").agg(F.collect_list(F.struct("word", "n")).alias("members"))


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(block, chunk, block2, chunk2) of chunks whose words may be one edit
    apart, each pair once: in one block; in a block with one letter more; with
    one letter less in a group and one more in a later one."""
    def moved(less: int | None, more: int) -> Column:
        return F.transform("block", lambda x, i: x + F.when(i == more, 1).when(i == F.lit(less), -1).otherwise(0))

    changes = [F.col("block")] + [moved(None, g) for g in range(GROUPS)]
    changes += [moved(a, b) for a in range(GROUPS) for b in range(a + 1, GROUPS)]
    ids = chunks.select("block", "chunk")
    left = ids.withColumn("block2", F.explode(F.array(*changes)))
    right = ids.select(F.col("block").alias("block2"), F.col("chunk").alias("chunk2"))
    return left.join(right, "block2").filter("block <> block2 OR chunk <= chunk2").select(
        "block", "chunk", "block2", "chunk2")


class Chunk:
    """Code points and letter counts of words of one length."""

    def __init__(self, members: pa.StructArray):
        self.words = members.field(0).to_pylist()
        self.n = members.field(1).to_numpy()
        flat = np.frombuffer("".join(self.words).encode("utf-32-le"), "<u4")
        self.points = flat.reshape(len(self.words), -1)
        self.order = np.empty(len(self.words), np.int64)
        self.order[np.argsort(np.array(self.words, object), kind="stable")] = np.arange(len(self.words))
        # exact in single precision as long as squares of counts are below 2^24
        kind = np.float32 if self.points.shape[1] < 4096 else np.float64
        cells = (np.arange(len(self.words))[:, None] * 256 + self.points).ravel()
        self.counts = np.bincount(cells, minlength=256 * len(self.words)).reshape(-1, 256)[:, USED].astype(kind)
        self.square = (self.counts ** 2).sum(axis=1)


USED = np.array([ord(c) for c in LETTERS])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points are one edit apart; b's are as long or one longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    head, tail = a != b[:, :n], a != b[:, 1:]
    same = np.where(head.any(axis=1), head.argmax(axis=1), n)
    rest = np.where(tail.any(axis=1), tail[:, ::-1].argmax(axis=1), n)
    return same + rest >= n


def near_in(a: Chunk, b: Chunk, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that are one edit apart; ``own``: b is a."""
    distance = a.square[:, None] + b.square - 2 * (a.counts @ b.counts.T)
    i, j = np.nonzero((distance <= 2) & (distance > 0))
    if own:
        keep = i < j
        i, j = i[keep], j[keep]
    good = [one_edit(a.points[i[k:k + VERIFY]], b.points[j[k:k + VERIFY]]) for k in range(0, len(i), VERIFY)]
    good = np.concatenate([*good, np.empty(0, bool)])
    return i[good], j[good]


def best_of(a: Chunk, b: Chunk, i: np.ndarray, j: np.ndarray) -> tuple[list, ...]:
    """Words of a with their number of pairs and their best partner in b."""
    order = np.lexsort((b.order[j], -b.n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    count = np.diff(np.append(first, len(i)))
    return ([a.words[x] for x in i[first]], count.tolist(), b.n[j[first]].tolist(), [b.words[x] for x in j[first]])


def near_words(batches):
    """(word, n_near, other_n, other) by chunk pair."""
    for batch in batches:
        for k in range(batch.num_rows):
            sides = [batch.column(c).slice(k, 1).flatten() for c in (0, 1)]
            own = batch.column(2)[k].as_py()
            a = Chunk(sides[0])
            b = a if own else Chunk(sides[1])
            i, j = near_in(a, b, own)
            if not len(i):
                continue
            out = [x + y for x, y in zip(best_of(a, b, i, j), best_of(b, a, j, i), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                names=["word", "n_near", "other_n", "other"])


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n_near, other_n, other) of all words that have a near one."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = written(chunked(words, letter_groups(words)))
    left = chunks.withColumnRenamed("members", "a")
    right = chunks.select(F.col("block").alias("block2"), F.col("chunk").alias("chunk2"), F.col("members").alias("b"))
    # dealt out by number: few bytes, much work
    pairs = chunk_pairs(chunks).join(left, ["block", "chunk"]).repartition(n, "block2", "chunk2")
    solved = pairs.join(right, ["block2", "chunk2"]).select(
        "a", "b", ((F.col("block") == F.col("block2")) & (F.col("chunk") == F.col("chunk2"))).alias("own"))
    found = solved.mapInArrow(near_words, "word string, n_near long, other_n long, other string")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), "other"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.m")).alias("other_n"), F.col("best.other").alias("other"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: pointers twice as long each round."""
    p = written(forms.select("word", F.col("form").alias("root")))
    while True:
        up = p.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = written(p.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), "up"))
        p = step.select("word", "root")
        if step.filter("up IS NOT NULL").isEmpty():
            return p


def spelling_variants(docs: DataFrame, spoil: int | None = None, shortest: int = 5, least: int = 3,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all documents."""
    words = written(counted_words(docs, spoil, shortest, least, doc_id, text))
    table = words.join(near_counts(words), "word", "left")
    is_form = F.col("other_n") >= RATIO * F.col("n")
    table = written(table.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n")))
    ends = roots(table.filter("form IS NOT NULL"))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
