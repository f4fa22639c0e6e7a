"""Benchmark decontamination with an FM-index per shard of the documents.

Every window of ``WINDOW`` consecutive item words (the whole item, if shorter)
is a test phrase. Documents are read in shards; each shard's words are
indexed, all phrases are searched backwards through wavelet-tree ranks, the
occurrences are located by sampled suffix positions, and overlapping hits are
merged into removal spans. A word that is in no item, and a run of words that
is shorter than the shortest phrase, cannot be part of an occurrence: they are
the index's separators. No shuffle is needed, and a frequent passage only
makes its own shards longer to read.

Items are dealt to blocks of at most ``BLOCK_BYTES`` of text by size; each
block is a pass of its own, so what is sent to the tasks is bounded however
large the benchmark is.

Edge cases: null and empty texts have no words and are never hit; null items
and items without words are ignored; repeated items count once (by item_id);
an item with a null item_id removes words but is not listed; empty tables give
no hits; the documents' columns are passed through by position, so further
columns may have any name other than those that the scan adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklens.llm.common import WORD_BYTES, checkpointed, renamed, utf8
from tasklens.llm.fm_index import FMIndex

WINDOW = 10
#: Symbols of one index, and bytes of text that a task holds for it.
SHARD = 1 << 19
SHARD_BYTES = 16 << 20
#: Bytes of benchmark text that are searched in one pass.
BLOCK_BYTES = 8 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))


def words_of(text) -> list[bytes]:
    return utf8(text).translate(WORD_BYTES).split()


class Phrases:
    """Distinct test phrases of some items, as symbols of their vocabulary."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        phrases: dict[tuple, set] = {}
        for item, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            for i in range(max(len(w) - window + 1, min(len(w), 1))):
                phrases.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.sigma = len(self.vocab) + 1
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.table = np.zeros((len(phrases), window), np.int64)
        for k, p in enumerate(phrases):
            self.table[k, window - len(p):] = p
        self.items = [sorted(i for i in s if i is not None) for s in phrases.values()]
        self.least = int(self.size.min()) if phrases else 0


def runs_of(ids: np.ndarray, least: int, shard: int, overlap: int):
    """(starts, lengths) of the runs of known words, in pieces of at most
    ``shard`` words that share ``overlap`` words with the next one."""
    known = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
    start, end = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
    keep = end - start >= least
    start, end = start[keep], end[keep]
    if len(start) and (end - start).max() > shard:
        cut = [(s, e) if e - s <= shard else (p, min(p + shard, e))
               for s, e in zip(start.tolist(), end.tolist(), strict=True)
               for p in (range(s, max(e - overlap, s + 1), shard - overlap) if e - s > shard else (s,))]
        start, end = (np.array(x, np.int64) for x in zip(*cut, strict=True))
    return start, end - start


def search_shards(ids: np.ndarray, phrases: Phrases, shard: int):
    """(position, phrase) of all occurrences in ``ids`` (0: unknown or border)."""
    window = phrases.table.shape[1]
    start, size = runs_of(ids, phrases.least, shard - 1, window - 1)
    found = []
    bucket = np.cumsum(size + 1) // shard if len(size) else size
    for k in np.unique(bucket):
        s, z = start[bucket == k], size[bucket == k]
        # place in ids of every symbol of the index; a run is followed by its separator
        offset = np.cumsum(z + 1) - (z + 1)
        place = np.arange(int((z + 1).sum())) + np.repeat(s - offset, z + 1)
        text = ids[np.minimum(place, len(ids) - 1)]
        text[offset + z] = 0
        index = FMIndex(text, phrases.sigma)
        lo, hi = index.search(phrases.table, phrases.size)
        n = np.maximum(hi - lo, 0)
        rows = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        found.append((place[index.locate(rows)], np.repeat(np.arange(len(n)), n)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scan_texts(texts: list, phrases: Phrases, shard: int = SHARD):
    """Per text: number of words, merged hit spans (in words), found item ids."""
    get, zeros = phrases.vocab.get, [0] * 4096
    n_words, parts = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        w = words_of(t)
        n_words[i] = len(w)
        while len(zeros) < len(w):
            zeros = zeros * 2
        parts.append(np.array(list(map(get, w, zeros)), np.int64))
        parts.append(np.zeros(1, np.int64))
    first = np.cumsum(n_words + 1) - (n_words + 1)
    spans, items = [[] for _ in texts], [set() for _ in texts]
    if not len(phrases.size) or not texts:
        return n_words, spans, items
    ids = np.concatenate(parts)
    at, which = search_shards(ids, phrases, shard)
    if not len(at):
        return n_words, spans, items
    doc = np.searchsorted(first, at, side="right") - 1
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.size[which], -1)
    hit = np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]]))
    for lo, hi in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1), strict=True):
        d = int(np.searchsorted(first, lo, side="right") - 1)
        spans[d].append((int(lo - first[d]), int(hi - first[d])))
    for d, k in np.unique(np.stack([doc, which], 1), axis=0).tolist():
        items[d].update(phrases.items[k])
    return n_words, spans, items


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each
    span; what stood around a span is joined by a space."""
    if not spans:
        return text
    raw = utf8(text)
    flags = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(raw[at:start[lo]])
        at = end[hi - 1]
    kept.append(raw[at:])
    return b" ".join(x.strip() for x in kept if x.strip()).decode("utf-8", "surrogatepass")


def _chunks(batches, text_at: int, limit: int):
    """Slices of record batches with their texts, of about ``limit`` bytes."""
    for b in batches:
        texts, lo, size = b.column(text_at).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= limit:
                yield b.slice(lo, i + 1 - lo), texts[lo:i + 1]
                lo, size = i + 1, 0
        if lo < len(texts):
            yield b.slice(lo), texts[lo:]


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark's items (id as a string, text) in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(
        "text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-2 * total // limit)          # hashed blocks fill unevenly
    if n <= 1:
        return [items] if total else []
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def scan(documents: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW,
         clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of every document, n_words, spans (merged hit words
    [lo, hi)) and items (found item ids, sorted as strings).

    ``clean`` removes the spans from the column ``text`` as well (it must be
    in ``keep``).
    """
    out = _scan(documents, benchmark, keep, window, clean, block_bytes)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_words", "spans", "items")


def _scan(documents, benchmark, keep, window, clean, block_bytes=BLOCK_BYTES) -> DataFrame:
    """scan with the kept columns by place."""
    out = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)],
                           F.col("text").alias("t"), F.lit(0).cast("long").alias("n_words"),
                           F.array().cast(SPANS).alias("spans"),
                           F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(benchmark, block_bytes)
    at = {c: i for i, c in enumerate(out.columns)}
    cleaned = keep.index("text") if clean else -1
    if not blocks:      # words are counted all the same
        blocks = [None]
    for k, block in enumerate(blocks):
        items = [] if block is None else [tuple(r) for r in block.collect()]    # bounded by block_bytes
        last = k == len(blocks) - 1
        fields = [f for f in out.schema.fields if f.name != "t" or not last]

        def run(batches, items=items, last=last, names=[f.name for f in fields]):
            phrases = Phrases(items, window)
            for b, texts in _chunks(batches, at["t"], SHARD_BYTES):
                n_words, spans, found = scan_texts(texts, phrases)
                old_s, old_i = b.column(at["spans"]).to_pylist(), b.column(at["items"]).to_pylist()
                spans = [merged(s + [(x["lo"], x["hi"]) for x in o]) for s, o in zip(spans, old_s, strict=True)]
                found = [sorted(s.union(o)) for s, o in zip(found, old_i, strict=True)]
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                cols["n_words"] = pa.array(n_words)
                cols["spans"] = pa.array([[{"lo": x, "hi": y} for x, y in s] for s in spans],
                                         b.schema.field(at["spans"]).type)
                cols["items"] = pa.array(found, b.schema.field(at["items"]).type)
                if last and cleaned >= 0:
                    cols[f"c{cleaned}"] = pa.array(
                        [without_spans(t, s) for t, s in zip(texts, spans, strict=True)],
                        b.schema.field(cleaned).type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

        out = out.mapInArrow(run, T.StructType(fields))
        if not last:
            out = checkpointed(out)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every occurrence of a test phrase cut out of their
    text (documents without one stay as they are; ``n_chars`` follows)."""
    cols = documents.columns
    out = _scan(documents, benchmark, cols, window, clean=True)
    if "n_chars" in cols:
        n, text = (f"c{cols.index(c)}" for c in ("n_chars", "text"))
        out = out.withColumn(n, F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col(n)))
    return renamed(out, cols)
