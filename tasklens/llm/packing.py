"""Lexical retrieval packing.

Documents are turned into token ids once and written down, with the document
frequencies of all tokens over the whole corpus. They are ordered by their
weightiest tokens, so that like documents meet (a frequent token's documents are
spread over ranges), and tasks take them in shards. Whole
windows of a long document are sequences of their own; what is
left of each document is packed: the longest unused rest is a seed, a BM25
inverted index of the shard returns its unused neighbours by the score of all
its tokens, and these fill the seed's window in turn. The last one is cut to fit and its end stays
unused, so windows are full; what is left at the end of a task is cut into
sequences of a power of two tokens, which need no padding.

Token ids come from a byte-level BPE file of the tokenizers library (its path
is a parameter). Latin texts are cut into the pieces of the splitting pattern, many
texts at once, and tiktoken encodes each distinct piece of these from the same
vocabulary, which gives the same ids many times faster; texts with other characters
or with a special token's string go through tokenizers itself.

Edge cases: null and empty texts are the end token alone; repeated rows are
packed one by one; a text longer than a shard is a shard; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import json
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import written

WINDOW = 1024
END = 0
SHARD_TOKENS = 1 << 20
RANGE_SHARDS = 8        # shards of a task
SAMPLE = 64             # documents for each task whose order gives the tasks' bounds
NEAREST = 64            # neighbours fetched at a time; more follow when these are used up
K1, B = 1.2, 0.75
#: Splitting pattern of the byte-level BPE of GPT-2 (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = 0x280           # characters below it are cut here, whatever the libraries' Unicode versions
PIECE_BYTES = 4 << 20   # of texts whose distinct pieces are encoded together
KEPT_PIECES = 1 << 18   # whose ids a task keeps,
KEPT_LENGTH = 64        # of at most so many characters

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Kind of every character below ``LATIN`` in the splitting pattern.
KINDS = np.array([SPACE if c in (*range(9, 14), 32, 0x85, 0xA0) else
                  {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
                  for c in range(LATIN)], np.uint8)

_ENCODERS: dict = {}


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a tokenizers file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.slow, self.kept = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.slow.get_vocab_size()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        letters, self.fast = byte_letters(), None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        # the ids must be the order of the merges, and the splitting the usual one
        if (made == sorted(made) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and not spec.get("normalizer")):
            ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def latin(self, text) -> bool:
        return bool(self.fast and np.frombuffer(text.encode("utf-8"), np.uint8).max() <= 0xC9 and not any(s in text for s in self.special))

    def ids(self, text) -> np.ndarray:
        """The ids of a text and the end token."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list) -> list[np.ndarray]:
        """The ids of each text and the end token."""
        out, latin = [np.array([END], np.uint32)] * len(texts), []
        for i, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            if self.latin(text):
                latin.append(i)
            else:
                ids = self.slow.encode(text, add_special_tokens=False).ids
                out[i] = np.array([*ids, END], np.uint32)
        if latin:
            for i, ids in zip(latin, self.latin_ids([texts[i] for i in latin]), strict=True):
                out[i] = np.append(ids, np.uint32(END))
        return out

    def latin_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of Latin texts, none empty: each distinct piece is encoded once."""
        joined = "".join(texts)
        raw = joined.encode("utf-8")
        first = np.cumsum([0, *map(len, texts)])[:-1]
        ascii_only = len(raw) == len(joined)
        chars = np.frombuffer(raw, np.uint8) if ascii_only else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begins = np.zeros(len(chars), bool)
        begins[first] = True
        start = np.flatnonzero(piece_starts(chars, begins))
        bounds = start if ascii_only else (np.cumsum(chars >= 0x80) - (chars >= 0x80))[start] + start    # in UTF-8
        pieces = pa.LargeStringArray.from_buffers(
            len(start), pa.py_buffer(np.append(bounds, len(raw)).astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        known = [self.piece(p) for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        which = pieces.indices.to_numpy()
        count = size[which]
        ends = np.append(0, np.cumsum(count))
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - ends[:-1], count) + np.arange(ends[-1])]
        return np.split(ids, ends[np.searchsorted(start, first[1:])])

    def piece(self, text: str) -> bytes:
        """The ids of a piece; the last ``KEPT_PIECES`` or fewer are kept."""
        ids = self.kept.get(text)
        if ids is None:
            if len(self.kept) >= KEPT_PIECES:
                self.kept.clear()
            ids = array("I", self.fast.encode_ordinary(text)).tobytes()
            if len(text) <= KEPT_LENGTH:
                self.kept[text] = ids
        return ids


def piece_starts(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which characters begin a piece of ``PATTERN``, in texts of characters below
    ``LATIN`` that follow each other; ``begins`` marks the first one of each text."""
    n, kind = len(chars), KINDS[chars]
    start = begins.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last space before something is a piece, or goes with it if it is a blank
    last = np.append((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:], False)
    start |= last
    start[1:] &= ~(last & (chars == 32))[:-1]
    # 's, 't, 're, 've, 'm, 'll and 'd where a piece begins
    text = np.concatenate([chars, np.zeros(2, chars.dtype)]).astype(np.uint32, copy=False)
    ends = np.concatenate([begins, np.ones(2, bool)])
    quote = np.flatnonzero((chars == ord("'")) & start)
    quote = quote[~ends[quote + 1]]
    one = np.isin(text[quote + 1], [ord(c) for c in "stmd"])
    pair = text[quote + 1] * 256 + text[quote + 2]
    two = ~ends[quote + 2] & np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    start[quote[one | two] + 1] = False
    for after in (quote[one] + 2, quote[two] + 3):
        start[after[after < n]] = True
    return start


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    _ENCODERS.clear()


def tokens(documents: DataFrame, path: str) -> DataFrame:
    """A written table (doc_id, ids, df): the ids of every document as
    little-endian numbers, and from every task one row without ids that holds
    the number of its documents with each token, after the number of its
    documents and of their tokens."""
    kind = documents.schema["doc_id"].dataType

    def run(batches):
        enc = encoder(path)
        df, n, total = np.zeros(enc.size, np.int64), 0, 0
        schema = None
        for b in batches:
            schema = schema or b.schema.field(0)
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // PIECE_BYTES)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                part, out = b.slice(at, to - at), []
                for ids in enc.ids_of(part.column(1).to_pylist()):
                    df[np.unique(ids)] += 1
                    n, total = n + 1, total + len(ids)
                    out.append(packed(ids, enc.size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())],
                    names=["doc_id", "ids", "df"])
        if schema is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, schema.type), pa.nulls(1, pa.binary()),
                 pa.array([np.concatenate([[n, total], df]).tobytes()], pa.binary())],
                names=["doc_id", "ids", "df"])

    return written(documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind.simpleString()}, ids binary, df binary"))


def packed(ids: np.ndarray, size: int) -> bytes:
    return ids.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if size <= 1 << 16 else "<u4").astype("<u4")


def corpus_counts(table: DataFrame, size: int) -> np.ndarray:
    """[documents, tokens, documents with token 0, 1, ...] of the corpus."""

    def run(batches):
        total = np.zeros(size + 2, np.int64)
        for b in batches:
            for d in b.column(0).to_pylist():
                total += np.frombuffer(d, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = (table.filter("df IS NOT NULL").select("df").mapInArrow(run, "at long, n long")
            .groupBy("at").agg(F.sum("n").alias("n")).collect())       # bounded by the vocabulary
    out = np.zeros(size + 2, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def like_together(table: DataFrame, counts: np.ndarray, size: int, tokens_each: int) -> DataFrame:
    """(doc_id, ids) ordered over all tasks by the two tokens of each document
    that weigh most among those of several documents. Tasks take ranges of
    about ``tokens_each`` tokens, whose bounds come from a sample; they are cut
    within a frequent pair as well, by a hash of the row's place."""
    kind = table.schema["doc_id"].dataType.simpleString()
    n, df = counts[0], counts[2:]
    idf = np.where(df > 1, np.log1p((n - df + 0.5) / (df + 0.5)), 0)
    mean = max(counts[1] / max(n, 1), 1)
    ranges = max(-(-int(counts[1]) // tokens_each), 1)

    def heaviest(data: bytes) -> tuple[int, int]:
        t, tf = np.unique(np.frombuffer(data, "<u2" if size <= 1 << 16 else "<u4"), return_counts=True)
        w = idf[t] * tf / (tf + K1 * (1 - B + B * tf.sum() / mean))
        i = int(w.argmax())
        first, w[i] = int(t[i]), -1
        return first, int(t[w.argmax()])

    def keyed(rows, bounds):
        def run(batches):
            forget_encoders()                           # this worker needs their memory
            for b in batches:
                top = [(*heaviest(d), h) for d, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                part = [bisect.bisect_right(bounds, t) for t in top]
                first, second, salt = zip(*top, strict=True) if top else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (first, second, salt)),
                     pa.array(part, pa.int32())], names=["doc_id", "ids", "first", "second", "salt", "part"])

        return rows.mapInArrow(run, f"doc_id {kind}, ids binary, first long, second long, salt long, part int")

    rows = (table.filter("ids IS NOT NULL")
            .select("doc_id", "ids", F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
    bounds = []
    if ranges > 1:
        some = rows.sample(min(1.0, SAMPLE * ranges / int(n)), seed=1)
        some = sorted(tuple(r) for r in keyed(some, []).select("first", "second", "salt").collect())
        bounds = [some[len(some) * i // ranges] for i in range(1, ranges)] if some else []
    return (keyed(rows, bounds).repartitionById(ranges, F.col("part"))
            .sortWithinPartitions("first", "second", "salt").select("doc_id", "ids"))


class Shard:
    """BM25 index of some documents; the postings of a term by document."""

    def __init__(self, docs: list[np.ndarray], counts: np.ndarray):
        n, total, df = counts[0], counts[1], counts[2:]
        size = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), size)
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        term, self.doc = key // len(docs), key % len(docs)
        idf = np.log1p((n - df[term] + 0.5) / (df[term] + 0.5))
        norm = K1 * (1 - B + B * size[self.doc] / max(total / max(n, 1), 1))
        self.impact = idf * tf * (K1 + 1) / (tf + norm)
        # a term of one document tells nothing about the others
        _, place, held = np.unique(term, return_inverse=True, return_counts=True)
        shared = held[place] > 1
        term, self.doc, self.impact = term[shared], self.doc[shared], self.impact[shared]
        _, self.start, place = np.unique(term, return_index=True, return_inverse=True)
        self.stop = np.append(self.start[1:], len(term))
        # terms of each document
        order = np.argsort(self.doc, kind="stable")
        self.query, self.first = place[order], np.searchsorted(self.doc[order], np.arange(len(docs) + 1))
        self.n = self.live = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every other document for all terms of the seed."""
        q = self.query[self.first[seed]:self.first[seed + 1]]
        where = [slice(a, b) for a, b in zip(self.start[q].tolist(), self.stop[q].tolist(), strict=True)]
        if not where:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[w] for w in where]),
                           np.concatenate([self.impact[w] for w in where]), self.n)

    def narrow(self, unused: np.ndarray) -> None:
        """Drop the postings of used documents once they are a quarter."""
        n = int(np.count_nonzero(unused))
        if 4 * n < 3 * self.live:
            keep = unused[self.doc]
            at = np.append(0, np.cumsum(keep))
            self.doc, self.impact = self.doc[keep], self.impact[keep]
            self.start, self.stop, self.live = at[self.start], at[self.stop], n

    def neighbours(self, seed: int, unused: np.ndarray):
        """Unused documents with a positive score, best first (ties: the
        earlier document)."""
        self.narrow(unused)
        s = np.where(unused, self.scores(seed), 0)
        s[seed] = 0
        left = np.flatnonzero(s > 0)
        while len(left):
            if len(left) > NEAREST:
                least = np.partition(s[left], -NEAREST)[-NEAREST]
                best, left = left[s[left] >= least], left[s[left] < least]
            else:
                best, left = left, left[:0]
            yield from best[np.lexsort((best, -s[best]))].tolist()


def pack(docs: list[np.ndarray], lo: list[int], counts: np.ndarray, window: int, last: bool):
    """Sequences as lists of (document, start, stop), and the rest that fills no
    window: (document, start). Tokens before ``lo`` are packed already."""
    at = np.array(lo, np.int64)
    size = np.array([len(d) for d in docs], np.int64)
    out = []
    for i in range(len(docs)):
        while size[i] - at[i] >= window:
            out.append([(i, int(at[i]), int(at[i]) + window)])
            at[i] += window
    unused = at < size
    left = int((size - at).sum())
    index = Shard(docs, counts) if left >= window else None
    seeds = [(-int(size[i] - at[i]), i) for i in np.flatnonzero(unused)]
    heapq.heapify(seeds)

    def next_seed():
        while seeds:
            n, i = heapq.heappop(seeds)
            if unused[i] and -n == size[i] - at[i]:     # else it has been cut meanwhile
                return i
        return None

    def put(seq, i, room):
        n = min(int(size[i] - at[i]), room)
        seq.append((i, int(at[i]), int(at[i]) + n))
        at[i] += n
        unused[i] = at[i] < size[i]
        if unused[i]:
            heapq.heappush(seeds, (-int(size[i] - at[i]), i))
        return room - n

    while left >= window:
        seed, seq = next_seed(), []
        room = put(seq, seed, window)
        for i in index.neighbours(seed, unused) if room else ():
            room = put(seq, i, room)
            if not room:
                break
        while room:                                     # no neighbour left: the next seeds
            room = put(seq, next_seed(), room)
        out.append(seq)
        left -= window
    if not last:
        return out, [(int(i), int(at[i])) for i in np.flatnonzero(unused)]
    while left:                                         # sequences of a power of two
        room = 1 << (left.bit_length() - 1)
        left -= room
        seq = []
        while room:
            room = put(seq, next_seed(), room)
        out.append(seq)
    return out, []


def pack_documents(documents: DataFrame, path: str, window: int = WINDOW,
                   shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset. ``sequence_id`` is unique; a sequence is full or
    has a power of two of tokens."""
    table = tokens(documents, path)
    size = encoder(path).size
    counts = corpus_counts(table, size)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        base, made = TaskContext.get().partitionId() << 40, 0
        keys, docs, lo, held, key_type = [], [], [], 0, None

        def flush(last):
            nonlocal keys, docs, lo, held, made
            sequences, rest = pack(docs, lo, counts, window, last)
            rows = []
            for seq in sequences:
                offset = 0
                for i, a, b in seq:
                    rows.append((keys[i], a, b - a, zlib.crc32(docs[i][a:b].tobytes()), len(docs[i]),
                                 base + made, offset))
                    offset += b - a
                made += 1
            keys, docs, lo = [keys[i] for i, _ in rest], [docs[i] for i, _ in rest], [a for _, a in rest]
            held = 0
            cols = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            key_type = b.schema.field(0).type
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                docs.append(unpacked(d, size))
                lo.append(0)
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield flush(False)
        if docs:
            yield flush(True)

    return like_together(table, counts, size, RANGE_SHARDS * shard_tokens).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")
