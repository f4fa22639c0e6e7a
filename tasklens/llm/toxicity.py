"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents gives the examples and the vocabulary
(the words whose presence differs most between the classes, by chi-square and
lift).
Document frequencies of these words are counted over all documents. The
examples' unit vectors lie in an inverted index whose postings are cut into
blocks of examples; a block keeps the largest weight of every word. A text
visits blocks in the order of their upper bounds and stops at the first whose
bound is below its k-th best cosine, so the neighbours are exact. Neighbours
vote with their cosine; class weights undo the sampling, and a prior of the
training rows without any known word is mixed in, so scores are shares of
toxic documents among like ones.

The sample is at most ``EXAMPLES`` documents of each class (the smallest hashes
of doc_id), of near copies with one label (shingle similarity of 0.8 or more)
one, the vocabulary at most ``VOCABULARY`` words; both are parameters.

Edge cases: null and empty texts and texts without a known word get the prior;
without any training row the score is 0; a document with several labels is
toxic if one of them is; null labels are ignored; repeated rows are all
returned with equal scores; empty tables give an empty result; further columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklens.llm.common import WORD_BYTES, hashed_sample, utf8

EXAMPLES = 4000
VOCABULARY = 512
#: Least chi-square of a word of the vocabulary (one degree of freedom).
CHI_SQUARE = 25.0
#: Least ratio of its shares in the two classes, either way round: with many
#: examples, chance differences of ordinary words are significant as well.
LIFT = 4.0
NEIGHBOURS = 15
BLOCK = 64
#: Sum of the neighbours' cosines at which their vote weighs as much as the prior.
PRIOR = 0.5


def labelled(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, text) of the sampled labelled documents."""
    y = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
         .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    known = y.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = hashed_sample(known, "toxic", examples)
    # at most ``examples`` rows of each class, so the texts need no shuffle
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # rows that repeat a doc_id count once
    return rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))


def shingles(text) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles."""
    w = utf8(text).translate(WORD_BYTES).split()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(w[i:i + 5]))
                               for i in range(max(len(w) - 4, 1))], np.uint64))


def distinct_sets(sets: list[np.ndarray]) -> list[int]:
    """The sets, in order, that have a similarity below 4/5 to every one kept
    before. Sets that are so similar share one of the rarest fifth of their
    elements, so only sets that do are compared."""
    if not sets:
        return []
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(n), np.int64)
    order[np.argsort(n, kind="stable")] = np.arange(len(n))
    ranks = np.split(order[place], np.cumsum([len(x) for x in sets])[:-1])
    kept, held = [], {}
    for i, s in enumerate(map(np.sort, ranks)):
        ranks[i] = s
        rare = s[:len(s) - (-(-4 * len(s) // 5)) + 1].tolist()
        for j in {j for r in rare for j in held.get(r, ())}:
            m = len(ranks[j])
            if 5 * min(m, len(s)) >= 4 * max(m, len(s)):
                both = len(np.intersect1d(s, ranks[j], assume_unique=True))
                if 5 * both >= 4 * (m + len(s) - both):
                    break
        else:
            kept.append(i)
            for r in rare:
                held.setdefault(r, []).append(i)
    return kept


def without_copies(rows: DataFrame) -> DataFrame:
    """The sampled rows without those whose 5-word shingles have a similarity of
    0.8 or more to a kept row of a smaller doc_id with the same label: else the
    ordinary words of a text with many copies would tell its class."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([shingles(t).view(np.int64) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))],
                names=["doc_id", "toxic", "h"])

    def keep(table: pa.Table) -> pa.Table:             # a class of the sample: of bounded size
        table = table.sort_by("doc_id")
        sets = [np.asarray(h.values) for h in table.column("h")]
        return table.select(["doc_id"]).take(pa.array(distinct_sets(sets), pa.int64()))

    kept = (rows.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, h array<long>")
            .groupBy("toxic").applyInArrow(keep, f"doc_id {kind}").collect())
    ids = rows.sparkSession.createDataFrame([tuple(r) for r in kept], f"doc_id {kind}")
    return rows.join(F.broadcast(ids), "doc_id", "left_semi")


def count_terms(rows: DataFrame) -> DataFrame:
    """(toxic, term, n): documents of each class that hold a word; the null
    term counts the documents."""

    def run(batches):
        for b in batches:
            by = {}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = by.setdefault(y, Counter())
                c.update(set(utf8(t).translate(WORD_BYTES).split()))
                c[None] += 1
            out = [(y, w, n) for y, c in by.items() for w, n in c.items()]
            y, w, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(y, pa.int32()), pa.array(w, pa.binary()), pa.array(n, pa.int64())],
                names=["toxic", "term", "n"])

    part = rows.select("toxic", "text").mapInArrow(run, "toxic int, term binary, n long")
    return part.groupBy("toxic", "term").agg(F.sum("n").alias("n"))


def telling_terms(counts: DataFrame, size: int = VOCABULARY, least: float = CHI_SQUARE):
    """(words by chi-square, documents of each class)."""
    total = {r.toxic: r.n for r in counts.filter("term IS NULL").collect()}     # two rows
    pos = float(total.get(1, 0))
    neg = float(sum(total.values()) - pos)
    if not pos or not neg:
        return [], (neg, pos)
    by = (counts.filter("term IS NOT NULL").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b")))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d, n = pos - a, neg - b, pos + neg
    chi = n * (a * d - b * c) ** 2 / (pos * neg * (a + b) * F.greatest(c + d, F.lit(1.0)))
    # half a document more on each side, for words that one class lacks
    in_pos, in_neg = (a + 0.5) / (pos + 1), (b + 0.5) / (neg + 1)
    telling = F.greatest(in_pos / in_neg, in_neg / in_pos) >= LIFT
    top = (by.withColumn("chi", chi).filter((F.col("chi") >= least) & telling)
           .orderBy(F.desc("chi"), "term").limit(size).collect())              # at most ``size`` rows
    return [bytes(r.term) for r in top], (neg, pos)


def document_frequencies(documents: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """Documents that hold each word, and all documents: the whole corpus."""
    known = set(terms)

    def run(batches):
        c = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c[None] += 1
                c.update(known.intersection(utf8(t).translate(WORD_BYTES).split()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])

    rows = (documents.select("text").mapInArrow(run, "term binary, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())             # one row for each word
    n = {None if r.term is None else bytes(r.term): r.n for r in rows}
    return np.array([n.get(t, 0) for t in terms], float), n.get(None, 0)


def vectors(texts: list, terms: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (zero without a known word); tf is 1 + ln(count)."""
    out = np.zeros((len(texts), len(idf)))
    for i, t in enumerate(texts):
        for w, n in Counter(filter(terms.__contains__, utf8(t).translate(WORD_BYTES).split())).items():
            out[i, terms[w]] = n
    out[out > 0] = 1 + np.log(out[out > 0])
    out *= idf
    norm = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class Index:
    """Postings of the examples in blocks, and what the votes need."""

    terms: dict[bytes, int]
    idf: np.ndarray
    ids: list            # of the examples
    toxic: np.ndarray
    weight: np.ndarray   # of each example's vote
    blocks: list         # (words, word-by-example postings) of each block
    top: np.ndarray      # (words, blocks): largest weight
    prior: float

    def neighbours(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact k best cosines of each row of ``q`` and their examples (-1:
        none); ties to the example that comes first."""
        n = len(q)
        best, who = np.zeros((n, k)), np.full((n, k), -1)
        bound = q @ self.top
        order = np.argsort(-bound, axis=1, kind="stable")
        for r in range(len(self.blocks)):
            mine = order[:, r]
            # equal bounds are visited as well: their ties may come first
            go = np.flatnonzero((bound[np.arange(n), mine] > 0)
                                & (bound[np.arange(n), mine] >= best[:, -1] - 1e-12))
            if not len(go):
                break
            for b in np.unique(mine[go]):
                rows = go[mine[go] == b]
                words, post = self.blocks[b]
                sim = q[np.ix_(rows, words)] @ post
                all_s = np.concatenate([best[rows], sim], axis=1)
                all_w = np.concatenate([who[rows], np.broadcast_to(
                    np.arange(b * BLOCK, b * BLOCK + post.shape[1]), sim.shape)], axis=1)
                all_w = np.where(all_s > 0, all_w, -1)
                rank = np.lexsort((all_w, -np.round(all_s, 12)))[:, :k]
                best[rows] = np.take_along_axis(all_s, rank, 1)
                who[rows] = np.take_along_axis(all_w, rank, 1)
        return best, who

    def scores(self, texts: list, k: int = NEIGHBOURS, detail: int = 3):
        """Score and the ``detail`` nearest examples (id, cosine, toxic)."""
        score, evidence = np.full(len(texts), self.prior), [[] for _ in texts]
        for at in range(0, len(texts), 512):
            q = vectors(texts[at:at + 512], self.terms, self.idf)
            rows = np.flatnonzero(q.any(axis=1))
            if not len(rows) or not self.ids:
                continue
            sim, who = self.neighbours(q[rows], k)
            near = np.where(who >= 0, sim, 0)
            vote = near * self.weight[who]
            share = (vote * self.toxic[who]).sum(axis=1) / np.maximum(vote.sum(axis=1), 1e-300)
            likeness = near.sum(axis=1)
            score[at + rows] = (likeness * share + PRIOR * self.prior) / (likeness + PRIOR)
            for i, s, w in zip(at + rows, sim[:, :detail], who[:, :detail], strict=True):
                evidence[i] = [(self.ids[e], float(c), int(self.toxic[e]))
                               for c, e in zip(s, w, strict=True) if e >= 0]
        return score, evidence


def fit(documents: DataFrame, train: DataFrame, labels: DataFrame, examples: int = EXAMPLES,
        size: int = VOCABULARY) -> Index:
    """Index of the labelled rows of ``train``; corpus counts over all
    ``documents``. At most ``2 * examples`` vectors of ``size`` weights reach
    the driver."""
    sample = labelled(train, labels, examples).cache()
    try:
        rows = without_copies(sample)
        terms, (neg, pos) = telling_terms(count_terms(rows), size)
        df, n = document_frequencies(documents, terms)
        at = {t: i for i, t in enumerate(terms)}
        idf = np.log((n + 1) / (df + 1)) + 1

        def run(batches):
            for b in batches:
                v = vectors(b.column(2).to_pylist(), at, idf)
                keep = [np.flatnonzero(x) for x in v]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1),
                     pa.array([k.tolist() for k in keep], pa.list_(pa.int32())),
                     pa.array([x[k].tolist() for x, k in zip(v, keep, strict=True)], pa.list_(pa.float64()))],
                    names=["doc_id", "toxic", "at", "w"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        got = rows.select("doc_id", "toxic", "text").mapInArrow(
            run, f"doc_id {kind}, toxic int, at array<int>, w array<double>").collect()
    finally:
        sample.unpersist()
    # the true share of each class among the labelled rows of ``train``
    share = {r.toxic: r.n for r in labels.filter("toxic IS NOT NULL")
             .join(train.select("doc_id").distinct(), "doc_id", "left_semi")
             .groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    full = {1: float(share.get(1, 0)), 0: float(sum(share.values()) - share.get(1, 0))}
    scale = {1: full[1] / pos if pos else 0.0, 0: full[0] / neg if neg else 0.0}
    blank = {y: sum(1 for r in got if not r["at"] and (r.toxic == 1) == bool(y)) * scale[y] for y in (0, 1)}
    mass = sum(blank.values()) or sum(full.values())
    prior = (blank[1] if sum(blank.values()) else full[1]) / mass if mass else 0.0
    # alike examples share blocks: by class, then by their heaviest word
    got = sorted((r for r in got if r["at"]),
                 key=lambda r: (r.toxic, r["at"][int(np.argmax(r["w"]))], r.doc_id))
    x = np.zeros((len(got), len(terms)))
    for i, r in enumerate(got):
        x[i, r["at"]] = r["w"]
    blocks, top = [], np.zeros((len(terms), -(-len(got) // BLOCK)))
    for b in range(top.shape[1]):
        part = x[b * BLOCK:(b + 1) * BLOCK]
        words = np.flatnonzero(part.any(axis=0))
        blocks.append((words, part[:, words].T.copy()))
        top[:, b] = part.max(axis=0)
    toxic = np.array([float(r.toxic == 1) for r in got] or [0.0])
    return Index(at, idf, [r.doc_id for r in got], toxic,
                 np.where(toxic > 0, scale[1], scale[0]) / max(scale.values(), default=1.0)
                 if got else np.ones(1), blocks, top, prior)


def toxicity(text: Column, index: Index) -> Column:
    """struct(score, evidence) of a text column."""

    @F.pandas_udf("score double, evidence array<struct<doc_id: string, cosine: double, toxic: int>>")
    def judge(t: pd.Series) -> pd.DataFrame:
        score, evidence = index.scores(t.tolist())
        return pd.DataFrame({"score": score, "evidence": [
            [{"doc_id": str(i), "cosine": c, "toxic": y} for i, c, y in e] for e in evidence]})

    return judge(text)


def score_documents(documents: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted and the nearest examples of every row."""
    found = documents.select("doc_id", toxicity(F.col("text"), index).alias("f"))
    score = F.least(F.greatest(F.col("f.score"), F.lit(0.0)), F.lit(1.0))
    return found.select("doc_id", score.alias("score"),
                        (score >= 0.5).cast("int").alias("predicted"),
                        F.col("f.evidence").alias("evidence"))
