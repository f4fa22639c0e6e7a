"""Language identification with a byte convolutional network.

Bytes of a text (A-Z folded to a-z) are cut into windows of fixed length. Every
byte has an embedding; filters of several widths run over each window, the
largest response of every filter over the window is kept, and a softmax layer
turns these into language probabilities. A text's prediction is the mean of
its windows' log-probabilities, weighted by their bytes: every byte of every
text is read.

The network is trained in numpy on a sample of labelled texts, at most
``DOCS_PER_LANG`` texts of a language and ``WINDOWS_PER_DOC`` windows of a
text. A convolution is linear in the bytes, so prediction sums the filter
responses of two byte pairs from tables instead of multiplying matrices.

Edge cases: a null text and one without a letter (empty, digits, signs) are
``und`` with score 0; without any training row everything is ``und``; equal
texts get equal results; an empty table gives an empty result; training uses
rows with a non-null text and language only; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tasklens.llm.common import by_place, hashed_sample, renamed, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8             # of each width
EMBED = 8
DOCS_PER_LANG = 600
WINDOWS_PER_DOC = 4
STEPS = 400
BATCH = 96
UNKNOWN = "und"
#: Window positions whose filter responses are in memory at once.
CHUNK_WINDOWS = 64

SPAN = max(WIDTHS)
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def windows_of(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes of a text, the last window padded with zeros."""
    n = max(-(-len(data) // WINDOW), 1)
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def training_windows(documents: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """(lang, window) of a sample of labelled texts, evenly spread over each."""
    known = documents.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    ids = hashed_sample(known.select("doc_id", "lang").distinct(), "lang", docs_per_lang)

    def cut(batches):
        for b in batches:
            langs, out, labels = b.column(0).to_pylist(), [], []
            for lang, text in zip(langs, b.column(1).to_pylist(), strict=True):
                if not has_letter(text):
                    continue
                w = windows_of(utf8(text).translate(FOLD))
                for i in sorted({len(w) * k // WINDOWS_PER_DOC for k in range(WINDOWS_PER_DOC)}):
                    out.append(w[i].tobytes())
                    labels.append(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    # at most ``docs_per_lang`` ids of each language, so the texts need no shuffle
    sampled = known.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")
    pieces = sampled.mapInArrow(cut, "lang string, window binary")
    # equal windows (copies of a text) count once
    pieces = pieces.distinct()
    # the bound holds where ids repeat as well
    cap = Window.partitionBy("lang").orderBy(F.xxhash64("window"), "window")
    return (pieces.withColumn("r", F.row_number().over(cap))
            .filter(F.col("r") <= docs_per_lang * WINDOWS_PER_DOC).select("lang", "window"))


def initial(rng: np.random.Generator, n_langs: int) -> dict[str, np.ndarray]:
    f = FILTERS * len(WIDTHS)
    keep = np.concatenate([np.arange(SPAN)[:, None] < w for w in WIDTHS for _ in range(FILTERS)], 1)
    mask = np.repeat(keep, EMBED, axis=0).astype(np.float32)          # (SPAN * EMBED, f)
    return {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, (SPAN * EMBED, f)) * mask).astype(np.float32),
            "bias": np.zeros(f, np.float32),
            "out": rng.normal(0, 0.2, (f, n_langs)).astype(np.float32),
            "c": np.zeros(n_langs, np.float32), "mask": mask}


def train(windows: np.ndarray, labels: np.ndarray, n_langs: int, steps: int = STEPS,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Weights fitted by Adam on class-balanced batches."""
    rng = np.random.default_rng(seed)
    p = initial(rng, n_langs)
    names = ["emb", "conv", "bias", "out", "c"]
    m1 = {k: np.zeros_like(p[k]) for k in names}
    m2 = {k: np.zeros_like(p[k]) for k in names}
    members = [np.nonzero(labels == y)[0] for y in range(n_langs)]
    width = WINDOW - SPAN + 1
    for step in range(1, steps + 1):
        y = rng.integers(n_langs, size=BATCH)
        x = windows[[members[k][rng.integers(len(members[k]))] for k in y]]
        # random cuts, so that short texts are met in training as well
        ends = np.where(rng.random(BATCH) < 0.3, rng.integers(12, WINDOW, BATCH), WINDOW)
        x = np.where(np.arange(WINDOW) < ends[:, None], x, 0)
        e = p["emb"][x]                                                # (B, L, E)
        cols = np.concatenate([e[:, j:j + width] for j in range(SPAN)], axis=2)
        r = cols.reshape(-1, SPAN * EMBED) @ p["conv"]
        r = r.reshape(BATCH, width, -1)
        at = r.argmax(axis=1)                                          # (B, F)
        top = np.take_along_axis(r, at[:, None], 1)[:, 0] + p["bias"]
        hid = np.maximum(top, 0)
        z = hid @ p["out"] + p["c"]
        z -= z.max(axis=1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=1, keepdims=True)
        dz = prob
        dz[np.arange(BATCH), y] -= 1
        dz /= BATCH
        g = {"out": hid.T @ dz + 1e-4 * p["out"], "c": dz.sum(0)}
        dh = (dz @ p["out"].T) * (top > 0)
        g["bias"] = dh.sum(0)
        rows = cols[np.arange(BATCH)[:, None], at]                     # (B, F, SPAN * E)
        g["conv"] = np.einsum("bf,bfd->df", dh, rows) * p["mask"]
        back = dh[:, :, None] * p["conv"].T[None]                      # (B, F, SPAN * E)
        g["emb"] = np.zeros_like(p["emb"])
        for j in range(SPAN):
            byte = x[np.arange(BATCH)[:, None], at + j]
            np.add.at(g["emb"], byte, back[:, :, j * EMBED:(j + 1) * EMBED])
        for k in names:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] -= 0.01 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return p


class Model:
    """Languages and weights; prediction tables are built once per worker."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray] | None):
        self.langs, self.weights = langs, weights

    def key(self):
        return (tuple(self.langs), *(w.tobytes() for _, w in sorted((self.weights or {}).items())))


def fit(documents: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model of the languages in ``documents`` (text, lang, doc_id); at most
    ``docs_per_lang * WINDOWS_PER_DOC`` windows of each language reach the driver."""
    rows = training_windows(documents, docs_per_lang).toPandas()
    rows = rows.sort_values(["lang", "window"], ignore_index=True)
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], None)
    x = np.stack([np.frombuffer(bytes(w), np.uint8) for w in rows["window"]])
    y = np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object))
    return Model(langs, train(x, y, len(langs)))


_TABLES: dict = {}


def tables(model: Model):
    """Filter responses of byte pairs at offsets 0 and 2."""
    key = hash(model.key())
    if key not in _TABLES:
        p = model.weights
        e = [p["emb"] @ p["conv"][j * EMBED:(j + 1) * EMBED] for j in range(SPAN)]
        _TABLES.clear()
        _TABLES[key] = [(e[j][:, None] + e[j + 1][None]).reshape(65536, -1) for j in range(0, SPAN, 2)]
    return _TABLES[key]


def predict(model: Model, texts: list) -> tuple[list[str], np.ndarray]:
    """Language and score (probability) of every text."""
    todo = [i for i, t in enumerate(texts) if isinstance(t, str) and model.langs and has_letter(t)]
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not todo:
        return langs, scores
    p, pair = model.weights, tables(model)
    width = WINDOW - SPAN + 1
    for at in range(0, len(todo), 512):
        ids = todo[at:at + 512]
        data = [utf8(texts[i]).translate(FOLD) for i in ids]
        cut = [windows_of(d) for d in data]
        x = np.concatenate(cut).astype(np.int32)
        code = x[:, :-1] * 256 + x[:, 1:]
        logp = np.empty((len(x), len(model.langs)))
        for k in range(0, len(x), CHUNK_WINDOWS):
            c = code[k:k + CHUNK_WINDOWS]
            r = np.take(pair[0], c[:, :width], axis=0)
            r += np.take(pair[1], c[:, 2:2 + width], axis=0)
            z = np.maximum(r.max(axis=1) + p["bias"], 0) @ p["out"] + p["c"]
            z -= z.max(axis=1, keepdims=True)
            logp[k:k + CHUNK_WINDOWS] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        n = np.array([len(c) for c in cut])
        first = np.cumsum(n) - n
        weight = np.full(len(x), float(WINDOW))
        weight[first + n - 1] = [len(d) - (k - 1) * WINDOW for d, k in zip(data, n, strict=True)]
        mean = np.add.reduceat(logp * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
        best = mean.argmax(axis=1)
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        scores[ids] = (prob / prob.sum(axis=1, keepdims=True)).max(axis=1)
        for i, b in zip(ids, best, strict=True):
            langs[i] = model.langs[b]
    return langs, scores


def language(text: Column, model: Model) -> Column:
    """struct(lang, score) of a text column."""

    @F.pandas_udf("lang string, score double")
    def guess(t: pd.Series) -> pd.DataFrame:
        lang, score = predict(model, t.tolist())
        return pd.DataFrame({"lang": lang, "score": score})

    return guess(text)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    found = documents.select("doc_id", language(F.col("text"), model).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"),
                        F.col("found.score").alias("score"))


def keep_languages(documents: DataFrame, model: Model) -> DataFrame:
    """The documents in which a language was found, with all their columns."""
    cols = documents.columns
    found = by_place(documents).withColumn(
        "found", language(F.col(f"c{cols.index('text')}"), model))
    return renamed(found.filter(F.col("found.lang") != UNKNOWN), cols)
